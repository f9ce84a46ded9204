"""Document fingerprints by consistent weighted sampling, in DataFrame expressions alone.

The terms of a text are its windows of five words (the whole text where it has fewer), weighted by
their counts. Every position of a signature is drawn from all terms: for a term and a position there are
gamma variates r, c ~ Gamma(2, 1) and a uniform b, and with weight S

    t = floor(ln S / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r

and the position's sample is (term, t) of the least a. Two texts agree in a position with their
generalised Jaccard similarity; ``likeness`` is the share of agreeing positions.

The variates are made such that only the small a are looked at, with the same result. Let x be the a of
weight 1, and E, w standard exponential like x: then c = x + E, r = ln(c / x) + w and b = w / r are two
gamma variates and a uniform one, all independent, and a = x exp(-r t). The 128 x of a term are the
quantiles of one number from each of 128 equal parts of (0, 1), dealt over the positions by the term's
hash, so that in every position x is exponential. A part below the limit m stands for every term of count 1
with a < T = -ln(1 - m / 128); of a term with more, a >= x exp(-w) / S tells which parts may be below T. A
position that has a sample below T has the least; where one has none, the text is drawn with a higher limit
and, at last, with all parts.

Defined results: a null text is the empty text; two texts without a word have likeness 1, one such text
and another 0; equal texts have equal fingerprints; of rows that share an id, the order is that of their
texts; a lone document is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.session import table

SPACE = r"[\x20\x09-\x0D]+"
WIDTH = 5
BINS = 128
#: A sample is packed as position (7 bits), 1 - exp(-a) in steps of 2**-40, hash of (term, t) (16 bits).
STEP = 2.0**-40
#: Expected samples below the first limit in each position; of texts with more terms, a share of 128 exp(-8) is drawn again.
ENOUGH = 8
EMPTY = "----"
#: Bytes of text in a partition of the order by id, partitions at most (larger ones are sorted on disk), stretches of ids in each.
PART, MOST_PARTS, STRETCHES = 4 << 20, 65_536, 8
LEAST_ID = -(1 << 63)


def _half(h: Column, upper: bool) -> Column:
    """A uniform number in (0, 1) from one half of a 64-bit hash."""
    bits = F.shiftrightunsigned(h, 32) if upper else h.bitwiseAND(F.lit(0xFFFFFFFF))
    return (bits + F.lit(0.5)) * F.lit(2.0**-32)


def _place(h: Column, part: Column) -> Column:
    """The position that a term's hash gives to this part, where a packed sample has it."""
    return F.shiftleft(h.bitwiseXOR(part).bitwiseAND(F.lit(BINS - 1)), 56)


def _first(part: Column, x: Column) -> Column:
    """1 - exp(-a) of weight 1, in steps: a number in the part, from the hash of term and part."""
    return F.shiftleft(part, 33).bitwiseOR(F.shiftrightunsigned(x, 31))


def _single(h: Column, part: Column) -> Column:
    """The packed sample of a term with count 1: ln S = 0, hence t = 0. Below the part, the hash's upper 49 bits: step, then tag."""
    return _place(h, part).bitwiseOR(F.shiftleft(part, 49)).bitwiseOR(F.shiftrightunsigned(F.xxhash64(h, part), 15))


def _other(h: Column, part: Column) -> Column:
    """The hash whose halves are exp(-w) and exp(-E)."""
    return F.xxhash64(h, part, F.lit(1))


def _counted(x: Column, m: Column) -> Column:
    """The packed samples below the limit of a term x, a struct (h, n): hash and count."""
    h, ln_s = x["h"], F.log(x["n"].cast("double"))
    most = F.when(m < BINS, -F.log1p(-m / BINS) * BINS * x["n"]).otherwise(F.lit(float("inf")))
    # part, its hash, and the two exponential variates
    hashed = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda j: F.struct(j.alias("j"), _other(h, j).alias("o")))
    may = F.filter(hashed, lambda v: v["j"] * _half(v["o"], True) <= most)
    one = lambda k: -F.log1p(-(_first(k["j"], k["f"]) + F.lit(0.5)) * F.lit(STEP))
    made = F.transform(may, lambda v: F.struct(v["j"].alias("j"), F.xxhash64(h, v["j"]).alias("f"), (-F.log(_half(v["o"], False))).alias("e"), (-F.log(_half(v["o"], True))).alias("w")))
    made = F.transform(made, lambda v: F.struct(v["j"].alias("j"), v["f"].alias("f"), v["e"].alias("e"), v["w"].alias("w"), one(v).alias("x")))
    made = F.transform(made, lambda v: F.struct(v["j"].alias("j"), v["f"].alias("f"), v["x"].alias("x"), v["w"].alias("w"), (F.log1p(v["e"] / v["x"]) + v["w"]).alias("r")))
    made = F.transform(made, lambda v: F.struct(v["j"].alias("j"), v["f"].alias("f"), v["x"].alias("x"), v["r"].alias("r"), F.floor((ln_s + v["w"]) / v["r"]).alias("t")))
    at = lambda v: F.least(F.floor(-F.expm1(-v["x"] * F.exp(-v["r"] * v["t"])) / F.lit(STEP)), F.lit((1 << 40) - 1))
    tag = lambda v: F.shiftrightunsigned(F.when(v["t"] == 0, v["f"]).otherwise(F.xxhash64(h, v["j"], v["t"], F.lit(2))), 15).bitwiseAND(F.lit(0xFFFF))
    made = F.transform(made, lambda v: F.struct(v["j"].alias("j"), at(v).alias("at"), tag(v).alias("tag")))
    made = F.filter(made, lambda v: v["at"] < F.shiftleft(m, 33))
    return F.transform(made, lambda v: _place(h, v["j"]).bitwiseOR(F.shiftleft(v["at"], 16)).bitwiseOR(v["tag"]))


def _drawn(m: Column) -> Column:
    """The packed samples below the limit m, sorted."""
    single = F.flatten(F.transform("_u", lambda h: F.transform(F.sequence(F.lit(0).cast("long"), m - 1), lambda j: _single(h, j))))
    both = F.when(F.size("_c") > 0, F.concat(single, F.flatten(F.transform("_c", lambda x: _counted(x, m))))).otherwise(single)
    return F.sort_array(both)


def signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array column out: for each position the 16-bit sample, or -1 where the text has no word."""
    n, none = F.size("_w"), F.array().cast("array<bigint>")
    df = df.withColumn("_w", F.transform(F.filter(F.split(F.col(text), SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    windows = F.transform(F.sequence(F.lit(1), n - WIDTH + 1), lambda i: F.xxhash64(F.slice("_w", i, F.lit(WIDTH))))
    whole = F.array(F.xxhash64("_w"))
    df = df.withColumn("_h", F.when(n >= WIDTH, windows).when(n > 0, whole).otherwise(none)).drop("_w")
    df = df.withColumn("_d", F.size(F.array_distinct("_h")) == F.size("_h"))
    # with repeated windows: positions in sorted order where a run of equal hashes begins, then run lengths
    df = df.withColumn("_h", F.when(F.col("_d"), F.col("_h")).otherwise(F.sort_array("_h")))
    starts = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: (i == 0) | (F.get("_h", i) != F.get("_h", i - 1)))
    df = df.withColumn("_s", F.when(~F.col("_d"), starts))
    term = lambda i, k: F.struct(F.get("_h", i).alias("h"), (F.coalesce(F.get("_s", k + 1), F.size("_h")) - i).alias("n"))
    df = df.withColumn("_s", F.transform("_s", term)).withColumn("_n", F.size("_h").cast("long"))
    df = df.withColumn("_u", F.when(F.col("_d"), F.col("_h")).otherwise(F.transform(F.filter("_s", lambda x: x["n"] == 1), lambda x: x["h"])))
    df = df.withColumn("_c", F.filter("_s", lambda x: x["n"] > 1)).drop("_h", "_s", "_d")
    limit = lambda k: F.least(F.ceil(F.lit(float(k * BINS)) / F.greatest("_n", F.lit(1))), F.lit(BINS)).cast("long")
    firsts = F.filter("_q", lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get("_q", i - 1), 56)))
    df = df.withColumn("_q", F.when(F.col("_n") > 0, _drawn(limit(ENOUGH)))).withColumn("_p", firsts)
    for m in (limit(3 * ENOUGH), F.lit(BINS).cast("long")):
        df = df.withColumn("_q", F.when(F.size("_p") < BINS, _drawn(m))).withColumn("_p", F.coalesce(firsts, "_p"))
    sample = F.transform("_p", lambda x: x.bitwiseAND(F.lit(0xFFFF)).cast("int"))
    return df.withColumn(out, F.coalesce(sample, F.array_repeat(F.lit(-1), BINS))).drop("_u", "_c", "_n", "_p", "_q")


def as_string(signature: Column) -> Column:
    """A signature as text: four hexadecimal digits a bin."""
    digits = lambda x: F.when(x < 0, F.lit(EMPTY)).otherwise(F.lower(F.lpad(F.hex(x.cast("long")), 4, "0")))
    return F.array_join(F.transform(signature, digits), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimate of generalised Jaccard similarity from two signatures."""
    pair = F.zip_with(a, b, lambda x, y: F.when((x < 0) & (y < 0), F.lit(0)).when(x == y, F.lit(10_001)).otherwise(F.lit(10_000)))
    total = F.aggregate(pair, F.lit(0), lambda s, x: s + x)
    return F.when(total == 0, F.lit(1.0)).otherwise((total % 10_000) / F.floor(total / 10_000))


def _below(ids: list[int], key: str, df: DataFrame, out: str) -> DataFrame:
    """Adds out: how many of the sorted ids are less than the column key, by halving."""
    df = df.withColumn(out, F.lit(0))
    listed = F.split(F.lit(",".join(map(str, ids))), ",").cast("array<bigint>")
    for step in reversed(range(len(ids).bit_length())):
        ahead = F.col(out) + F.lit(1 << step)
        df = df.withColumn(out, F.when((ahead <= len(ids)) & (F.get(listed, F.least(ahead, F.lit(len(ids))) - 1) < F.col(key)), ahead).otherwise(F.col(out)))
    return df


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with signature, and next, a struct (text, signature) of the row that follows in descending order of id.

    After the last row comes the first. Ids are cut into stretches at ids picked by hash, about 20 for a
    stretch, of which every 20th is a cut; the ids up to a cut make a stretch, so the row that follows a
    stretch is the cut below it: rows of that id go to both stretches, rows of the greatest id to the
    lowest one as well. Each text is shuffled once.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_key"))
    rows, size, top = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text")), F.max("_key")).first()
    parts = int(min(max(1, (size or 0) // PART), MOST_PARTS))
    every = max(1, rows // (20 * STRETCHES * parts))
    picked = docs.where(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).select("_key").distinct().collect() if parts > 1 else []
    cuts = sorted(r[0] for r in picked)[19::20]
    placed = _below(cuts, "_key", docs, "_at")
    listed = F.split(F.lit(",".join(map(str, cuts)) or "0"), ",").cast("array<bigint>")
    place = lambda at, real, again: F.struct(at.alias("at"), F.lit(real).alias("real"), F.lit(again).alias("again"))
    is_cut = (F.col("_at") < len(cuts)) & (F.get(listed, F.least(F.col("_at"), F.lit(max(0, len(cuts) - 1)))) == F.col("_key"))
    places = F.array(place(F.col("_at"), True, False), F.when(is_cut, place(F.col("_at") + 1, False, False)), F.when(F.col("_key") == top, place(F.lit(0), False, True)))
    spread = placed.withColumn("_p", F.explode(F.array_compact(places))).select("doc_id", "text", "_key", F.col("_p.at").alias("_at"), F.col("_p.real").alias("_real"), F.col("_p.again").alias("_again"))
    order = Window.partitionBy("_at").orderBy("_again", F.col("_key").desc(), "text")
    out = signature(spread.repartition(parts, "_at"), "text", "signature")
    out = out.withColumn("next", F.lead(F.struct("text", "signature")).over(order)).where("_real")
    return out.drop("_key", "_at", "_real", "_again")


def op10_fingerprint(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", 1, F.col("n_chars").cast("int") - half), F.substring(F.col("next.text"), 1, half))
    d = d.withColumn("edited", edited).withColumn("next_signature", F.col("next.signature")).drop("next", "text")
    d = signature(d, "edited", "edited_signature")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("signature")).alias("fingerprint"),
        as_string(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
