"""Quality rules with robust multivariate outliers, in DataFrame expressions alone.

Every text is described by a few statistics. Two fixed rules come first (too few words, mostly repeated
words). The rest is judged by language and source, by a minimum-covariance-determinant estimate of centre
and spread. So that no dense cluster of junk makes the half of least determinant by its density alone, the
search works on cells, twice the least spread wide in every statistic: a cell stands for the mean of its rows and
weighs as a power below 1 of their number. Several starts (medians and quartiles; all cells drawn onto a sphere
around the medians; a few cells, picked by hash) take concentration steps, each keeping the half of the group's
weight that is nearest by the estimate before, until the half, or its determinant, changes no more; the least
determinant wins. A last step keeps all rows, each counted once, that are near by that estimate. A
squared Mahalanobis distance beyond a chi-square quantile rejects.

A group's estimate is drawn towards that of its language as if ``PRIOR`` rows of the language's kind lay in
the group, and the language's (estimated in the same way from all of its rows) towards that of all languages' near rows, so that
groups of any size are judged alike.

All sums behind the estimates are sums of integers (statistics in units of 1/1024, cut off at 8), so that they
do not depend on the order of addition, and groups of any size are aggregated before they are shuffled.

Defined results: a null text has no words; null languages and sources form groups of their own; with no
estimate at all a row is kept; repeated rows get equal verdicts; an empty table gives an empty result; other
columns are carried untouched by ``quality_filter``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.session import stage, table

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
UNIT, MOST = 1024, 8
#: Statistics that the estimate sees, and the least standard deviation granted to each.
STATS = {"word_length": 0.12, "symbols": 0.05, "lines": 0.10, "repeats": 0.10, "capitals": 0.06}
#: Rows of its language's kind that a group's estimate is mixed with.
PRIOR = 500
#: Hashed starts, and cells in each of them.
HASHED, CELLS_EACH = 4, 12
#: A cell's width in least spreads, and its weight: of one row, and the power by which it grows with its rows. A power
#: as low as 1/2 takes the weight from the dense middle of good rows as well, so that scattered junk counts for much.
WIDE, WEIGHT, POWER = 2, 16, 0.75
#: Good rows that the last step keeps, and good rows that are not rejected.
NEAR_LEVEL, LEVEL = 0.975, 0.99999
#: Groups up to which their estimates are broadcast; more are joined by a salted shuffle.
BROADCAST_GROUPS = 50_000
SALTS = 16


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an odd number of degrees."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for k in range(1, degrees, 2):
        total += term
        term *= x / (k + 2)
    return math.erf(math.sqrt(x / 2)) - total


def quantile(level: float, degrees: int = len(STATS)) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < level else (low, middle)
    return low


def consistency(level: float, degrees: int = len(STATS)) -> float:
    """What the covariance of the nearest part (level) of normal rows is multiplied with to be that of all."""
    return level / chi_square(quantile(level, degrees), degrees + 2)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("ws", _words(text)).withColumn("n_words", F.size("ws").cast("long"))
    d = d.withColumn("lines", F.filter(F.split(text, "\n"), lambda s: s.rlike(WORD)))
    # each window of three words as (hash, position) in one sorted array: equal windows are neighbours
    window = lambda i: F.struct(F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)).alias("h"), i.alias("i"))
    d = d.withColumn("wins", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), window))))
    same = lambda x, i: (x["h"] == F.get("wins", i - 1)["h"]) | (x["h"] == F.get("wins", i + 1)["h"])
    again = F.transform(F.filter("wins", same), lambda x: x["i"])
    covered = F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2))))
    return d.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "n_words",
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("wins").isNotNull(), covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def _statistics() -> dict[str, Column]:
    """Transformed statistics in whole units of 1 / UNIT."""
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    raw = {
        "word_length": F.log(part("word_chars", "n_words") + F.lit(0.01)),
        "symbols": F.sqrt(part("n_symbols", "word_chars")),
        "lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "capitals": part("n_capitals", "word_chars"),
    }
    return {k: F.round(F.greatest(F.least(v, F.lit(float(MOST))), F.lit(-float(MOST))) * UNIT).cast("long") for k, v in raw.items()}


NAMES = list(STATS)
PAIRS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
SUMS = [f"t_{a}" for a in NAMES] + [f"t_{a}_{b}" for a, b in PAIRS]
#: Level 0: language and source; level 1: language (g_source null).
GROUP = ["level", "g_lang", "g_source"]
PLACE = ["g_lang", "g_source"]


def _join(rows: DataFrame, small: DataFrame, few: bool, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """rows with the columns of their group (null-safe); few: small is short enough to be broadcast."""
    keys = keys or GROUP
    named = small.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    if few:
        out = rows.join(F.broadcast(named), same, how)
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[f"s_{k}" for k in NAMES]), F.lit(SALTS)).cast("int"))
        many = named.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(many, same & (F.col("_salt") == F.col("_salt2")), how).drop("_salt", "_salt2")
    return out.drop(*[f"_{k}" for k in keys])


def moments(kept: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """One row a group: n and the sums of the statistics and of their products, each row counted by its weight (1)."""
    w = F.lit(1) if weight is None else weight
    sums = [F.sum(w * F.col(f"s_{a}")).alias(f"t_{a}") for a in NAMES] + [F.sum(w * F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"t_{a}_{b}") for a, b in PAIRS]
    return kept.groupBy(*keys).agg(F.sum(w).cast("long").alias("n"), *sums)


def cells(rows: DataFrame) -> DataFrame:
    """(level, g_lang, g_source, s_..., w): the occupied cells of every group, with their means and weights."""
    at = {a: F.floor(F.col(f"s_{a}") / (UNIT * STATS[a] * WIDE)).cast("int").alias(f"c_{a}") for a in NAMES}
    sums = rows.groupBy(*GROUP, *at.values()).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s_{a}").alias(f"t_{a}") for a in NAMES])
    return sums.select(*GROUP, *[F.round(F.col(f"t_{a}") / F.col("n")).cast("long").alias(f"s_{a}") for a in NAMES], F.round(F.pow("n", F.lit(POWER)) * WEIGHT).cast("long").alias("w"))


def quartiles_of(found: DataFrame) -> DataFrame:
    """(level, g_lang, g_source, size, cells, q_...) of a table of cells: their weight, number, and (25, 50, 75) of each statistic in eighths of units."""
    quarters = [F.expr(f"percentile(floor(s_{a} / 8), array(0.25, 0.5, 0.75), w)").alias(f"q_{a}") for a in NAMES]
    return found.groupBy(*GROUP).agg(F.sum("w").alias("size"), F.count(F.lit(1)).alias("cells"), *quarters)


def shaped(t: DataFrame, spread: float) -> DataFrame:
    """From n and sums: centre, the lower triangle of the covariance's Cholesky factor, its log determinant, and a mark of the sums."""
    keys = [c for c in t.columns if c not in ("n", *SUMS)]
    n = F.col("n").cast("double")
    t = t.withColumns({f"m_{a}": F.col(f"t_{a}").cast("double") / n / UNIT for a in NAMES})
    # row by row; the least spread of each statistic, added to its variance, keeps the matrix regular in every direction
    # (as regularized variants do): without it a few rows beside many copies of one have no determinant at all
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            cov = (F.col(f"t_{a}_{b}").cast("double") / n / UNIT**2 - F.col(f"m_{a}") * F.col(f"m_{b}")) * spread
            if a == b:
                cov = F.greatest(cov, F.lit(0.0)) + F.lit(STATS[a] ** 2)
            left = reduce(lambda x, k: x - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}"), NAMES[:j], cov)  # noqa: B023
            t = t.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(left, F.lit(1e-9))) if a == b else left / F.col(f"l_{b}_{b}"))
    centre, factor = F.array(*[f"m_{a}" for a in NAMES]), F.array(*[f"l_{a}_{b}" for a, b in PAIRS])
    log_det = reduce(lambda x, y: x + y, [F.log(f"l_{a}_{a}") for a in NAMES])
    return t.select(*keys, "n", centre.alias("centre"), factor.alias("factor"), log_det.alias("log_det"), F.xxhash64("n", *SUMS).alias("mark"))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the columns centre and factor of a row (null without)."""
    at, total = 0, F.lit(0.0)
    for i, a in enumerate(NAMES):
        z = F.col(f"s_{a}") / UNIT - F.get("centre", F.lit(i))
        for j in range(i):
            z = z - F.get("factor", F.lit(at + j)) * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", z / F.get("factor", F.lit(at + i)))
        at, total = at + i + 1, total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return rows.withColumn("d2", total).drop(*[f"z_{i}" for i in range(len(NAMES))])


def concentrated(found: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """One step for the groups and starts of now (size, centre, factor): the estimate of the nearest half of each, of a table of cells.

    Distances are told apart in steps of 1/64 of ln(1 + d2); the cells of the step that makes up half are all kept.
    """
    by = [*GROUP, "start"]
    placed = _with_distance(_join(found, now.select(*by, "size", "centre", "factor"), few)).withColumn("bin", F.floor(F.log1p("d2") * 64).cast("int"))
    placed = placed.drop("centre", "factor", "d2")
    counts = placed.groupBy(*by, "bin").agg(F.sum("w").alias("c"), F.first("size").alias("size"))
    so_far = F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))
    # the least spreads keep any half regular, so that it need not be larger for the number of statistics
    half = F.floor(F.col("size") / 2) + 1
    limits = counts.withColumn("reached", so_far >= F.least(half, F.col("size"))).groupBy(*by).agg(F.min(F.when(F.col("reached"), F.col("bin"))).alias("limit"))
    kept = _join(placed, limits, few, by).where("bin <= limit")
    made = shaped(moments(kept, by, F.col("w")), consistency(0.5))
    return _join_back(made, now)


def _join_back(made: DataFrame, now: DataFrame) -> DataFrame:
    """made with the size of its group, and the log determinant and mark of the step before."""
    before = now.select(*[F.col(k).alias(f"_{k}") for k in [*GROUP, "start"]], "size", F.col("log_det").alias("before"), F.col("mark").alias("mark_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*GROUP, "start"]])
    return made.join(before, same).drop(*[f"_{k}" for k in [*GROUP, "start"]])


def starts(found: DataFrame, quartiles: DataFrame, few: bool) -> DataFrame:
    """(g_lang, g_source, start, size, centre, factor, log_det, mark) of all starts, from the cells and their quartiles."""
    middle = lambda a: F.get(f"q_{a}", F.lit(1)) * 8 / UNIT
    scale = lambda a: F.greatest((F.get(f"q_{a}", F.lit(2)) - F.get(f"q_{a}", F.lit(0))) * 8 / UNIT / 1.349, F.lit(STATS[a]))
    diagonal = F.array(*[scale(a) if a == b else F.lit(0.0) for a, b in PAIRS])
    first = quartiles.select(*GROUP, F.lit(0).alias("start"), F.col("size").alias("n"), F.array(*[middle(a) for a in NAMES]).alias("centre"), diagonal.alias("factor"), F.lit(1e9).alias("log_det"), F.lit(0).cast("long").alias("mark"))
    x = _join(found, quartiles, few)
    # all cells on a sphere around the medians: far ones weigh no more than near ones
    z = {a: (F.col(f"s_{a}") / UNIT - middle(a)) / scale(a) for a in NAMES}
    sphere = x.withColumns({f"z_{a}": v for a, v in z.items()})
    length = F.sqrt(reduce(lambda p, q: p + q, [F.col(f"z_{a}") * F.col(f"z_{a}") for a in NAMES]) / len(NAMES))
    sphere = sphere.withColumn("length", F.greatest(length, F.lit(1e-6)))
    drawn = sphere.select(*GROUP, F.lit(1).alias("start"), "w", *[F.round((middle(a) + scale(a) * F.col(f"z_{a}") / F.col("length")) * UNIT).cast("long").alias(f"s_{a}") for a in NAMES])
    picked = F.filter(F.array(*[F.lit(k) for k in range(2, 2 + HASHED)]), lambda k: F.pmod(F.xxhash64(k, *[f"s_{a}" for a in NAMES]), F.ceil(F.col("cells") / CELLS_EACH)) == 0)
    parts = x.select(*GROUP, F.explode(picked).alias("start"), "w", *[f"s_{a}" for a in NAMES])
    made = shaped(moments(drawn.unionByName(parts), [*GROUP, "start"], F.col("w")), 1.0)
    both = first.unionByName(made).drop("n")
    return _join(both, quartiles.select(*GROUP, "size"), few) if few else both.join(quartiles.select(F.col("level").alias("_v"), F.col("g_lang").alias("_l"), F.col("g_source").alias("_s"), "size"), (F.col("level") == F.col("_v")) & F.col("g_lang").eqNullSafe(F.col("_l")) & F.col("g_source").eqNullSafe(F.col("_s"))).drop("_v", "_l", "_s")


def half_estimates(found: DataFrame, few: bool, quartiles: DataFrame) -> DataFrame:
    """(g_lang, g_source, start, centre, factor, log_det) of the least determinant for each group of a table of cells."""
    by = [*GROUP, "start", "size", "centre", "factor", "log_det", "mark"]
    now, done = stage(starts(found, quartiles, few).select(*by), "starts"), []
    while not now.isEmpty():
        made = stage(concentrated(found, now, few), "step")
        # a start is done when the same half comes out again, or one that is no narrower; every other one has narrowed
        ended = (F.col("mark") == F.col("mark_before")) | (F.col("log_det") > F.col("before") - 1e-6)
        done.append(made.where(ended).select(*by))
        now = made.where(~ended).select(*by)
    every = reduce(lambda a, b: a.unionByName(b), done) if done else now
    best = every.groupBy(*GROUP).agg(F.min_by(F.struct("start", "size", "centre", "factor", "log_det", "mark"), F.struct("log_det", "start")).alias("e"))
    return stage(best.select(*GROUP, "e.*"), "half")


def estimates(stats: DataFrame) -> DataFrame:
    """(g_lang, g_source, centre, factor) for each language and source of a table (lang, source, s_...)."""
    group = lambda level, source: F.struct(F.lit(level).alias("level"), F.col("lang").alias("g_lang"), source.alias("g_source"))
    levels = F.explode(F.array(group(0, F.col("source")), group(1, F.lit(None).cast("string"))))
    rows = stats.withColumn("g", levels).select("g.*", *[f"s_{a}" for a in NAMES])
    found = stage(cells(rows), "cells")
    quartiles = stage(quartiles_of(found), "quartiles")
    few = quartiles.count() * (2 + HASHED) <= BROADCAST_GROUPS
    halves = half_estimates(found, few, quartiles)
    near = _with_distance(_join(rows, halves.select(*GROUP, "centre", "factor"), few)).where(F.col("d2") <= quantile(NEAR_LEVEL))
    own = stage(moments(near, GROUP), "near")
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("n", *SUMS)]
    of_lang = own.where("level = 1")
    every = of_lang.agg(*sums)
    mixed = lambda of, above: [(F.col(c) + PRIOR * F.col(f"{above}.{c}") / F.col(f"{above}.n")).alias(c) for c in ("n", *SUMS)]
    packed = lambda df, name, *keys: df.select(*keys, F.struct("n", *SUMS).alias(name))
    # one row of sums of all groups
    langs = of_lang.crossJoin(F.broadcast(packed(every, "every")))
    langs = langs.select(F.col("g_lang").alias("l_lang"), *mixed("lang", "every"))
    groups = own.where("level = 0").join(packed(langs, "above", "l_lang"), F.col("g_lang").eqNullSafe(F.col("l_lang")))
    return stage(shaped(groups.select(*PLACE, *mixed("own", "above")), consistency(NEAR_LEVEL)).select(*PLACE, "centre", "factor"), "estimates")


def verdicts(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(row, n_words ... n_capitals, base_failed, distance, kept); row holds the carried columns of docs (all)."""
    carried = docs.columns if carried is None else carried
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("lang"), F.col("source"), F.col("text"))
    stats = base_columns(packed).drop("text")
    stats = stage(stats.withColumns({f"s_{k}": v for k, v in _statistics().items()}), "quality")
    groups = estimates(stats.where("n_words > 0"))
    near = stats.withColumns({"g_lang": F.col("lang"), "g_source": F.col("source")})
    out = _with_distance(_join(near, groups, groups.count() <= BROADCAST_GROUPS, PLACE, "left"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("distance", F.col("d2"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= quantile(LEVEL), F.lit(True)))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass."""
    return verdicts(docs).where("kept").select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
