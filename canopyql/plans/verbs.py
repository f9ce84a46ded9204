"""Questions about an indexed repository, as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyql.operators import governance, resolve
from canopyql.session import stage

#: Pairs of notes and symbols that a task makes, or so, and tasks at most.
PAIRS, MOST_TASKS = 2_000_000, 65_536


def find_symbol(symbols: DataFrame, name: str, most: int = 10) -> DataFrame:
    """The definitions of a name, or the first that contain it in any case; column exact says which."""
    exact = symbols.where(F.col("n") == name).withColumn("exact", F.lit(True))
    if not exact.isEmpty():
        return exact
    return symbols.where(F.lower("n").contains(name.lower())).orderBy("sym_id").limit(most).withColumn("exact", F.lit(False))


def linked(edges: DataFrame, ids: DataFrame, end: str) -> DataFrame:
    """The edges whose end is among ids (sym_id); these are broadcast if they are few, as a name may have any number of definitions."""
    at = ids.select(F.col("sym_id").alias(end))
    return edges.join(F.broadcast(at) if at.count() <= resolve.BROADCAST_NAMES else at, end, "left_semi")


def with_confidence(rows: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    """rows with conf, how far the links of the symbol at the column end can be trusted: see ``score.confidence``."""
    return rows.join(labels.select(F.col("sym_id").alias(end), "conf"), end, "left")


def answer(rows: DataFrame, symbols: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """One row about an answer to a question about a name: (name, n, defs, conf).

    n counts the rows; conf is that of the name's first definition, and ``none`` where a name with several definitions
    has no rows, which then does not mean that it is not used.
    """
    defs = symbols.where(F.col("n") == name).agg(F.count(F.lit(1)).alias("defs"), F.min("sym_id").alias("sym_id"))
    x = defs.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).join(labels, "sym_id", "left")
    conf = F.when((F.col("defs") > 1) & (F.col("n") == 0), "none").when(F.col("defs") > 1, "low").otherwise(F.col("conf"))
    return x.select(F.lit(name).alias("name"), "n", "defs", conf.alias("conf"))


def _met(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """(note_id, sym_id, priority): asked (kind, value, note_id, priority, sym, file) joined with the symbols of that name or path.

    Rows out may be very many more than rows in, so that the tasks' number follows from them: PAIRS in a task or so. The pairs of a key
    of more are dealt over a grid, its notes over the rows, its symbols over the columns, with as many rows as make the
    copies fewest: about 2 for every sqrt(PAIRS) pairs. Copies carry no more than the one value that may pass over a pair:
    a name match after a file's, or a file's after the first name's.
    """
    asked = asked.select("kind", "value", "note_id", "priority", F.when(F.col("kind") == "p", F.col("sym")).when(F.col("priority") > 2, F.col("file")).alias("passed"))
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("s_kind"), F.col(k).alias("s_value"), F.col(o).alias("other")) for k, o in (("n", "p"), ("p", "n"))]))
    s = symbols.select("sym_id", of.alias("k")).select("k.*", "sym_id").where("s_value IS NOT NULL")
    counts = asked.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("a")).join(s.groupBy(F.col("s_kind").alias("kind"), F.col("s_value").alias("value")).agg(F.count(F.lit(1)).alias("b")), ["kind", "value"])
    cells = F.ceil(F.col("a") * F.col("b") / PAIRS)
    high = F.least("a", "cells", F.greatest(F.lit(1), F.round(F.sqrt(F.col("cells") * F.col("a") / F.col("b")))))
    counts = counts.withColumn("cells", cells).withColumn("high", high.cast("int"))
    counts = stage(counts.select("kind", "value", (F.col("a") * F.col("b")).alias("pairs"), "cells", "high", F.least("b", F.ceil(F.col("cells") / F.col("high"))).cast("int").alias("wide")), "counts")
    tasks = int(min(max(1, -(-(counts.agg(F.sum("pairs")).first()[0] or 0) // PAIRS)), MOST_TASKS))
    large = F.broadcast(counts.where("cells > 1").select("kind", "value", "high", "wide"))
    high, wide = F.coalesce("high", F.lit(1)), F.coalesce("wide", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    a = asked.join(large, ["kind", "value"], "left").withColumn("row", F.pmod(F.xxhash64("note_id"), high).cast("int")).withColumn("column", every(wide)).drop("high", "wide")
    b = s.join(large.select(F.col("kind").alias("s_kind"), F.col("value").alias("s_value"), "high", "wide"), ["s_kind", "s_value"], "left")
    b = b.withColumn("s_column", F.pmod(F.xxhash64("sym_id"), wide).cast("int")).withColumn("s_row", every(high)).drop("high", "wide")
    keys = ["kind", "value", "row", "column"]
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"s_{k}") for k in keys])
    met = a.repartition(tasks, *keys).join(b.repartition(tasks, *[f"s_{k}" for k in keys]).hint("merge"), same)
    return met.where(~F.coalesce(F.col("other") == F.col("passed"), F.lit(False))).select("note_id", "sym_id", "priority")


def bind_notes(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(note_id, sym_id, priority): 1 by symbol, 2 by file, 3 by relation, 4 by alias; the best counts.

    Whether a pair has been met by a better way shows in its note and symbol, so that the pairs are never shuffled or grouped,
    but for notes and symbols whose id several rows have.
    """
    notes = notes.select("note_id", "sym", "file", "rel", "alias")
    symbols = symbols.select("sym_id", "n", "p").where("n IS NOT NULL OR p IS NOT NULL")
    differ = lambda c, *others: reduce(lambda a, b: a & b, [~F.col(c).eqNullSafe(F.col(o)) for o in others])
    way = lambda kind, c, i, when=None: F.when(F.col(c).isNotNull() & (F.lit(True) if when is None else when), F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value"), F.lit(i).alias("priority")))
    ways = F.array_compact(F.array(way("n", "sym", 1), way("p", "file", 2), way("n", "rel", 3, differ("rel", "sym")), way("n", "alias", 4, differ("alias", "sym", "rel"))))
    asked = notes.select("note_id", "sym", "file", F.explode(ways).alias("k")).select("k.*", "note_id", "sym", "file")
    again = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col(key).alias(f"again_{key}"))
    twice = {key: stage(again(df, key), "twice") for df, key in ((notes, "note_id"), (symbols, "sym_id"))}
    if all(t.isEmpty() for t in twice.values()):
        return _met(asked, symbols)
    split = lambda df, key, how: df.join(twice[key], F.col(key).eqNullSafe(F.col(f"again_{key}")), how)
    once = split(symbols, "sym_id", "left_anti")
    plain = _met(split(asked, "note_id", "left_anti"), once)
    rest = _met(split(asked, "note_id", "left_semi"), symbols).union(_met(split(asked, "note_id", "left_anti"), split(symbols, "sym_id", "left_semi")))
    return plain.union(rest.groupBy("note_id", "sym_id").agg(F.min("priority").alias("priority")))


def filter_notes(notes: DataFrame, sym: str | None = None, file: str | None = None, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Notes about a symbol (or related to it), about files below a prefix, of a kind, with a text in any case; what is not asked for is not tested."""
    if sym is not None:
        notes = notes.where((F.col("sym") == sym) | (F.col("rel") == sym))
    if file is not None:
        notes = notes.where(F.col("file").startswith(file))
    if kind is not None:
        notes = notes.where(F.col("kind") == kind)
    return notes if text is None else notes.where(F.lower("note").contains(text.lower()))


def drifted_notes(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Notes that name a symbol or file that no longer exists."""
    a = notes.where("sym IS NOT NULL").join(symbols.select(F.col("n").alias("sym")), "sym", "left_anti").select(notes.columns)
    b = notes.where("file IS NOT NULL").join(symbols.select(F.col("p").alias("file")), "file", "left_anti").select(notes.columns)
    return a.union(b).dropDuplicates(["note_id"])


def context_counts(symbols: DataFrame, edges: DataFrame, types: DataFrame, notes: DataFrame, name: str) -> DataFrame:
    """One row about all definitions of a name: how many there are and what is linked to them."""
    ids = symbols.where(F.col("n") == name).select("sym_id")
    calls, docs = edges.where("prov <> 'doc'"), edges.where("prov = 'doc'")

    def near(e: DataFrame, end: str, out: str) -> DataFrame:
        return linked(e, ids, end).agg(F.count(F.lit(1)).alias(out))

    about = notes.where((F.col("sym") == name) | (F.col("rel") == name))
    parts = [ids.agg(F.count(F.lit(1)).alias("defs")), near(calls, "dst", "callers"), near(calls, "src", "callees"), near(types, "dst", "type_in"), near(types, "src", "type_out"), near(docs, "dst", "doc_mentions"), about.agg(F.count(F.lit(1)).alias("notes"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def violations(deps: DataFrame, requires: DataFrame) -> DataFrame:
    """(rule, file, detail, module, fp) of dependencies that are not declared and of links past entry points."""
    allowed = requires.select(F.col("module").alias("a"), F.col("required").alias("b"))
    arrow = lambda n: F.concat("a", F.lit(" -> "), "b", F.lit(" ("), F.col(n).cast("string"), F.lit(")"))
    undeclared = deps.join(allowed, ["a", "b"], "left_anti").select(F.lit("module-dependency").alias("rule"), F.col("sample").alias("file"), arrow("n").alias("detail"), F.col("a").alias("module"))
    deep = deps.where("deep > 0").select(F.lit("deep-import").alias("rule"), F.col("deep_sample").alias("file"), arrow("deep").alias("detail"), F.col("a").alias("module"))
    out = undeclared.union(deep)
    return out.withColumn("fp", governance.fingerprint(F.col("rule"), F.col("file"), F.col("detail")))
