"""Scores and rankings: hubs, normalisation, collapse, text lens, token budget, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.functions import paths

# Names so common that links to them say little.
GENERIC = (
    "len push pop is_empty empty kind new from_json to_json json parse serialize deserialize get set add remove update create delete "
    "as_str to_string clone default unwrap collect iter iter_mut map filter find insert contains from into main init next some ok err format "
    "print log run index count items keys values entry first last text path file read write open close data value name type size string number "
    "boolean object array status message args"
).split()
# Weights of kinds; any other kind weighs UNKNOWN_KIND.
KINDS = {"fn": 1.0, "method": 1.0, "class": 1.0, "iface": 1.0, "struct": 1.0, "enum": 1.0, "trait": 1.0, "impl": 0.9, "type": 0.9, "macro": 0.85, "const": 0.8, "mod": 0.7, "var": 0.4, "field": 0.0, "prop": 0.0, "variant": 0.0, "sec": 0.0, "doc": 0.0}
UNKNOWN_KIND = 0.5


@dataclass(frozen=True)
class HubConfig:
    whitelist: tuple[str, ...] = ()
    generic_damp: float = 0.15
    test_damp: float = 0.5
    vendor_damp: float = 0.2  # read and passed on, without effect on scores


def kind_weight(kind: Column) -> Column:
    known = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), kind)
    return F.coalesce(known, F.lit(UNKNOWN_KIND))


def hub_scores(symbols: DataFrame, calls: DataFrame, config: HubConfig = HubConfig()) -> DataFrame:
    """(sym_id, n, t, p, and all factors, score) of the symbols that can be hubs."""
    same_name = symbols.groupBy("n").agg(F.count(F.lit(1)).alias("amb"))
    s = symbols.select(F.col("sym_id").alias("src"), F.col("p").alias("s_p"))
    d = symbols.select(F.col("sym_id").alias("dst"), F.col("p").alias("d_p"))
    weight = F.when(F.col("s_p") == F.col("d_p"), 0.7).otherwise(1.0) * F.when(paths.is_test(F.col("s_p")), config.test_damp).otherwise(1.0)
    # whole millionths: the sum does not depend on its order
    incoming = calls.select("src", "dst").join(s, "src").join(d, "dst").groupBy("dst").agg((F.sum(F.round(weight * 1e6).cast("long")) / F.lit(1e6)).alias("win"), F.count(F.lit(1)).alias("callers"), F.count_distinct("s_p").alias("caller_files"))
    able = symbols.where(~F.col("t").isin("sec", "doc") & ~F.coalesce("local", F.lit(False)) & ~paths.is_vendor(F.col("p")))
    x = able.join(incoming, F.col("sym_id") == F.col("dst")).join(same_name, "n")
    generic = F.col("n").isin(GENERIC)
    if config.whitelist:
        generic = generic & ~F.col("n").isin(*config.whitelist)
    x = x.select(
        "sym_id", "n", "t", "p", "l", "win", "callers", "caller_files", "amb",
        (F.col("win") / F.col("amb")).alias("norm"),
        kind_weight(F.col("t")).alias("k"),
        F.when(paths.is_test(F.col("p")), config.test_damp).otherwise(1.0).alias("pw"),
        F.when(generic, config.generic_damp).otherwise(1.0).alias("nw"),
        F.when(F.coalesce(F.col("el") - F.col("l") + 1, F.lit(1)) < 3, 0.7).otherwise(1.0).alias("sw"),
        F.when(F.col("caller_files") >= 3, 1.15).when(F.col("caller_files") == 2, 1.0).otherwise(0.85).alias("bw"),
    )
    return x.withColumn("score", F.col("norm") * F.col("k") * F.col("pw") * F.col("nw") * F.col("sw") * F.col("bw"))


def ordered(column: str, collation: str | None = None) -> Column:
    """A column to sort by: in binary order, or as a collation (such as ``UNICODE``) has it, equal ones in binary order."""
    return F.col(column) if collation is None else F.struct(F.collate(F.col(column), collation).alias("k"), F.col(column).alias("v"))


def hub_ranking(scores: DataFrame, top: int = 25, collation: str | None = None) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), ordered("n", collation), "sym_id").limit(top)


def hub_norm(scores: DataFrame) -> DataFrame:
    """(sym_id, norm): log1p(score) over log1p of the largest score."""
    most = scores.agg(F.max("score").alias("most"))
    part = F.when(F.col("most") > 0, F.log1p(F.greatest(F.col("score"), F.lit(0.0))) / F.log1p("most")).otherwise(0.0)
    return scores.crossJoin(F.broadcast(most)).select("sym_id", part.alias("hub_norm"))


def collapse(scores: DataFrame) -> DataFrame:
    """The best row of each name; amb is how many definitions the name has."""
    first = Window.partitionBy("n").orderBy(F.col("score").desc(), "sym_id")
    return scores.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def lens(symbols: DataFrame, query: str, norms: DataFrame, churn: DataFrame) -> DataFrame:
    """Symbols that answer a query, with rank: names 12 (equal) or 8 (contained), path 4, doc 3, signature 2 a term."""
    terms = terms_of(query)
    joined = symbols.join(norms, "sym_id", "left").join(churn.withColumnRenamed("path", "p"), "p", "left")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    points = F.lit(0.0)
    for t in terms:  # repeated terms count again
        points = points + F.when(low("n") == t, 12.0).when(low("n").contains(t), 8.0).otherwise(0.0)
        points = points + F.when(low("p").contains(t), 4.0).otherwise(0.0) + F.when(low("doc").contains(t), 3.0).otherwise(0.0) + F.when(low("sig").contains(t), 2.0).otherwise(0.0)
    x = joined.withColumn("points", points)
    bonus = 1.5 * F.coalesce("hub_norm", F.lit(0.0)) + 0.02 * F.coalesce("churn", F.lit(0))
    if not terms:
        return x.withColumn("rank", F.lit(0.0))
    return x.where("points > 0").withColumn("rank", F.col("points") + bonus)


def lens_top(found: DataFrame, top: int = 12, collation: str | None = None) -> DataFrame:
    """Three times as many rows as asked for, then the first of each name, then the cut: the order matters."""
    order = [F.col("rank").desc(), ordered("p", collation), F.col("l"), F.col("sym_id")]
    wide = found.orderBy(*order).limit(3 * top)
    first = Window.partitionBy("n").orderBy(*order)
    one = wide.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return one.orderBy(*order).limit(top)


def within_budget(rows: DataFrame, estimate: Column, budget: int, reserved: int = 16) -> DataFrame:
    """The leading rows (by position) whose running estimate fits; the first row always stays. rows: a bounded report."""
    w = Window.orderBy("position")
    used = rows.withColumn("used", F.sum(estimate).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + reserved)
    over = F.max(F.col("used") > budget).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return used.withColumn("over", over).where(~F.col("over") | (F.col("position") == 1)).drop("over")


def confidence(symbols: DataFrame, incoming: DataFrame, config: HubConfig = HubConfig()) -> DataFrame:
    """(sym_id, conf): ``none`` or ``low`` for ambiguous names, ``low`` for generic ones, else null. incoming: (dst, n_in)."""
    amb = symbols.groupBy("n").agg(F.count(F.lit(1)).alias("amb"))
    x = symbols.join(amb, "n").join(incoming.select(F.col("dst").alias("sym_id"), "n_in"), "sym_id", "left")
    n = F.coalesce("n_in", F.lit(0))
    generic = F.col("n").isin(GENERIC) & ~F.col("n").isin(*(config.whitelist or ("",)))
    scored = (n > 0) & ~F.col("t").isin("sec", "doc") & ~F.coalesce("local", F.lit(False)) & ~paths.is_vendor(F.col("p"))
    return x.select("sym_id", F.when((F.col("amb") > 1) & (n == 0), "none").when((F.col("amb") > 1) | (generic & scored), "low").alias("conf"))


def ambiguity_groups(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, defs, refs, impls, docs, vendor_only) of names with several definitions."""
    g = symbols.groupBy(F.col("n").alias("name")).agg(
        F.count(F.lit(1)).alias("defs"),
        F.sum((F.col("t") == "impl").cast("int")).alias("impls"),
        F.sum((F.col("t") == "sec").cast("int")).alias("docs"),
        F.bool_and(paths.is_vendor(F.col("p"))).alias("vendor_only"),
    )
    return g.where("defs > 1").join(refs, "name", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


def group_members(symbols: DataFrame, incoming: DataFrame) -> DataFrame:
    """(n, sym_id, n_in, position) of every definition of an ambiguous name, the most referred to first; incoming: (dst, n_in)."""
    many = symbols.groupBy("n").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("n")
    x = symbols.select("sym_id", "n", "p", "l").join(many, "n").join(incoming.withColumnRenamed("dst", "sym_id"), "sym_id", "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    w = Window.partitionBy("n").orderBy(F.col("n_in").desc(), "p", "l", "sym_id")
    return x.select("n", "sym_id", "n_in", F.row_number().over(w).cast("long").alias("position"))


def terms_of(query: str) -> list[str]:
    """The terms of a question: runs of letters, digits, _ and $, in lower case."""
    return "".join(c if c.isalnum() or c in "_$" else " " for c in query.lower()).split()


def misses(symbols: DataFrame, query: str) -> DataFrame:
    """(term): the terms that are no symbol's name, in any case."""
    asked = symbols.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(terms_of(query))], "term string")
    return asked.join(symbols.select(F.lower("n").alias("term")), "term", "left_anti")


def positive(value, name: str) -> int:
    """A strictly positive whole number, from a number or its digits; ValueError for anything else."""
    text = str(value)
    if isinstance(value, bool) or not text.isascii() or not text.isdigit() or int(text) < 1:
        raise ValueError(f"{name} takes a positive whole number, not {value!r}")
    return int(text)
