"""Mixing sources to target weights.

One aggregate gives each source's size in words. Targets share a budget by weight; a target stops at a
ceiling of its source's size and what it leaves is shared again. A document is then emitted floor(rate)
times, and once more with probability rate - floor(rate), decided by a hash of its id.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source
without words has target 0 and emits each of its documents rate 0 times; rows that repeat an id are
decided alike; an empty table gives an empty result; further columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyql.operators.numbering import numbered
from canopyql.session import stage, table

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to which their table is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_SOURCES = 50_000
SALTS = 16


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """(source, source_size, target) for a table (source, source_size) of one row a source.

    The budget is shared by weight; sources whose share reaches their ceiling are full, and what they leave is
    shared among the rest by weight, until no further one is full: a source's target is then the lesser of
    its ceiling and level * weight. Each sharing is one aggregate over the sources; there are few of them, as
    the level rises and fills at least one source each time, and most of them in the first.
    """
    known = stage(sizes, "sources")
    t = numbered(known, [F.col("source").asc_nulls_last()], "at").where("source_size > 0")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    t = t.withColumn("weight", weight).withColumn("cap", F.lit(float(ceiling)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    t = stage(t.select(F.col("source").alias("t_source"), "source_size", "weight", "cap", "full_at"), "weights")
    total, of_weights, n = t.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    level, full = (float(share) * total / of_weights if n else 0.0), 0
    while n:
        is_full = F.col("full_at") <= level
        cap, weight_full, now = t.agg(F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if now in (full, n):
            break
        level, full = (float(share) * total - cap) / (of_weights - weight_full), now
    target = F.when(F.col("full_at") <= level, F.col("cap")).otherwise(F.lit(level) * F.col("weight"))
    out = known.join(t.select("t_source", target.alias("target")), F.col("source").eqNullSafe(F.col("t_source")), "left")
    return out.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def coin(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    hex13 = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hex13, 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """(row, doc_id, source, size, source_size, target, rate, copies); row holds the columns of docs."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    per_source = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, ceiling), "targets")
    small = per_source.select(F.col("source").alias("s_source"), "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("s_source"))
    if small.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(small), same)
    else:
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        many = small.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(many, same & (F.col("salt") == F.col("s_salt"))).drop("salt", "s_salt")
    rate = F.least(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(float(ceiling)))
    out = joined.drop("s_source").withColumn("rate", rate)
    extra = F.when(coin(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return out.withColumn("copies", (F.floor("rate") + extra).cast("int"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself: each document as often as its rate says, with the columns of docs."""
    return rates(docs, **how).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = rates(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), o AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS full_at FROM o WHERE source_size > 0
), l AS (
  SELECT *, row_number() OVER (ORDER BY full_at, idx) AS rk,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM c) - coalesce(sum(cap) OVER (ORDER BY full_at, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / ((SELECT sum(weight) FROM c) - coalesce(sum(weight) OVER (ORDER BY full_at, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own_level
  FROM c
), f AS (
  SELECT min(rk) AS rk, arg_min(own_level, rk) AS own_level FROM l WHERE own_level < full_at
), t AS (
  SELECT l.source, CASE WHEN f.rk IS NULL OR l.rk < f.rk THEN l.cap ELSE f.own_level * l.weight END AS target FROM l, f
), r AS (
  SELECT d.doc_id, d.size, s.source_size, coalesce(t.target, 0)::DOUBLE AS target,
         least(coalesce(t.target, 0)::DOUBLE / greatest(s.source_size, 1), 2.0::DOUBLE) AS rate,
         ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
