"""Digests of relations by path, directory and whole: two indexes are compared from the top down.

Each row of a relation adds to the digest of its path, of each directory above it, and of the whole (the empty
path): a count and two sums that do not depend on the order of rows. Equal digests end the descent, so that
equal trees cost one comparison a relation, and rows are read only for paths that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.session import stage

#: Differing nodes up to which they are broadcast to the rows.
BROADCAST_NODES = 200_000
_DIGEST = ["n", "mixed", "total"]


def digest_tree(rows: DataFrame) -> DataFrame:
    """(relation, node, up, depth, n, mixed, total) of rows (relation, path, key): node is a path, a directory, or empty."""
    of_path = rows.groupBy("relation", "path").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("relation", "path", "key")).alias("mixed"),
        F.sum(F.pmod(F.xxhash64("key", "path", F.lit(7)), F.lit(1 << 31))).alias("total"),
    )
    inside = paths.prefixes(paths.directory(F.col("path")))
    nodes = F.array_distinct(F.concat(F.array(F.lit("")), F.filter(inside, lambda x: x != ""), F.array("path")))
    x = of_path.select("relation", F.posexplode(nodes).alias("depth", "node"), "n", "mixed", "total", F.element_at(nodes, -1).alias("leaf"))
    up = F.when(F.col("depth") == 0, None).when(F.col("depth") == 1, "").otherwise(paths.directory(F.col("node")))
    sums = [F.sum("n").alias("n"), F.bit_xor("mixed").alias("mixed"), F.sum("total").alias("total"), F.max((F.col("node") == F.col("leaf")).cast("int")).alias("leaf")]
    return x.groupBy("relation", "node", "depth").agg(*sums).withColumn("up", up)


def differing_paths(here: DataFrame, there: DataFrame) -> DataFrame:
    """(relation, path) of the paths whose rows differ, from two digest trees; goes below a node only where it differs."""
    named = lambda df, side: df.select("relation", "node", "depth", "up", *[F.col(c).alias(f"{c}_{side}") for c in (*_DIGEST, "leaf")])
    a, b = named(here, "a"), named(there, "b")
    out, above, depth = None, None, 0
    while True:
        level = lambda df: df.where(F.col("depth") == depth) if above is None else df.where(F.col("depth") == depth).join(above, ["relation", "up"], "left_semi")  # noqa: B023, E731
        both = level(a).drop("up", "depth").join(level(b).drop("up", "depth"), ["relation", "node"], "full")
        same = (F.col("n_a") == F.col("n_b")) & (F.col("mixed_a") == F.col("mixed_b")) & (F.col("total_a") == F.col("total_b"))
        found = stage(both.where(~F.coalesce(same, F.lit(False))).select("relation", "node", F.greatest(F.coalesce("leaf_a", F.lit(0)), F.coalesce("leaf_b", F.lit(0))).alias("leaf")), "differing")
        leaves = found.where("leaf = 1").select("relation", F.col("node").alias("path"))
        out = leaves if out is None else out.unionByName(leaves)
        above, depth = found.select("relation", F.col("node").alias("up")), depth + 1
        if found.isEmpty():
            return out


def drift(here: DataFrame, there: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(relation, key, here, there): the distinct rows (relation, path, key) that only one side has; trees: their digest trees, if kept."""
    trees = trees or (digest_tree(here), digest_tree(there))
    where = stage(differing_paths(*trees), "differing")
    few = where.count() <= BROADCAST_NODES
    only = lambda df, side: df.join(F.broadcast(where) if few else where, ["relation", "path"], "left_semi").select("relation", "key").distinct().withColumn(side, F.lit(True))
    return only(here, "here").join(only(there, "there"), ["relation", "key"], "full").where("here IS NULL OR there IS NULL")
