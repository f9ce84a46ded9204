"""Centroid clustering over partition-local ball trees.

Each task cuts its vectors into blocks and makes a metric tree of every block: a ball holds the count and the
whole-number sum of its vectors and their greatest distance from its centre; leaves hold the vectors. The trees
are written once. A round sends the centroids down every tree: by the triangle inequality a centroid is out for a
ball if another is nearer for certain, strictly; a ball with one centroid left adds its count and sum to it
whole, any other passes the question to its halves, and leaves that reach the end are settled by exact
distances. A task returns one row of counts and sums for each centroid.

Defined results: vectors that are null, hold null or non-finite components or have another length are no vectors
of this space and are left out; components beyond 131,071 count as that; rows that repeat an id are clustered
each by itself, starting centroids of equal hash are ordered by their components, ids that are null come last;
with fewer vectors than centroids there are as many centroids as vectors; of centroids at the same distance
the smaller number wins; an empty table gives an empty result; further columns are not passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyql.llm import lattice
from canopyql.session import release, scratch, table

#: Vectors of one tree, and of a leaf.
BLOCK, LEAF = 1024, 16
#: Trees handed to Python at once, about 350 kB each for 64 components.
TREES = 16


def split(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The rows' order by leaf, and the balls (first, end, left, right), the root first; leaves have left -1."""
    order, balls, at = np.arange(len(x)), [(0, len(x), -1, -1)], 0
    xf = x.astype(np.float64)
    while at < len(balls):
        first, end, _, _ = balls[at]
        own = order[first:end]
        if end - first > LEAF:
            away = lambda point: ((xf[own] - point) ** 2).sum(1)
            one = xf[own[np.argmax(away(xf[own].mean(0)))]]
            d_one = away(one)
            if d_one.max() > 0:
                # halves by which of two far ends is nearer
                order[first:end] = own[np.argsort(d_one - away(xf[own[np.argmax(d_one)]]), kind="stable")]
                middle = (first + end) // 2
                balls[at] = (first, end, len(balls), len(balls) + 1)
                balls += [(first, middle, -1, -1), (middle, end, -1, -1)]
        at += 1
    return order, balls


def tree(x: np.ndarray) -> dict[str, np.ndarray]:
    order, balls = split(x)
    x = x[order]
    span = np.array(balls, dtype=np.int32)
    sums = np.stack([x[a:b].sum(0) for a, b, _, _ in balls])
    centre = sums / (span[:, 1] - span[:, 0])[:, None]
    radius = np.array([np.sqrt(((x[a:b] - m) ** 2).sum(1).max()) for (a, b, _, _), m in zip(balls, centre, strict=True)])
    return {"order": order, "x": x.astype(np.int32), "span": span, "sums": sums, "radius": radius * (1 + 1e-9)}


def settle(span: np.ndarray, sums: np.ndarray, radius: np.ndarray, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The balls that one centroid takes whole as (ball, centroid), and the leaves that need exact distances."""
    whole, leaves, level = [], [], np.zeros(1, dtype=np.int64)
    while len(level):
        centre = sums[level] / (span[level, 1] - span[level, 0])[:, None]
        d = np.sqrt(((centre[:, None, :] - centroids[None]) ** 2).sum(2))
        r = radius[level][:, None]
        near = ((d + r) * (1 + 1e-9) + 1e-9).min(1)
        left = d - r <= near[:, None]
        alone = left.sum(1) == 1
        whole += zip(level[alone].tolist(), left[alone].argmax(1).tolist(), strict=True)
        open_ = level[~alone]
        is_leaf = span[open_, 2] < 0
        leaves.append(open_[is_leaf])
        level = span[open_[~is_leaf]][:, 2:].ravel().astype(np.int64)
    return whole, np.concatenate(leaves) if leaves else np.zeros(0, np.int64)


def assigned(x: np.ndarray, span: np.ndarray, sums: np.ndarray, radius: np.ndarray, centroids: np.ndarray):
    """Each row's centroid, and the balls taken whole: the rows of these have not been looked at."""
    whole, leaves = settle(span, sums, radius, centroids)
    out = np.empty(len(x), dtype=np.int64)
    for ball, c in whole:
        out[span[ball, 0] : span[ball, 1]] = c
    rows = np.concatenate([np.arange(span[b, 0], span[b, 1]) for b in leaves]) if len(leaves) else np.zeros(0, np.int64)
    out[rows] = lattice.squared(x[rows].astype(np.int64), centroids).argmin(1)
    return out, rows, whole


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple]:
    for ids, x, span, sums, radius in zip(*[batch.column(i) for i in range(5)], strict=True):
        x = np.frombuffer(x.as_py(), np.int32).reshape(-1, dim)
        yield ids.values, x, np.frombuffer(span.as_py(), np.int32).reshape(-1, 4), np.frombuffer(sums.as_py(), np.int64).reshape(-1, dim), np.frombuffer(radius.as_py(), np.float64)


def trees(vectors: DataFrame, dim: int) -> DataFrame:
    """One row a tree of vectors (vec_id, x): ids and components in the order of the leaves, balls, sums, radii."""

    def grow(batches):
        for block in lattice.blocks(batches, BLOCK):
            t = tree(lattice.matrix(block.column(1), dim))
            ids = block.column(0).take(pa.array(t["order"]))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *[pa.array([t[k].tobytes()], pa.binary()) for k in ("x", "span", "sums", "radius")]], ["ids", "x", "span", "sums", "radius"])

    binary = [T.StructField(k, T.BinaryType()) for k in ("x", "span", "sums", "radius")]
    return vectors.select("vec_id", "x").mapInArrow(grow, T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["vec_id"].dataType)), *binary]))


def totals(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(centroid, n, total, unseen) of one round, a row for each task and centroid; unseen: vectors taken with a whole ball."""
    k, dim = centroids.shape

    def count(batches):
        n, total, unseen = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, span, sums, radius in _read(batch, dim):
                to, rows, whole = assigned(x, span, sums, radius, centroids)
                for ball, c in whole:
                    size = span[ball, 1] - span[ball, 0]
                    n[c], unseen[c] = n[c] + size, unseen[c] + size
                    total[c] += sums[ball]
                n += np.bincount(to[rows], minlength=k)
                np.add.at(total, to[rows], x[rows].astype(np.int64))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64())), pa.array(unseen[used])], ["centroid", "n", "total", "unseen"])

    return grown.mapInArrow(count, "centroid int, n long, total array<long>, unseen long")


def members(grown: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance): the nearest centroid of every vector."""
    dim = centroids.shape[1]

    def place(batches):
        for batch in batches:
            for ids, x, span, sums, radius in _read(batch, dim):
                to, _, _ = assigned(x, span, sums, radius, centroids)
                d = ((x.astype(np.int64) - centroids[to]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(to, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = T.StructField("vec_id", grown.schema["ids"].dataType.elementType)
    return grown.mapInArrow(place, T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def vectors_of(rows: DataFrame, dim: int) -> DataFrame:
    """(vec_id, x): the vectors of a table (vec_id, embedding) that have dim finite components, as whole numbers."""
    return rows.where((F.size("embedding") == dim) & lattice.finite("embedding")).select("vec_id", lattice.whole("embedding").alias("x"))


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose ids have the least hash."""
    first = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    return np.array([r["x"] for r in first.select("x").collect()], dtype=np.int64)


def clusters(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector, the final centroids)."""
    spark = rows.sparkSession
    vectors = vectors_of(rows, dim)
    centroids = starts(vectors, k, seed)
    path, out = scratch(spark, "balls"), scratch(spark, "clusters")
    with lattice.batches_of(spark, TREES):
        if not len(centroids):
            return members(trees(vectors, dim), np.zeros((1, dim), np.int64)), centroids
        # vectors come to Python as rows, not as blocks
        with lattice.batches_of(spark, 10_000):
            trees(vectors, dim).write.parquet(path)
        grown = spark.read.parquet(path)
        for _ in range(rounds):
            for (c,), mean in lattice.floor_means(totals(grown, centroids), ["centroid"]).items():
                centroids[c] = mean
        members(grown, centroids).write.parquet(out)
    release(spark, {path})
    return spark.read.parquet(out), centroids


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    placed, centroids = clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    k = max(1, len(centroids))
    sums = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(k)])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in (centroids.tolist() or [[]])])
    return placed.withColumns({"cluster_inertia": F.get(own, F.col("cluster")), "inertia": F.lit(sum(sums.values())).cast("long"), "centroid_sha256": F.get(digest, F.col("cluster"))})


def _sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    each = lambda f, sep: sep.join(f(i) for i in range(dim))
    d = each(lambda i: f"(v.x{i} - c.x{i}) * (v.x{i} - c.x{i})", " + ")
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT v.row_id, min(({d}) * {k} + c.c) AS best FROM v, c{r} c GROUP BY v.row_id)"
    mean = lambda i: f"CAST((s{i} - ((s{i} % n) + n) % n) // n AS BIGINT)"
    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"t{r} AS MATERIALIZED (SELECT a.best % {k} AS c, count(*) AS n, {each(lambda i: f'sum(v.x{i}) AS s{i}', ', ')} FROM a{r} a JOIN v USING (row_id) GROUP BY 1)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, {each(lambda i: f'coalesce({mean(i)}, c.x{i}) AS x{i}', ', ')} FROM c{r} c LEFT JOIN t{r} t ON c.c = t.c)")
    return f"""WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}
), v AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, {each(lambda i: f'x[{i + 1}] AS x{i}', ', ')} FROM e
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, {each(lambda i: f'x{i}', ', ')}) - 1 AS c, * EXCLUDE (h) FROM (
    SELECT * EXCLUDE (row_id, vec_id), sha256('3:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h NULLS LAST, {each(lambda i: f'x{i}', ', ')} LIMIT {k})
), {', '.join(steps)}, {nearest(rounds)}
SELECT v.vec_id, CAST(a.best % {k} AS INTEGER) AS cluster, CAST(a.best // {k} AS BIGINT) AS distance,
  CAST(sum(a.best // {k}) OVER (PARTITION BY a.best % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(a.best // {k}) OVER () AS BIGINT) AS inertia,
  sha256(concat_ws(',', {each(lambda i: f'c.x{i}', ', ')})) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row_id) JOIN c{rounds} c ON c.c = a.best % {k}"""


OP11_SQL = _sql()
