"""Vectors of whole numbers: made from embeddings, measured exactly, and handed to tasks in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components beyond this are set to it, so that squared distances of up to 64 components fit 63 bits.
LIMIT = (1 << 27) - 1
SCALE = 1024
BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def finite(vector: str) -> Column:
    """True for vectors that hold neither nulls nor anything but finite numbers; null for a null vector."""
    x = F.transform(vector, lambda v: v.cast("double"))
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def whole(vector: str) -> Column:
    """floor(1024 * x) of each component, as int."""
    scaled = lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double"))
    return F.transform(vector, lambda v: F.least(F.greatest(scaled(v), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow array of lists, all of dim numbers, as int64."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x, rows of c) of whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 52:
        # every term and every sum is a whole number that a double holds exactly
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] + (cf * cf).sum(1)[None, :] - 2 * (xf @ cf.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1) if len(c) else np.zeros((len(x), 0), np.int64)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of the given number; the last is shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            take = min(rows - n, batch.num_rows)
            held.append(batch.slice(0, take))
            n, batch = n + take, batch.slice(take)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Within it, jobs hand rows to Python by so many at once: for rows that are blocks themselves."""
    before = spark.conf.get(BATCHES)
    spark.conf.set(BATCHES, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


def floor_means(sums: DataFrame, keys: list[str]) -> dict[tuple, list[int]]:
    """{keys: componentwise floor(sum / count)} of a table (keys, n, total) of partial counts and sums.

    One row for each key and component comes to the driver: a codebook, whose size does not depend on the input.
    """
    each = sums.select(*keys, "n", F.posexplode("total").alias("at", "v"))
    each = each.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[tuple, dict[int, int]] = {}
    for r in each.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["at"]] = int(r["v"]) // r["n"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}
