"""Compression of vectors to codes: one codebook a part, made by Lloyd rounds with Elkan's bounds.

Vectors are cut into equal parts, and each part position has a codebook of its own. Between rounds every part
keeps its entry, an upper bound of the distance to it, and a lower bound of the distance to each entry of the
codebook. A round first moves the bounds by as much as entries have moved; an entry is looked at only
if neither its lower bound nor half of its distance from the part's own entry is greater than the upper bound,
strictly; those that are looked at get their exact distance in whole numbers, which decides ties as well. The
bounds are written with the vectors, round by round, lower bounds in steps of 1/255 of a part's greatest one,
rounded down: one byte an entry. The table of a round also holds each task's counts and sums, from which the
next codebook is made; a codebook is all that comes to the driver.

Defined results: vectors that are null or hold null or non-finite components are left out; vectors of another
length than the others have no parts: their code, error and label_error are null, and they take no part in the
codebooks; components beyond 131,071 count as that; rows that repeat an id are coded each by itself, first entries
of equal id are ordered by their components, null ids come last; with fewer vectors than entries the codebooks are
as short; of entries at the same distance the lower index wins; an empty table gives an empty result; further
columns are not passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyql.llm import lattice
from canopyql.session import release, scratch, table

#: Vectors of one row of a round's table, which takes about 1.3 kB each for 4 parts of 256 entries.
BLOCK = 512
#: Such rows handed to Python at once.
BATCH = 8
#: Rows of sums by label up to which they are broadcast.
BROADCAST_LABELS = 200_000
SALTS = 32
_UP, _DOWN = np.float32(1 + 1e-6), np.float32(1 - 1e-6)


def gaps(book: np.ndarray) -> np.ndarray:
    """Half of the distance between any two entries."""
    return np.sqrt(lattice.squared(book, book)) / 2


def first_bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower) of each row, from all distances."""
    d = lattice.squared(x, book)
    own = d.argmin(1)
    root = np.sqrt(d)
    return own, root[np.arange(len(x)), own], root


def pruned(x: np.ndarray, book: np.ndarray, half: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves every row to its nearest entry and tightens its bounds, in place; returns how many distances it took.

    own: the entry so far; upper: at least the distance to it; lower: at most the distances to all.
    """
    slack = lambda u: u * (1 + 1e-9) + 1e-9
    between = half + np.diag(np.full(len(book), np.inf))
    rows = np.flatnonzero(between.min(1, initial=np.inf)[own] <= slack(upper))
    may = lambda rows: (lower[rows] <= slack(upper[rows])[:, None]) & (between[own[rows]] <= slack(upper[rows])[:, None])
    rows = rows[may(rows).any(1)]
    # the exact distance to the own entry may already rule out the others
    exact = ((x[rows] - book[own[rows]]) ** 2).sum(1)
    upper[rows] = np.sqrt(exact)
    left = may(rows)
    some = left.any(1)
    rows, exact, left = rows[some], exact[some], left[some]
    taken = len(some) + int(left.sum())
    at = np.arange(len(rows))
    d = np.full(left.shape, np.iinfo(np.int64).max)
    if left.mean() > 0.2 if left.size else False:
        # many are left: all at once is faster, and no less exact
        d = lattice.squared(x[rows], book)
        left = np.ones_like(left)
    else:
        r, c = np.nonzero(left)
        d[r, c] = ((x[rows[r]] - book[c]) ** 2).sum(1)
    d[at, own[rows]] = exact
    left[at, own[rows]] = True
    lower[rows] = np.where(left, np.sqrt(d), lower[rows])
    own[rows] = d.argmin(1)
    upper[rows] = np.sqrt(d[at, own[rows]])
    return taken


def packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, unit): lower bounds as bytes of a unit each row, not above what they were."""
    unit = np.maximum(lower.max(1, initial=0) / 255, 1e-30).astype(np.float32) * _UP
    return np.minimum(lower / unit[:, None], 255).astype(np.uint8), unit


def unpacked(steps: np.ndarray, unit: np.ndarray) -> np.ndarray:
    return steps.astype(np.float64) * (unit * _DOWN)[:, None]


def _state(ids: T.DataType, labels: T.DataType) -> T.StructType:
    """A row is a block of vectors with its bounds, or (part not null) one task's sum of the parts of an entry."""
    out = T.StructType().add("part", T.IntegerType()).add("entry", T.IntegerType()).add("n", T.LongType()).add("total", T.ArrayType(T.LongType()))
    out.add("ids", T.ArrayType(ids)).add("labels", T.ArrayType(labels))
    for k in ("x", "own", "upper", "steps", "unit"):
        out.add(k, T.BinaryType())
    return out


def _block(ids: pa.Array, labels: pa.Array, x: np.ndarray, own: np.ndarray, upper: np.ndarray, steps: np.ndarray, unit: np.ndarray) -> list[pa.Array]:
    alone = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    none = [pa.array([None], k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
    kinds = ((x, np.int32), (own, np.uint8), (upper, np.float32), (steps, np.uint8), (unit, np.float32))
    return [*none, alone(ids), alone(labels), *[pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in kinds]]


def _sums(n: np.ndarray, total: np.ndarray, ids: pa.DataType, labels: pa.DataType) -> list[pa.Array]:
    part, entry = np.nonzero(n)
    none = [pa.nulls(len(part), k) for k in (pa.list_(ids), pa.list_(labels), *[pa.binary()] * 5)]
    return [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64())), *none]


def _of(batch: pa.RecordBatch, books: np.ndarray):
    """The blocks of a round's table: ids, labels, x, own, upper, lower by part."""
    parts, k, width = books.shape
    for ids, labels, x, own, upper, steps, unit in zip(*[batch.column(n) for n in ("ids", "labels", "x", "own", "upper", "steps", "unit")], strict=True):
        x = np.frombuffer(x.as_py(), np.int32).astype(np.int64).reshape(-1, parts, width)
        own = np.frombuffer(own.as_py(), np.uint8).astype(np.int64).reshape(-1, parts)
        upper = np.frombuffer(upper.as_py(), np.float32).astype(np.float64).reshape(-1, parts) * float(_UP)
        steps, unit = np.frombuffer(steps.as_py(), np.uint8).reshape(-1, parts, k), np.frombuffer(unit.as_py(), np.float32).reshape(-1, parts)
        yield ids.values, labels.values, x, own, upper, [unpacked(steps[:, p], unit[:, p]) for p in range(parts)]


def moved(books: np.ndarray, before: np.ndarray, blocks):
    """Blocks with their bounds shifted by the entries' movement and their parts assigned anew."""
    half = [gaps(b) for b in books]
    shift = [np.sqrt(((b - a) ** 2).sum(1)) * (1 + 1e-9) for a, b in zip(before, books, strict=True)]
    for ids, labels, x, own, upper, lower in blocks:
        for p, (book, by) in enumerate(zip(books, shift, strict=True)):
            a, u = own[:, p].copy(), upper[:, p] + by[own[:, p]]
            lower[p] = np.maximum(lower[p] - by[None, :], 0)
            pruned(x[:, p], book, half[p], a, u, lower[p])
            own[:, p], upper[:, p] = a, u
        yield ids, labels, x, own, upper, lower


def _round(rows: DataFrame, books: np.ndarray, step: Callable, path: str) -> DataFrame:
    """Writes a round's table: step turns a batch into assigned blocks."""
    parts, k, width = books.shape
    kinds = rows.schema["vec_id"].dataType if "vec_id" in rows.columns else rows.schema["ids"].dataType.elementType
    labels = rows.schema["label"].dataType if "label" in rows.columns else rows.schema["labels"].dataType.elementType
    state = _state(kinds, labels)

    def run(batches):
        n, total, types = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), None
        for ids, labels, x, own, upper, lower in step(batches):
            types = (ids.type, labels.type)
            small = [packed(v) for v in lower]
            for p in range(parts):
                n[p] += np.bincount(own[:, p], minlength=k)
                np.add.at(total[p], own[:, p], x[:, p])
            steps, unit = np.stack([s for s, _ in small], 1), np.stack([u for _, u in small], 1)
            yield pa.RecordBatch.from_arrays(_block(ids, labels, x, own, upper * float(_UP), steps, unit), state.names)
        if types:
            yield pa.RecordBatch.from_arrays(_sums(n, total, *types), state.names)

    rows.mapInArrow(run, state).write.parquet(path)
    return rows.sparkSession.read.schema(state).parquet(path)


def _next(written: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries' componentwise floors of means; unused entries stay."""
    out = books.copy()
    for (p, c), mean in lattice.floor_means(written.where("part IS NOT NULL").select("part", "entry", "n", "total"), ["part", "entry"]).items():
        out[p, c] = mean
    return out


def codebooks_and_codes(rows: DataFrame, dim: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error) of the vectors of dim components, the final codebooks (part, entry, component))."""
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts must divide dim, and entries be 1 to 256")
    spark, width = rows.sparkSession, dim // parts
    x = rows.where(F.size("embedding") == dim).select("vec_id", "label", lattice.whole("embedding").alias("x"))
    kinds = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    first = np.array([r["x"] for r in x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], dtype=np.int64)
    if not len(first):
        return spark.createDataFrame([], kinds), np.zeros((parts, 0, width), np.int64)
    books = first.reshape(-1, parts, width).transpose(1, 0, 2).copy()

    def begin(batches):
        for b in lattice.blocks(batches, BLOCK):
            v = lattice.matrix(b.column(2), dim).reshape(-1, parts, width)
            each = [first_bounds(v[:, p], books[p]) for p in range(parts)]
            yield b.column(0), b.column(1), v, np.stack([e[0] for e in each], 1), np.stack([e[1] for e in each], 1), [e[2] for e in each]

    path, out = scratch(spark, "bounds"), scratch(spark, "codes")
    written = _round(x, books, begin, path)
    before, books = books, _next(written, books)
    with lattice.batches_of(spark, BATCH):
        for _ in range(rounds - 1):
            was, now = before, books

            def again(batches, was=was, now=now):
                yield from moved(now, was, (block for batch in batches for block in _of(batch, now)))

            last, path = path, scratch(spark, "bounds")
            written = _round(written.where("part IS NULL"), books, again, path)
            before, books = books, _next(written, books)
            release(spark, {last})

        def final(batches):
            for ids, labels, v, own, _, _ in moved(books, before, (block for batch in batches for block in _of(batch, books))):
                error = sum(((v[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(parts))
                code = [bytes(c).hex() for c in own.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        written.where("part IS NULL").mapInArrow(final, kinds).write.parquet(out)
    release(spark, {path})
    return spark.read.schema(kinds).parquet(out), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over rows of the same label; sums are made before rows meet them, few are broadcast, many salted."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("label", "_label")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), same).drop("_label", "_n")
    salted = coded.withColumn("_salt", (F.rand() * SALTS).cast("int"))
    many = sums.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(many, same & (F.col("_salt") == F.col("_at"))).drop("_label", "_n", "_salt", "_at")


def compress(rows: DataFrame, **how) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks) of a table (vec_id, label, embedding)."""
    kept = rows.where(F.col("embedding").isNotNull() & lattice.finite("embedding")).select("vec_id", "label", "embedding")
    coded, books = codebooks_and_codes(kept, **how)
    odd = kept.where(F.size("embedding") != how.get("dim", 64)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return with_label_error(coded.unionByName(odd)), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(dim: int = 64, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    width = dim // parts
    each = lambda f, sep=", ": sep.join(f(i) for i in range(width))
    d = each(lambda i: f"(v.x{i} - c.x{i}) * (v.x{i} - c.x{i})", " + ")
    nearest = lambda r: f"a{r} AS MATERIALIZED (SELECT v.row_id, v.part, min(({d}) * {entries} + c.entry) AS best FROM v JOIN c{r} c USING (part) GROUP BY v.row_id, v.part)"
    mean = lambda i: f"CAST((s{i} - ((s{i} % n) + n) % n) // n AS BIGINT)"
    steps = []
    for r in range(rounds):
        steps.append(nearest(r))
        steps.append(f"t{r} AS MATERIALIZED (SELECT part, a.best % {entries} AS entry, count(*) AS n, {each(lambda i: f'sum(v.x{i}) AS s{i}')} FROM a{r} a JOIN v USING (row_id, part) GROUP BY 1, 2)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, {each(lambda i: f'coalesce({mean(i)}, c.x{i}) AS x{i}')} FROM c{r} c LEFT JOIN t{r} t USING (part, entry))")
    row = f"concat_ws(',', {each(lambda i: f'x{i}')})"
    return f"""WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS row_id, vec_id, label, x FROM e WHERE len(x) = {dim}
), v AS MATERIALIZED (SELECT row_id, p.part, {each(lambda i: f'x[p.part * {width} + {i + 1}] AS x{i}')} FROM n, range({parts}) p(part)
), c0 AS MATERIALIZED (SELECT part, row_id AS entry, {each(lambda i: f'x{i}')} FROM v WHERE row_id < {entries}
), {', '.join(steps)}, {nearest(rounds)}, coded AS (
  SELECT n.vec_id, n.label, a.code, a.error FROM n JOIN (
    SELECT row_id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY row_id) a USING (row_id)
  UNION ALL SELECT vec_id, label, NULL, NULL FROM e WHERE len(x) <> {dim}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg({row}, ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256 FROM coded"""


OP12_SQL = _sql()
