"""Near-duplicate classes by DartMinHash.

A text is the multiset of its windows of five words (the whole text where it has fewer): each window weighs
as often as it occurs, and two texts are alike by the generalised Jaccard similarity, the sum of the lesser
weights over that of the greater. Darts are thrown by hash into the region element x weight x rank, about
k ln k + 2k of them below a rank that shrinks with the total weight, and each of the k coordinates keeps its
earliest dart: two signatures agree in a coordinate with that similarity. 32 bands of 4 coordinates make
texts of similarity 0.8 meet with probability 1 - 5e-8.

Equal texts are one node from the start. In every band each node is paired with one hub only, picked by one
of four hash orders; links that hold (similarity of the multisets, counted exactly) form components. Bands
that still hold several components then compare the nodes of different components inside the band, block by
block, and emit links that join components; a band of very many nodes is first divided by the other bands
that its nodes share (a pair of similarity 0.8 shares a second one with probability 1 - 1e-6). So groups of
copies of any size make pairs in proportion to their size, and no pair of different components is passed over.

Defined results: a null text is the empty text; texts without words are alike only if equal; rows that
share an id are documents of their own, alike by their texts alone; a class is named by the least id in it,
null if it has none; an empty table gives an empty result; ``deduplicate`` carries all other columns and keeps,
of each class, the row of the least id (nulls last), then of the least digest of the text, and of rows that
have both in common any one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyql.llm.components import components
from canopyql.llm.flat import SPACE, U, flat, hashes, mix, pieces, words
from canopyql.llm.kept import forget
from canopyql.session import stage, table

WIDTH, SIMILARITY = 5, 0.8
K = 128
#: Chance to lose a pair of just the similarity asked for: by sharing no band, and by agreeing in too few coordinates.
NO_BAND, TOO_FEW = 1e-6, 1e-8
LEAST_ID = -(1 << 62)
#: Rows (a digest or id each) up to which a table is broadcast; longer ones are joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Nodes of a band that are compared in one group; larger bands take a group for each pair of blocks, and
#: those of over MANY nodes are divided by a second band first.
BLOCK, MANY = 500, 4000
#: Bytes of a text that are hashed at a time; longer texts go piece by piece.
LONG = 8 << 20
#: Bytes of texts, and cells that darts are thrown into, that a worker has at a time.
PIECE, CELLS = 1 << 20, 1 << 17
_Q = U(0xFF51AFD7ED558CCD)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each window of width words; of the whole text where it has one to width - 1 words."""
    start, end, text = words(data, offsets)
    h = hashes(data, start, end)
    n = len(h)
    if not n:
        return h, text
    # windows that would cross texts keep only the words of the first one
    got, own = np.zeros(n, U), np.ones(n, dtype=bool)
    for j in range(width):
        same = np.zeros(n, dtype=bool)
        same[: n - j] = text[j:] == text[: n - j]
        part = np.zeros(n, U)
        part[: n - j] = h[j:] * same[: n - j]
        got = got * _Q + part
        own &= same
    first = np.ones(n, dtype=bool)
    first[1:] = text[1:] != text[:-1]
    keep = own | first
    return mix(got[keep]), text[keep]


def band_rows(similarity: float) -> int:
    """Coordinates in a band: as many as keep the chance to share no band below NO_BAND."""
    return max(r for r in range(1, 9) if r == 1 or (1 - similarity**r) ** (K // r) <= NO_BAND)


def least_agreeing(similarity: float) -> int:
    """Agreeing coordinates below which a pair is not counted: fewer come with a chance below TOO_FEW."""
    total, m = 0.0, 0
    while (total := total + math.comb(K, m) * similarity**m * (1 - similarity) ** (K - m)) < TOO_FEW:
        m += 1
    return m


def dart_signatures(element: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, k: int = K) -> np.ndarray:
    """n_texts x k dart numbers; rows of texts without elements are 0. Equal weighted sets get equal rows."""
    out = np.zeros((n_texts, k), dtype=np.uint32)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    todo = np.flatnonzero(total > 0)
    rank_below = np.zeros(n_texts)
    rank_below[todo] = (k * np.log(k) + 2 * k) / total[todo]
    while len(todo):
        is_todo = np.zeros(n_texts, dtype=bool)
        is_todo[todo] = True
        row_of = np.zeros(n_texts, dtype=np.int64)
        row_of[todo] = np.arange(len(todo))
        best = np.full(len(todo) * k, np.iinfo(np.uint64).max, dtype=U)
        name = np.full(len(todo) * k, np.iinfo(np.uint64).max, dtype=U)
        use = np.flatnonzero(is_todo[text])
        # a few elements at a time: unit cells of weight x rank, a Poisson(1) number of darts in each
        cells_each = (np.ceil(weight[use]) * np.ceil(rank_below[text[use]])).astype(np.int64)
        cuts = np.searchsorted(np.cumsum(cells_each), np.arange(CELLS, cells_each.sum() + CELLS, CELLS))
        for part in np.split(np.arange(len(use)), np.unique(np.clip(cuts, 1, len(use)))):
            if not len(part):
                continue
            e, n = use[part], cells_each[part]
            x = np.repeat(e, n)
            cell = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            across = np.ceil(rank_below[text[x]]).astype(np.int64)
            w_cell, r_cell = cell // across, cell % across
            h = mix(element[x] + (w_cell.astype(U) << U(32)) * U(0x9E3779B97F4A7C15) + r_cell.astype(U) * U(0xC2B2AE3D27D4EB4F))
            darts = np.searchsorted(_POISSON, (h >> U(11)).astype(np.float64) * 2.0**-53, side="right")
            hit = np.repeat(np.arange(len(x)), darts)
            j = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
            d = mix(h[hit] + (j.astype(U) + U(1)) * U(0xA0761D6478BD642F))
            rank = r_cell[hit] + (d >> U(32)).astype(np.float64) * 2.0**-32
            keep = rank < rank_below[text[x[hit]]]
            if not np.all(weight[x] == 1):
                keep &= w_cell[hit] + (mix(d) >> U(11)).astype(np.float64) * 2.0**-53 < weight[x[hit]]
            d, hit = d[keep], hit[keep]
            order = (r_cell[hit].astype(U) << U(32)) | (d >> U(32))
            at = row_of[text[x[hit]]] * k + (d & U(0xFFFF)).astype(np.int64) % k
            before = best[at].copy()
            np.minimum.at(best, at, order)
            name[at[best[at] < before]] = np.iinfo(np.uint64).max
            won = best[at] == order
            np.minimum.at(name, at[won], mix(d[won]))
        full = (best.reshape(len(todo), k) != np.iinfo(np.uint64).max).all(axis=1)
        out[todo[full]] = (name.reshape(len(todo), k)[full] & U(0xFFFFFFFF)).astype(np.uint32)
        todo = todo[~full]
        rank_below[todo] *= 2
    return out


_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, i + 1))) for i in range(14)])


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, bands = len(signatures), signatures.shape[1] // rows
    s = signatures[:, : bands * rows].reshape(n, bands, rows).astype(U)
    key = np.broadcast_to(np.arange(bands, dtype=U) + U(1), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * _Q + s[:, :, j])
    return key.view(np.int64)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Equal rows of a matrix as binary values."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _long_shingles(data: np.ndarray, width: int) -> np.ndarray:
    """The window hashes of one long text, a part at a time; a part begins with the last width - 1 words of the one before."""
    out, begin = [], 0
    while begin < len(data):
        end = min(begin + LONG, len(data))
        if end < len(data):
            blanks = np.flatnonzero(SPACE[data[end:]][: 1 << 20])
            end = end + int(blanks[0]) if len(blanks) else len(data)
        part = data[begin:end]
        start, _, _ = words(part, np.array([0, len(part)]))
        if len(start) >= width or not out:
            out.append(shingles(part, np.array([0, len(part)]), width)[0])
        if end == len(data):
            break
        begin += int(start[-(width - 1)]) if len(start) >= width else 0
        if len(start) < width:  # few and endless words: the rest in one
            out[-1] = shingles(data[begin:], np.array([0, len(data) - begin]), width)[0]
            break
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the texts' windows, sorted within each text."""
    data, offsets = flat(texts)
    if len(texts) == 1 and len(data) > LONG:
        h = _long_shingles(data, width)
        text = np.zeros(len(h), np.int64)
    else:
        h, text = shingles(data, offsets, width)
    if not len(h):
        return h, text, np.zeros(0, np.int64)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def _sketch(width: int) -> Callable:
    """Signatures; texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column("text")
            for at, size in pieces(texts, PIECE):
                h, text, count = _sets(texts.slice(at, size), width)
                signatures = dart_signatures(h, text, count.astype(float), size)
                some = np.bincount(text, minlength=size) > 0
                part = batch.slice(at, size)
                filled = pa.compute.if_else(pa.array(some), _binaries(signatures), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("key"), part.column("same"), filled], names=["node", "key", "same", "signature"])

    return run


def _shingle_sets(width: int) -> Callable:
    """Window hashes of each text and, where any occurs more than once, their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at, size in pieces(texts, PIECE):
                h, text, count = _sets(texts.slice(at, size), width)
                ends = np.searchsorted(text, np.arange(size + 1))
                sets = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(h)])
                often = np.zeros(size, bool)
                often[text[count > 1]] = True
                counts = [count[ends[i] : ends[i + 1]].astype(np.uint32).tobytes() if often[i] else None for i in range(size)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, size), sets, pa.array(counts, pa.binary())], names=["node", "shingles", "counts"])

    return run


def _bands(rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, K)
                node = np.repeat(batch.column("node").to_numpy(), K // rows)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(band_keys(s, rows).reshape(-1))], names=["node", "band"])

    return run


Multiset = tuple[np.ndarray, np.ndarray | None]


def _multiset(shingles: pa.Scalar, counts: pa.Scalar) -> Multiset:
    return np.frombuffer(shingles.as_buffer(), U), np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64) if counts.is_valid else None


def _similar(x: Multiset, y: Multiset, similarity: float) -> bool:
    """Whether two multisets (distinct numbers, and their counts unless all are 1) have a generalised Jaccard similarity of that or more."""
    (a, m), (b, n) = x, y
    p, q = (len(s) if c is None else int(c.sum()) for s, c in (x, y))
    if min(p, q) < similarity * max(p, q) - 1e-9:
        return False
    if m is None and n is None:
        common = len(np.intersect1d(a, b, assume_unique=True))
    else:
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        common = len(i) if m is None or n is None else int(np.minimum(m[i], n[j]).sum())
    return common >= similarity * (p + q - common) - 1e-9


def _agreeing(least: int) -> Callable:
    """Pairs that may be similar: those that agree in enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"signature_{x}").to_pylist()), np.uint32).reshape(-1, K) for x in "ab")
                keep = pa.array((a == b).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _counted(similarity: float) -> Callable:
    """Pairs whose multisets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[_multiset(s, c) for s, c in zip(batch.column(f"shingles_{x}"), batch.column(f"counts_{x}"), strict=True)] for x in "ab"]
            keep = pa.array([_similar(x, y, similarity) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _beside(rows: DataFrame, keys: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """rows joined with a table made before, which is broadcast only if it is short."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def _within_band(similarity: float, least: int) -> Callable:
    def run(group: pa.Table) -> pa.Table:
        """Links between the labels of different components among the nodes of a band (or of two blocks of it).

        A link found joins its components at once, so a group yields fewer links than it has labels.
        """
        own = group.column("label").to_numpy()
        label = own.copy()
        s = (np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, K) & 0xFFFF).astype(np.uint16)
        sets = [_multiset(x, c) for x, c in zip(group.column("shingles"), group.column("counts"), strict=True)]
        a, b = [], []
        for i in range(len(label) - 1):
            other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            for j in other[(s[other] == s[i]).sum(axis=1) >= least]:
                if label[j] != label[i] and _similar(sets[i], sets[j], similarity):
                    a.append(min(own[i], own[j]))
                    b.append(max(own[i], own[j]))
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


class _Search:
    """The tables of one run: documents as nodes, their signatures and, for those that are asked for, their windows."""

    def __init__(self, docs: DataFrame, similarity: float, width: int):
        self.similarity, self.width, self.rows_each, self.least = similarity, width, band_rows(similarity), least_agreeing(similarity)
        text = F.coalesce("text", F.lit(""))
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("key"), F.unhex(F.md5(text)).alias("same"), text.alias("text"))
        numbered = self.rows.withColumn("node", F.monotonically_increasing_id())
        self.sketches = stage(numbered.mapInArrow(_sketch(width), "node long, key long, same binary, signature binary"), "sketches")
        # equal texts are one node, the least; only texts met twice are in the table
        copies = self.sketches.groupBy("same").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
        self.copies = stage(copies, "copies")
        self.nodes = _beside(self.sketches, self.copies, "same", "left").where("signature IS NOT NULL AND (first IS NULL OR first = node)").select("node", "key", "same", "signature")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles, counts) of the nodes in wanted (node), one row each."""
        named = stage(_beside(self.nodes.select("node", "key", "same"), wanted, "node", "left_semi"), "wanted")
        texts = _beside(self.rows, named, ["key", "same"], "inner").select("node", "text")
        made = texts.mapInArrow(_shingle_sets(self.width), "node long, shingles binary, counts binary")
        return made.repartition("node").dropDuplicates(["node"])  # repeated rows are one

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that hold."""

        def both(of: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
            for x in "ab":
                of = of.join(values.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x)
            return of

        near = stage(both(pairs, self.nodes, "signature").mapInArrow(_agreeing(self.least), "a long, b long"), "near")
        wanted = stage(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "wanted")
        return both(near, self.sets(wanted), "shingles", "counts").mapInArrow(_counted(self.similarity), "a long, b long")

    def between(self, known: DataFrame) -> DataFrame:
        """Links between the labels of components that meet in a band: known is (band, node, label)."""
        spread = [F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")]
        mixed = stage(known.groupBy("band").agg(*spread).where("low <> high").select("band", "n"), "mixed")
        if mixed.isEmpty():
            return known.sparkSession.createDataFrame([], "a long, b long")
        found = stage(_beside(known, mixed, "band", "inner").withColumn("other", F.lit(0).cast("long")), "open")
        if not mixed.where(F.col("n") > MANY).isEmpty():
            # nodes of a crowded band are compared only if they share another one as well
            second = known.select("node", F.col("band").alias("second"))
            divided = found.where(F.col("n") > MANY).drop("other", "n").join(second, "node").where("band <> second")
            parts = divided.groupBy("band", "second").agg(*spread).where("low <> high").select("band", "second", "n")
            divided = divided.join(parts, ["band", "second"]).withColumnRenamed("second", "other")
            found = stage(found.where(F.col("n") <= MANY).unionByName(divided), "open")
        wanted = stage(found.select("node").distinct(), "wanted")
        full = found.join(_beside(self.nodes.select("node", "signature"), wanted, "node", "left_semi"), "node").join(self.sets(wanted), "node")
        # a large group is compared block by block, every pair of blocks in a group of its own
        full = full.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        full = full.withColumn("own", own).withColumn("beside", other)
        full = full.withColumn("first", F.least("own", "beside")).withColumn("last", F.greatest("own", "beside"))
        full = full.select("band", "other", "first", "last", "label", "signature", "shingles", "counts")
        return full.groupBy("band", "other", "first", "last").applyInArrow(_within_band(self.similarity, self.least), "a long, b long").distinct()

    def labelled(self) -> DataFrame:
        """(key, same, node, label) of each row; rows of one class have one label."""
        member = self.nodes.select("node", "signature").mapInArrow(_bands(self.rows_each), "node long, band long")
        first = F.min(F.struct(F.xxhash64("node", F.pmod(F.col("band"), F.lit(4))).alias("h"), "node"))
        hubs = member.groupBy("band").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.col("first.node").alias("hub"))
        shared = stage(member.join(hubs, "band"), "bands")
        pairs = shared.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        links = stage(self.verified(stage(pairs, "pairs")), "links")
        labels = components(links)
        # bands that still hold several components
        known = shared.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
        rest = stage(self.between(known), "links")
        out = _beside(self.sketches.select("key", "same", "node"), self.copies, "same", "left").withColumn("of", F.coalesce("first", "node"))
        out = _beside(out, labels.withColumnRenamed("node", "of"), "of", "left")
        out = out.select("key", "same", "node", F.coalesce("label", "of").alias("label"))
        if rest.isEmpty():
            return out
        # components found to be one: only their labels are put together, the links inside them are settled
        joined = components(rest).where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("above"))
        return _beside(out, joined, "label", "left").select("key", "same", "node", F.coalesce("above", "label").alias("label"))


def _id(key: str):
    return F.when(F.col(key) != LEAST_ID, F.col(key))


def classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, class_id) for each row of docs: class_id is the least id of its class."""
    rows = _Search(docs, similarity, width).labelled().select(_id("key").alias("doc_id"), "label")
    names = stage(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "classes")
    out = _beside(rows, names.withColumn("several", F.lit(True)), "label", "left")
    return out.select("doc_id", F.when(F.col("several"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """One row of each class, with all columns of docs: see the module's text."""
    rows = _Search(docs, similarity, width).labelled()
    order = F.struct((F.col("key") == LEAST_ID).alias("none"), "key", "same")
    best = stage(rows.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "classes")
    several = _beside(rows, best, "label", "inner")
    is_best = (F.col("key") == F.col("best.key")) & (F.col("same") == F.col("best.same"))
    gone = stage(several.where(~is_best).select("key", "same").distinct(), "gone")
    # only rows that have id and text in common with another one are left to be told apart
    twice = stage(several.where(is_best).groupBy("key", "same").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "same"), "twice")
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("key"), F.unhex(F.md5(text)).alias("same"))
    kept = _beside(packed, gone, ["key", "same"], "left_anti")
    if not twice.isEmpty():
        kept = _beside(kept, twice, ["key", "same"], "left_anti").unionByName(_beside(kept, twice, ["key", "same"], "left_semi").dropDuplicates(["key", "same"]))
    return kept.select("row.*")


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
