"""Language-model scores by prediction by partial matching.

Texts are taken in lower case (A-Z only), as UTF-8 bytes with one end symbol. The model is a trie of byte
contexts of up to ORDER bytes with the counts of the symbols that followed them in the training texts.
A symbol is predicted from the longest context known, with (c - 1/2) / N for a count of c in N; one not
seen there costs an escape, estimated from the number T of distinct symbols of the context as T / 2N, and
the next shorter context is asked, without the symbols that the longer ones have ruled out, down to all
byte values alike.

The trie is never in one place. Texts are dealt into blocks; a block reports its distinct (context, symbol)
numbers with their training counts, dealt by the last two bytes of the context. Pairs of bytes that would make
a bucket too large are divided by the byte before them, and so on: buckets are then filled evenly from the
occurrences of all these ends of contexts. A bucket owns whole branches of the trie: it sums the counts of all
blocks, works out escape and exclusion, and answers each block with one log probability a distinct number; of
ends that were divided it takes the counts (256 at most for each) from a broadcast table. Orders 0 and 1 are
at most 65,536 counts and are broadcast as well. Words for the plain baseline travel the same way, dealt by
their hash. Long texts are read in parts.

Defined results: a null text is the empty text (its end alone is scored); rows that repeat an id are
scored alike; a null id hashes as an empty string; with no training texts every symbol has probability
1/256; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyql.llm.flat import LOWER, SPACE, U, find, flat, hashes, pieces, slots, words
from canopyql.session import stage, table

ORDER = 6
START, STOP = 0xFE, 0xFF
#: Bytes of text in a block; as many blocks as the texts need, and twice as many buckets.
BLOCK = 24 << 20
#: Bytes of text worked on at a time, and pieces whose counts are merged at a time: they bound a worker's memory.
PIECE, MERGED = 1 << 20, 4
#: Ends of contexts are divided beyond TOO_LARGE times a bucket's share, but not below one part in FINEST of all
#: symbols: it bounds the tables of divided ends, which the driver gathers, at 256 x 6 x FINEST counts.
TOO_LARGE, FINEST = 2, 50_000
END_WORD = U(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def symbols_of(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Each symbol (bytes of the lower-case text, then its end) packed with the order bytes before it, in
    8 (order + 1) bits; the text that it belongs to; the lower-case bytes and their offsets."""
    data, offsets = flat(texts)
    data = LOWER[data]
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n, dtype=np.int32), sizes)
    padded = np.full(len(data) + n * (order + 1), START, dtype=np.uint8)
    padded[np.arange(len(data)) + (text + 1) * order + text] = data
    padded[offsets[1:] + np.arange(1, n + 1) * order + np.arange(n)] = STOP
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    at = np.arange(len(data) + n) + (owner + 1) * order
    packed = np.zeros(len(padded), dtype=U)
    wide = padded.astype(U)
    for j in range(order + 1):
        packed[order:] |= wide[j : len(padded) - order + j] << U(8 * (order - j))
    return packed[at], owner, (data, offsets)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(c, at)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word and of each text's end."""
    start, end, text = words(data, offsets)
    n = len(offsets) - 1
    return np.concatenate([np.maximum(hashes(data, start, end), U(1)), np.full(n, END_WORD)]), np.concatenate([text, np.arange(n)])


def _cuts(data: np.ndarray) -> list[int]:
    """Where a long text is cut: at blanks, about PIECE bytes apart."""
    out = [0]
    while len(data) - out[-1] > PIECE:
        at = out[-1] + PIECE
        blanks = np.flatnonzero(SPACE[data[at : at + PIECE]])
        while not len(blanks) and at < len(data):
            at += PIECE
            blanks = np.flatnonzero(SPACE[data[at : at + PIECE]])
        if not len(blanks):
            break
        out.append(at + int(blanks[0]) + 1)
    return [*out, len(data)]


def read(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, symbols, their texts, tokens, their texts) piece by piece, texts counted from the first; a long text takes several pieces."""
    for at, size in pieces(texts, PIECE):
        part = texts.slice(at, size)
        data, offsets = flat(part)
        if size > 1 or len(data) <= 2 * PIECE:
            symbols, owner, (data, offsets) = symbols_of(part)
            yield at, size, symbols, owner, *_tokens(data, offsets)
            continue
        data = LOWER[data]
        cuts = _cuts(data)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            before = np.concatenate([np.full(ORDER, START, np.uint8), data[max(0, a - ORDER) : a]])[-ORDER:]
            wide = np.concatenate([before, data[a:b], np.full(int(b == len(data)), STOP, np.uint8)]).astype(U)
            symbols = np.zeros(len(wide) - ORDER, U)
            for j in range(ORDER + 1):
                symbols |= wide[j : len(wide) - ORDER + j] << U(8 * (ORDER - j))
            tokens, _ = _tokens(data[a:b], np.array([0, b - a]))
            tokens = tokens if b == len(data) else tokens[:-1]  # the end comes once
            yield at, 1, symbols, np.zeros(len(symbols), np.int32), tokens, np.zeros(len(tokens), np.int64)


class Dealing:
    """Which bucket owns a context: by its last two bytes, or by more of them where those were divided.

    ends[d]: sorted ends of d bytes and their buckets, -1 where divided; counts[d]: for divided ends of d
    bytes the training counts of (end, symbol).
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for d, (ends, bucket) in self.ends.items():
            end = (keys[todo] >> U(8)) & U((1 << (8 * d)) - 1)
            out[todo] = bucket[find(ends, end)]
            todo = todo[out[todo] < 0]
        return out

    def divided(self, order: int) -> np.ndarray:
        """The divided ends of so many bytes."""
        return self.ends[order][0][self.ends[order][1] < 0] if order in self.ends else np.zeros(0, U)


def _end_counts(parents: np.ndarray, depth: int):
    """How often the ends of depth + 1 bytes below the parents (ends of depth bytes) occur, and the parents' training counts by symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longer, seen = ([np.zeros(0, U)], [np.zeros(0, np.int64)]), ([np.zeros(0, U)], [np.zeros(0, np.int64)])
        mask, deeper = U((1 << (8 * depth)) - 1), U((1 << (8 * (depth + 1))) - 1)
        for batch in batches:
            learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for at, _, symbols, text, _, _ in read(batch.column("text")):
                hit = find(parents, (symbols >> U(8)) & mask) >= 0
                symbols, text = symbols[hit], text[hit]
                for (keys, counts), found in ((longer, (symbols >> U(8)) & deeper), (seen, symbols[learn[at + text]] & deeper)):
                    k, c = _counts(found)
                    keys.append(k)
                    counts.append(c)
                    if len(keys) > MERGED:
                        k, c = _summed(keys, counts)
                        keys[:], counts[:] = [k], [c]
        for kind, (keys, counts) in enumerate((longer, seen)):
            k, c = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["kind", "key", "n"])

    return run


def dealing(rows: DataFrame, every: np.ndarray, buckets: int) -> Dealing:
    """Buckets filled evenly; every: how often each pair of bytes occurs, 256 x 256."""
    out, total = Dealing(buckets), int(every.sum())
    limit = max(TOO_LARGE * total / buckets, total / FINEST)
    ends, weight = np.arange(1 << 16, dtype=U), every.reshape(-1)
    leaves: list[tuple[int, int, int]] = []  # (weight, depth, position)
    for depth in range(2, ORDER + 1):
        large = (weight > limit) & (depth < ORDER)
        out.ends[depth] = (ends, np.where(large, -1, 0).astype(np.int32))
        leaves += [(int(w), depth, i) for i, w in enumerate(weight.tolist()) if not large[i]]
        if not large.any():
            break
        found = rows.mapInArrow(_end_counts(ends[large], depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
        tables = [sorted((r["key"] % (1 << 64), r["n"]) for r in found if r["kind"] == kind) for kind in (0, 1)]
        columns = lambda t: (np.array([k for k, _ in t], dtype=U), np.array([n for _, n in t], dtype=np.int64))
        (ends, weight), out.counts[depth] = columns(tables[0]), columns(tables[1])
    # the heaviest first, each into the bucket that has least so far
    heap = [(0, b) for b in range(buckets)]
    for w, depth, i in sorted(leaves, reverse=True):
        so_far, b = heap[0]
        heapq.heapreplace(heap, (so_far + w + 1, b))
        out.ends[depth][1][i] = b
    return out


def _distinct(block: pa.Table) -> tuple[np.ndarray, ...]:
    """Distinct symbols and tokens of a block, each with its count in training texts."""
    out = []
    keys: list[list] = [[], []]
    counts: list[list] = [[], []]
    texts, train = block.column("text").combine_chunks(), ~block.column("held_out").to_numpy()
    for at, _, symbols, text, tokens, owner in read(texts):
        for i, (k, t) in enumerate(((symbols, text), (tokens, owner))):
            seen = train[at + t]
            for part, weight in ((k[seen], 1), (k[~seen], 0)):
                d, c = _counts(part)
                keys[i].append(d)
                counts[i].append((c * weight).astype(np.int32))
            if len(keys[i]) > MERGED:
                d, c = _summed(keys[i], counts[i])
                keys[i], counts[i] = [d], [c]
    for i in range(2):
        out += [*_summed(keys[i], counts[i])]
    return tuple(out)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of the buckets that occur."""
    order = np.argsort(buckets, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], buckets[order][1:] != buckets[order][:-1]])) if len(order) else []
    for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(buckets[order[a]]), order[a:b]


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, all lowest bytes first: what is alike lies side by side for compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


_REPORT = "bucket long, block long, kind int, keys binary, counts binary"


def _report(deal):
    def run(block: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("bucket", "block", "kind", "keys", "counts")}
        symbols, n_symbols, tokens, n_tokens = _distinct(block)
        own, dealt = block.column("block")[0].as_py(), deal.value
        for kind, (k, c, b) in enumerate(((symbols, n_symbols, dealt.bucket_of(symbols)), (tokens, n_tokens, (tokens % U(dealt.buckets)).astype(np.int64)))):
            for bucket, at in _by_bucket(b):
                for name, value in zip(rows, (bucket, own, kind, planes(gaps(k[at])), planes(c[at].astype(np.uint32))), strict=True):
                    rows[name].append(value)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return run


def _with_divided(keys: np.ndarray, counts: np.ndarray, order: int, dealt: Dealing) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a bucket at an order, those of divided ends taken whole from the common table."""
    ends = dealt.divided(order)
    if not len(ends) or not len(keys):
        return keys, counts
    at = find(ends, keys >> U(8))
    if not (at >= 0).any():
        return keys, counts
    all_keys, all_counts = dealt.counts[order]
    here = np.isin(all_keys >> U(8), ends[np.unique(at[at >= 0])])
    return _summed([keys[at < 0], all_keys[here]], [counts[at < 0], all_counts[here]])


def log_probabilities(keys: np.ndarray, counts: np.ndarray, low: np.ndarray, dealt: Dealing) -> np.ndarray:
    """log10 P of each key (context and symbol) of whole branches: sorted distinct keys with training counts.

    low: training counts of (byte, symbol), 256 x 256, for orders 1 and 0. Escaping from a context leaves
    out exactly the symbols seen in it, for what a longer context has seen every shorter one has as well.
    """
    n = len(keys)
    out = np.zeros(n)
    open_ = np.ones(n, dtype=bool)  # symbol not yet coded
    level_keys, level_counts = keys[counts > 0], counts[counts > 0].astype(np.int64)
    levels = []
    for order in range(ORDER, 1, -1):
        mask = U((1 << (8 * (order + 1))) - 1)
        k, c = _summed([level_keys & mask], [level_counts])
        # a divided end may lack training counts of its own here, and still have some elsewhere
        missing = np.setdiff1d(dealt.divided(order)[np.isin(dealt.divided(order), (keys & mask) >> U(8))], k >> U(8)) if len(dealt.divided(order)) else []
        if len(missing):
            all_keys, all_counts = dealt.counts[order]
            here = np.isin(all_keys >> U(8), missing)
            k, c = _summed([k, all_keys[here]], [c, all_counts[here]])
        k, c = _with_divided(k, c, order, dealt)
        levels.append((order, k, c))
        level_keys, level_counts = k, c
    ones = np.argwhere(low > 0)
    levels.append((1, (ones[:, 0].astype(U) << U(8)) | ones[:, 1].astype(U), low[ones[:, 0], ones[:, 1]]))
    zero = low.sum(axis=0)
    levels.append((0, np.flatnonzero(zero).astype(U), zero[zero > 0]))
    upper_keys = upper_at = None  # the level above, and each wanted key's context there
    for order, k, c in levels:
        mask = U((1 << (8 * (order + 1))) - 1)
        context = k >> U(8)
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(k) else np.zeros(0, np.int64)
        totals = np.add.reduceat(c, starts) if len(k) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(starts, len(k)))
        at = find(context[starts], (keys & mask) >> U(8))
        known = at >= 0
        # what the context above has ruled out here: the counts here of the symbols seen there
        out_count, out_kinds = np.zeros(n), np.zeros(n)
        if upper_keys is not None and len(upper_keys[0]):
            up_k, up_starts, up_kinds = upper_keys
            here = find(k, up_k & mask)
            sums = np.add.reduceat(np.where(here >= 0, c[np.maximum(here, 0)], 0), up_starts)
            has = upper_at >= 0
            out_count[has] = sums[upper_at[has]]
            out_kinds[has] = up_kinds[upper_at[has]]
        rest = np.where(known, totals[np.maximum(at, 0)] if len(totals) else 0, 0) - out_count
        kinds_rest = np.where(known, kinds[np.maximum(at, 0)] if len(kinds) else 0, 0) - out_kinds
        mine = find(k, keys & mask)
        coded = open_ & (mine >= 0) & (rest > 0)
        out[coded] += np.log10((c[mine[coded]] - 0.5) / rest[coded])
        escaped = open_ & ~coded & (rest > 0)
        out[escaped] += np.log10(0.5 * kinds_rest[escaped] / rest[escaped])
        open_ &= ~coded
        upper_keys, upper_at = (k, starts, kinds), at
    seen = len(levels[-1][1])
    out[open_] -= np.log10(max(1, 256 - seen))
    return out


def _answer(low: np.ndarray, deal):
    def run(bucket: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("block", "bucket", "kind", "values", "kinds", "total")}
        kinds, blocks = bucket.column("kind").to_pylist(), bucket.column("block").to_pylist()
        keys = [np.cumsum(unplanes(x, np.uint64), dtype=U) for x in bucket.column("keys").to_pylist()]
        counts = [unplanes(x, np.uint32) for x in bucket.column("counts").to_pylist()]
        name = bucket.column("bucket")[0].as_py()

        def add(*values) -> None:
            for field, x in zip(rows, values, strict=True):
                rows[field].append(x)

        for kind in (0, 1):
            mine = [i for i, k in enumerate(kinds) if k == kind]
            if not mine:
                continue
            k, c = _summed([keys[i] for i in mine], [counts[i].astype(np.int64) for i in mine])
            value = log_probabilities(k, c, low, deal.value).astype(np.float32) if kind == 0 else c.astype(np.uint64)
            for i in mine:
                add(blocks[i], name, kind, planes(value[find(k, keys[i])]), 0, 0)
            if kind == 1:  # distinct tokens and tokens of the training texts
                add(-1, name, 2, b"", int((c > 0).sum()), int(c.sum()))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))

    return run


_ANSWER = "block long, bucket long, kind int, values binary, kinds long, total long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(deal, n_train: int, v_train: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=_NAMES)
        symbols, _, tokens, _ = _distinct(block)
        dealt = deal.value
        of = dict(zip(zip(answers.column("kind").to_pylist(), answers.column("bucket").to_pylist(), strict=True), answers.column("values").to_pylist(), strict=True))
        logp, count = np.zeros(len(symbols)), np.zeros(len(tokens))
        for kind, (b, into, dtype) in enumerate(((dealt.bucket_of(symbols), logp, np.float32), ((tokens % U(dealt.buckets)).astype(np.int64), count, np.uint64))):
            for bucket, at in _by_bucket(b):
                into[at] = unplanes(of[kind, bucket], dtype)
        log_count = np.log10(count + 1)
        texts = block.column("text").combine_chunks()
        n, known, base, score = (np.zeros(len(texts)) for _ in range(4))
        by_symbol, by_token = slots(symbols), slots(tokens)
        for at, size, k, text, h, owner in read(texts):
            here = slice(at, at + size)
            score[here] += np.bincount(text, weights=logp[find(symbols, k, by_symbol)], minlength=size)
            which = find(tokens, h, by_token)
            n[here] += np.bincount(owner, minlength=size)
            base[here] += np.bincount(owner, weights=log_count[which], minlength=size)
            known[here] += np.bincount(owner, weights=count[which] > 0, minlength=size)
        base -= n * np.log10(n_train + v_train + 1)
        longs = lambda x: pa.array(x.astype(np.int64))
        return pa.table([block.column("doc_id"), block.column("held_out"), longs(n), longs(known), pa.array(np.full(len(n), n_train, np.int64)), pa.array(base), pa.array(score)], names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in _SCORES.split(", ")]


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of (byte, symbol), their counts in all texts, and the bytes of all texts, one small report a task."""
    counts, every = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        texts, learn = batch.column("text"), ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for at, _, symbols, text, _, _ in read(texts):
            pair = (symbols & U(0xFFFF)).astype(np.int64)
            every += np.bincount(pair, minlength=1 << 16)
            counts += np.bincount(pair[learn[at + text]], minlength=1 << 16)
    pair = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[pair]), pa.array(every[pair])], names=["pair", "n", "every"])


def scores(docs: DataFrame) -> DataFrame:
    """One row a document: see ``_SCORES``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    # at most 65,536 rows come to the driver
    found = rows.mapInArrow(_low_counts, "pair long, n long, every long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("every").alias("every")).collect()
    low, every = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for r in found:
        low[r["pair"]], every[r["pair"]] = r["n"], r["every"]
    low = low.reshape(256, 256)
    blocks = max(1, -(-int(every.sum()) // BLOCK))
    context = docs.sparkSession.sparkContext
    deal = context.broadcast(dealing(rows, every, max(16, 2 * blocks)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    reports = dealt.groupBy("block").applyInArrow(_report(deal), _REPORT)
    answers = stage(reports.groupBy("bucket").applyInArrow(_answer(low, deal), _ANSWER), "answers")
    total = answers.where("kind = 2").agg(F.sum("total"), F.sum("kinds")).first()
    answers = answers.where("kind < 2")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(deal, total[0] or 0, total[1] or 0), _SCORES)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
