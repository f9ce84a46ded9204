"""Toxicity by class-conditional Kneser-Ney models.

Two models of the bytes of lower-case texts, one of toxic and one of ordinary documents, each interpolated
from eight-byte windows down to three-byte windows by Kneser-Ney continuation counts. Below that both back
off to the same counts, pooled over the classes, so that rare expressions are told apart only by what a
class has shown. The two log-likelihoods are compared, divided by the length, for the whole text and for its
most toxic word; beside these stands that word's undivided difference. A logistic function of the three,
fitted on labelled documents that the counts have not seen, makes them a score. (The whole text alone does
not do: a toxic word among hundreds of others hardly moves its mean; figures are in the README.)

Models are fitted, in one task on an executor, on a bounded sample of labelled rows: of each class the
documents with the least hash of their id, at most ``MOST_DOCS`` of them and at most ``MOST_CHARS`` characters
together, texts of over ``LONG_CHARS`` last. Everything fitted from it is therefore bounded and broadcast; every whole document is scored.

Defined results: a null text is the empty text; without toxic or without ordinary labelled rows every
score is the share of toxic labels (0 if there are none); repeated rows score alike; a null id hashes as an
empty string; an empty table gives an empty result; other columns are carried by ``toxicity_filter``.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.llm.flat import U, find, pieces, slots, words
from canopyql.llm.kept import kept
from canopyql.llm.ppm import gaps, planes, symbols_of, unplanes
from canopyql.session import table

N = 8
SHARED = 2
#: Windows from CUT bytes on are kept if they occur twice or more in the labelled sample.
CUT = 6
MOST_DOCS, MOST_CHARS = 1000, 4_000_000
#: Longer labelled texts are learned from only if there is room beside all others.
LONG_CHARS = MOST_CHARS // 40
#: Bytes of text worked on at a time, in scoring and in training.
PIECE, TRAIN_PIECE = 4 << 20, 256 << 10


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def _interpolation(keys: np.ndarray, counts: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """(window, discounted share), (context, weight of the shorter context) of one order and class.

    What the windows outside common would hold goes to the shorter context as well.
    """
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    discount = ones / (ones + 2 * twos) if ones and twos else 0.75
    context = keys >> U(8)
    at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
    kinds = np.diff(np.append(at, len(keys)))
    total = np.add.reduceat(counts, at) if len(keys) else np.zeros(0, np.int64)
    share = np.where(common, np.maximum(counts - discount, 0) / np.repeat(total, kinds), 0)
    weight = 1 - np.add.reduceat(share, at) if len(keys) else np.zeros(0)
    some = np.logical_or.reduceat(common, at) if len(keys) else np.zeros(0, bool)
    return keys[common], share[common], context[at][some], weight[some]


def fit(texts: list[str], toxic: np.ndarray) -> dict:
    """The two models: for each order the windows and contexts of either class with both classes' numbers."""
    model: dict = {"orders": []}
    by_class = []
    for c in (0, 1):
        chosen = pa.array([t for t, y in zip(texts, toxic, strict=True) if y == c], pa.string())
        found = [symbols_of(chosen.slice(at, size), N - 1)[0] for at, size in pieces(chosen, TRAIN_PIECE)]
        by_class.append(_counted(np.concatenate(found) if found else np.zeros(0, U)))
    shorter: list = [None, None]
    for n in range(N, SHARED, -1):
        parts = []
        both = np.concatenate([keys for keys, _ in by_class])
        often, pooled = _counted(both)
        total = np.zeros(len(often), np.int64)
        for keys, counts in by_class:
            total[find(often, keys)] += counts
        kept = often[total >= 2] if n >= CUT else often
        del both, pooled, total
        for c in (0, 1):
            keys, counts = by_class[c]
            parts.append(_interpolation(keys, counts, find(kept, keys) >= 0))
            # continuation counts: in how many longer windows a window ends
            shorter[c] = keys & U((1 << (8 * (n - 1))) - 1)
        by_class = [_counted(s) for s in shorter]
        windows, contexts = (np.union1d(parts[0][i], parts[1][i]) for i in (0, 2))
        share, weight = np.zeros((2, len(windows)), np.float32), np.ones((2, len(contexts)), np.float32)
        for c in (0, 1):
            share[c, find(windows, parts[c][0])] = parts[c][1]
            weight[c, find(contexts, parts[c][2])] = parts[c][3]
        model["orders"].append((n, windows, share, contexts, weight))
    # the shared end: pooled continuation counts of two-byte windows, then of single bytes, then all alike
    low = np.zeros((256, 256))
    for keys, counts in by_class:
        low[(keys >> U(8)).astype(int), (keys & U(255)).astype(int)] += counts
    single = (low > 0).sum(axis=0) + 1.0
    single /= single.sum()
    total, kinds = low.sum(axis=1, keepdims=True), (low > 0).sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        pair = np.where(total > 0, (np.maximum(low - 0.75, 0) + 0.75 * kinds * single) / total, single)
    model["pair"] = pair
    return model


def indexed(model: dict) -> dict:
    """The model with look-up tables for its windows and contexts."""
    return model | {"orders": [(n, w, share, c, weight, slots(w), slots(c)) for n, w, share, c, weight in model["orders"] if len(w)]}


def probabilities(model: dict, keys: np.ndarray) -> np.ndarray:
    """P(ordinary) and P(toxic) of the last byte of each window, given the bytes before it."""
    base = model["pair"][((keys >> U(8)) & U(255)).astype(int), (keys & U(255)).astype(int)]
    p = np.stack([base, base])
    for n, windows, share, contexts, weight, by_window, by_context in reversed(model["orders"]):
        low = keys & U((1 << (8 * n)) - 1)
        c = find(contexts, low >> U(8), by_context)
        at = np.flatnonzero(c >= 0)
        p[:, at] *= weight[:, c[at]]
        w = find(windows, low[at], by_window)
        at, w = at[w >= 0], w[w >= 0]
        p[:, at] += share[:, w]
    return p


def log_ratio(model: dict, keys: np.ndarray) -> np.ndarray:
    """ln P(toxic) - ln P(ordinary) of the last byte of each window."""
    p = probabilities(model, keys)
    return np.log(p[1]) - np.log(p[0])


def features(model: dict, texts: pa.Array) -> np.ndarray:
    """For each text the log ratio a symbol, the most toxic word's log ratio a symbol, and ln(1 + x) of the largest log ratio x of a word."""
    keys, owner, (data, offsets) = symbols_of(texts, N - 1)
    n = len(offsets) - 1
    distinct, _ = _counted(keys)
    value = log_ratio(model, distinct)[find(distinct, keys, slots(distinct))]
    out = np.zeros((n, 3))
    out[:, 0] = np.bincount(owner, weights=value, minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
    start, end, text = words(data, offsets)
    if len(start):
        sums = np.concatenate([[0.0], np.cumsum(value)])
        # a word with the symbol that ends it
        word = sums[end + text + 1] - sums[start + text]
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        has = text[first]
        out[has, 1] = np.maximum.reduceat(word / (end - start + 1), first)
        out[has, 2] = np.log1p(np.maximum(np.maximum.reduceat(word, first), 0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Weighted logistic regression by Newton steps, with a small ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 0.5 * np.eye(z.shape[1])
        beta += np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.5 * beta)
    return {"mean": mean, "spread": spread, "beta": beta}


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(at, id, toxic, text): the labelled rows to learn from, bounded as the module's text says; one text an id."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    at = F.xxhash64("id", F.lit(17))
    ids = [known.where(F.col("toxic") == c).select("id", "toxic", at.alias("at")).distinct().orderBy("at", "id").limit(MOST_DOCS) for c in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows of an id give its least text; the lengths of the picked documents, so far, say which ones fit
    rows = texts.join(F.broadcast(ids[0].union(ids[1])), "id").groupBy("at", "id", "toxic").agg(F.min("text").alias("text"))
    # long texts come last, the longest at the end, so that they take nothing from the others
    chars = F.char_length("text")
    so_far = Window.partitionBy("toxic").orderBy(F.greatest(chars - LONG_CHARS, F.lit(0)), "at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(chars).over(so_far)).where(F.col("total") <= MOST_CHARS).drop("total")


def fitted(texts: list[str], y: np.ndarray, share: float) -> dict | None:
    """Models and calibration from labelled texts; None without both classes. share: the part of toxic rows among all labelled ones."""
    if len(set(y.tolist())) < 2:
        return None
    # two thirds make the counts, one third the calibration
    third = np.arange(len(texts)) % 3 == 0
    if len(set(y[third].tolist())) < 2 or len(set(y[~third].tolist())) < 2:
        third[:] = True
        counted = np.ones(len(texts), dtype=bool)
    else:
        counted = ~third
    made = fit([t for t, k in zip(texts, counted, strict=True) if k], y[counted])
    model = indexed(made)
    probe = pa.array([t for t, k in zip(texts, third, strict=True) if k], pa.string())
    x = np.concatenate([features(model, probe.slice(a, n)) for a, n in pieces(probe, TRAIN_PIECE)])
    rate = y[third].mean()
    weight = np.where(y[third] == 1, share / rate, (1 - share) / (1 - rate))
    return {"model": made, "calibration": _logistic(x, y[third], weight * len(x) / weight.sum())}


def packed(made: dict) -> bytes:
    """Fitted models as few bytes: gaps between sorted keys, bytes of like weight side by side, compressed."""
    orders = [(n, planes(gaps(w)), planes(share.reshape(-1)), planes(gaps(c)), planes(weight.reshape(-1))) for n, w, share, c, weight in made["model"]["orders"]]
    return zlib.compress(pickle.dumps({"orders": orders, "pair": made["model"]["pair"].astype(np.float32), "calibration": made["calibration"]}))


def unpacked(data: bytes) -> dict:
    raw = pickle.loads(zlib.decompress(data))
    keys = lambda x: np.cumsum(unplanes(x, np.uint64), dtype=U)
    of_both = lambda x: unplanes(x, np.float32).reshape(2, -1)
    orders = [(n, keys(w), of_both(share), keys(c), of_both(weight)) for n, w, share, c, weight in raw["orders"]]
    return {"model": {"orders": orders, "pair": raw["pair"].astype(float)}, "calibration": raw["calibration"]}


def _fit_task(share: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("at", "ascending"), ("id", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        made = fitted(rows.column("text").to_pylist(), rows.column("toxic").to_numpy().astype(int), share)
        return pa.table({"model": pa.array([packed(made)] if made else [], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Models and calibration from labelled rows outside the held-out part, fitted in one task; the driver gets their arrays alone."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    share = float(known.agg(F.avg("toxic")).first()[0] or 0.0)
    made = sample(docs, labels).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit_task(share), "model binary").collect()
    return {"fitted": made[0]["model"], "name": uuid.uuid4().hex} if made else {"constant": share}


def _indexed(trained: dict) -> dict:
    """This process's copy of a broadcast model, with its look-up tables."""

    def make() -> dict:
        made = unpacked(trained["fitted"])
        return {"model": indexed(made["model"]), "calibration": made["calibration"]}

    return kept(trained["name"], make)


def scored(docs: DataFrame, trained: dict) -> DataFrame:
    """docs with score (0 to 1); all other columns are kept, a former score is replaced."""
    if "constant" in trained:
        return docs.withColumn("score", F.lit(trained["constant"]))
    shared = docs.sparkSession.sparkContext.broadcast(trained)
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = _indexed(shared.value)
        model, cal = made["model"], made["calibration"]
        for texts in batches:
            parts = [np.zeros(0)]
            for at, size in pieces(texts, PIECE):
                z = (features(model, texts.slice(at, size)) - cal["mean"]) / cal["spread"]
                parts.append(1 / (1 + np.exp(-np.clip(cal["beta"][0] + z @ cal["beta"][1:], -30, 30))))
            yield pa.array(np.concatenate(parts))

    return docs.withColumn("score", score(F.coalesce("text", F.lit(""))))


def toxicity_filter(docs: DataFrame, trained: dict, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below limit, with the columns of docs."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return scored(packed, trained).where(F.col("score") < limit).select("row.*")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
