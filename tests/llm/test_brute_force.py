"""Operators that SQL can't express, against plain Python or by held-out accuracy."""

import base64
import collections
import hashlib
import io
import math
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canopyql.llm import bpe, dedup, extraction, fingerprint, flat, ppm, quality, toxicity, warc
from canopyql.session import stage, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


# --- 1 ---------------------------------------------------------------------------------------------------


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("divided", [False, True])
def test_ppm(spark, sf, texts, monkeypatch, divided):
    if divided:  # many ends of contexts are divided, down to long ones
        for name, value in (("TOO_LARGE", 0.02), ("FINEST", 1 << 40)):
            monkeypatch.setattr(ppm, name, value)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall(lower(t)), None]
    count, trie = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]
    packed = lambda t: bytes([ppm.START] * ppm.ORDER) + lower(t).encode() + bytes([ppm.STOP])
    for i, t in texts.items():
        if not held(i):
            count.update(tokens(t))
            b = packed(t)
            for p in range(ppm.ORDER, len(b)):
                for k in range(ppm.ORDER + 1):
                    trie[k][b[p - k : p]][b[p]] += 1
    total, kinds = sum(count.values()), len(count)

    def score(t):
        b, s = packed(t), 0.0
        for p in range(ppm.ORDER, len(b)):
            out, x = set(), b[p]
            for k in range(ppm.ORDER, -1, -1):
                m = trie[k].get(b[p - k : p])
                if not m:
                    continue
                rest, n = sum(c for y, c in m.items() if y not in out), len(m) - len(out & set(m))
                if x in m and x not in out:
                    s += math.log10((m[x] - 0.5) / rest)
                    break
                if n:
                    s += math.log10(0.5 * n / rest)
                out |= set(m)
            else:
                s -= math.log10(256 - len(trie[0][b""]))
        return s

    got = {r["doc_id"]: r for r in ppm.op1_lm_score(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        r, w = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(count[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), rel_tol=1e-9)
    for i in sorted(texts)[:60]:
        if len(texts[i]) < 3000:
            assert math.isclose(got[i]["score"], score(texts[i]), rel_tol=1e-4)


def test_long_texts_are_read_in_parts(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["short One", None, "Ein langes WORT " * 40 + "x" * 300 + " é" * 50, ""])

    def all_of():
        symbols, tokens = collections.defaultdict(list), collections.defaultdict(list)
        for at, _, k, text, h, owner in ppm.read(texts):
            for x, y in zip((at + text).tolist(), k.tolist(), strict=True):
                symbols[x].append(y)
            for x, y in zip((at + owner).tolist(), h.tolist(), strict=True):
                tokens[x].append(y)
        return symbols, {k: sorted(v) for k, v in tokens.items()}

    whole = all_of()
    monkeypatch.setattr(ppm, "PIECE", 50)
    assert all_of() == whole


# --- 2 ---------------------------------------------------------------------------------------------------


def test_toxicity_tells_planted_words(spark):
    rows = []
    for i in range(240):
        words = [f"{a}{b}" for a, b in zip("baku" * 10, "lomitera" * 5)]
        words = [words[(i * 7 + j * j) % len(words)] + "aeiou"[(i + j) % 5] for j in range(40)]
        toxic = i % 4 == 0
        if toxic:
            words[i % 37] = "grumvex" + "aeiou"[i % 5] * (i % 3)
        rows.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.scored(d, toxicity.train(d, d)).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r["held"]]
    assert held and all(0 <= r["score"] <= 1 for r in out)
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.9


TOXIC_TEXTS = ["the mat sat on the cat", "a cat and a hat and the mat", "cat cat cat on a mat", "grr the zog bit the cat", "zog zog on the mat grr", "hat on the cat"]
TOXIC = np.array([0, 0, 0, 1, 1, 0])


def plain_kneser_ney(texts, toxic):
    """P(class)(context, byte) from dictionaries: windows of 8 bytes down to 3 by continuation counts, then pooled pairs."""
    counts, by_order = [], {}
    for c in (0, 1):
        n = collections.Counter()
        for t, y in zip(texts, toxic, strict=True):
            b = bytes([ppm.START] * 7) + t.encode() + bytes([ppm.STOP])
            n.update(b[i : i + 8] for i in range(len(b) - 7) if y == c)
        counts.append(n)
    for order in range(8, 2, -1):
        both = counts[0] + counts[1]
        kept = {w for w in both if both[w] >= 2 or order < toxicity.CUT}
        per_class = []
        for n in counts:
            ones, twos = sum(v == 1 for v in n.values()), sum(v == 2 for v in n.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.75
            total = collections.Counter()
            for w, v in n.items():
                total[w[:-1]] += v
            per_class.append((n, d, total))
        by_order[order] = (kept, per_class)
        counts = [collections.Counter(w[1:] for w in n) for n in counts]
    low = counts[0] + counts[1]
    before = collections.Counter(w[1] for w in low)
    single = {b: (before[b] + 1) / (sum(before.values()) + 256) for b in range(256)}

    def p(c, context, byte):
        pairs = {w: v for w, v in low.items() if w[0] == context[-1]}
        total = sum(pairs.values())
        out = single[byte]
        if total:
            out = (max(pairs.get(bytes([context[-1], byte]), 0) - 0.75, 0) + 0.75 * len(pairs) * single[byte]) / total
        for order in range(3, 9):
            kept, per_class = by_order[order]
            n, d, totals = per_class[c]
            ctx = context[-(order - 1) :]
            share = lambda w: max(n[w] - d, 0) / totals[ctx] if w in kept and n[w] else 0.0  # noqa: B023, E731
            if totals[ctx]:
                out *= 1 - sum(share(w) for w in n if w[:-1] == ctx)  # noqa: B023
            out += share(ctx + bytes([byte]))
        return out

    return p


def test_toxicity_models_against_plain_python():
    model = toxicity.indexed(toxicity.fit(TOXIC_TEXTS, TOXIC))
    p = plain_kneser_ney(TOXIC_TEXTS, TOXIC)
    for t in ("the zog sat", "a hat", "xyz"):
        b = bytes([ppm.START] * 7) + t.encode() + bytes([ppm.STOP])
        keys = np.array([int.from_bytes(b[i : i + 8], "big") for i in range(len(b) - 7)], dtype=np.uint64)
        got = toxicity.probabilities(model, keys)
        want = np.array([[p(c, b[i : i + 7], b[i + 7]) for i in range(len(b) - 7)] for c in (0, 1)])
        assert np.allclose(got, want, rtol=1e-5)
        for key in keys:
            every = (key & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
            assert np.allclose(toxicity.probabilities(model, every).sum(axis=1), 1, rtol=1e-5)


def test_toxicity_models_come_back_as_packed():
    made = toxicity.fitted(TOXIC_TEXTS * 4, np.tile(TOXIC, 4), 0.3)
    again = toxicity.unpacked(toxicity.packed(made))
    for x, y in zip(made["model"]["orders"], again["model"]["orders"], strict=True):
        assert x[0] == y[0] and all(np.array_equal(a, b) for a, b in zip(x[1:], y[1:], strict=True))
    assert np.allclose(made["model"]["pair"], again["model"]["pair"], rtol=1e-6)


def test_toxicity_features_against_plain_python():
    import pyarrow as pa

    model = toxicity.indexed(toxicity.fit(TOXIC_TEXTS, TOXIC))
    for t in ("Zog on  the mat", "", " \n", "cat"):
        b = bytes([ppm.START] * 7) + lower(t).encode() + bytes([ppm.STOP])
        keys = np.array([int.from_bytes(b[i : i + 8], "big") for i in range(len(b) - 7)], dtype=np.uint64)
        v = toxicity.log_ratio(model, keys)
        words = [v[m.start() : m.end() + 1] for m in WORD.finditer(t)]
        want = [v.mean(), max((w.mean() for w in words), default=0), math.log1p(max(0, max((w.sum() for w in words), default=0)))]
        assert np.allclose(toxicity.features(model, pa.array([t]))[0], want)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_CHARS", 50)
    rows = [(i, "x" * (20 if i % 3 else 45), i % 2) for i in range(1, 60)] + [(1, "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.sample(d, d).collect()
    for c in (0, 1):
        size = [len(r["text"]) for r in got if r["toxic"] == c]
        assert size and (len(size) == 1 or sum(size) <= 50)


@pytest.mark.parametrize("long_at", [0, 2])
def test_long_labelled_texts_take_nothing_from_others(spark, monkeypatch, long_at):
    """A text above the bound, first or third by hash, leaves all the others in the sample."""
    monkeypatch.setattr(toxicity, "MOST_CHARS", 4000)
    monkeypatch.setattr(toxicity, "LONG_CHARS", 100)
    ids = spark.range(60).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id", F.lit(17)), "id")
    ids = [r["id"] for r in ids.collect()]
    text = {i: "a few words" for i in ids} | {ids[long_at]: "long " * 1000, ids[long_at + 1]: "long " * 30}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    got = {r["id"] for r in toxicity.sample(docs, labels).collect()}
    assert got == set(ids) - {ids[long_at]}


# --- 3 ---------------------------------------------------------------------------------------------------

ODD = ["", "Hello, world's  café 12!!", "a'S don't ﬁ İx <|endoftext|> ok", "\xa0x　y\x1cz", "é ²³ ½x Ⅷ", "日本語 テスト", "ǅ Σς ß ΑΣ", "a\x00b​c_d __", "aaaaaaaaaaaaaaaaaaaaaaaaaa hahahahaha", "<|startoftext|><|endoftext|>", "x" * 5000]


def test_bpe_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    all_texts = [*ODD, *texts.values()]
    d = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.with_digests(bpe.encode_decode(d)).collect()}
    for i, t in enumerate(all_texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_automaton_equals_merging():
    """On a toy vocabulary, all words up to seven letters."""
    letters = bpe.byte_letters()
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("ba", "ba"), ("aa", "b</w>"), ("ab", "ab</w>"), ("a", "b</w>"), ("b", "b"), ("bb", "a</w>"), ("aba", "ba")]
    tokens = list(dict.fromkeys([*letters, *[c + "</w>" for c in letters], *[x + y for x, y in merges]]))
    vocab = {t: i for i, t in enumerate(tokens)}
    auto = bpe.Automaton(vocab, merges)
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while True:
            best = min(((rank.get(p, 99), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(99, 0))
            if best[0] == 99:
                return [vocab[p] for p in parts]
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    for n in range(1, 8):
        for bits in range(2**n):
            word = "".join("ab"[bits >> k & 1] for k in range(n))
            assert auto.encode(word) == plain(word), word


# --- 4 ---------------------------------------------------------------------------------------------------


def test_warc_file_round_trip(spark):
    big = "x<y>" * (warc.CHUNK // 2)
    pages = spark.createDataFrame([(1, "http://a/ü x", big), (2, "http://b/", big), (3, "http://c/", None), (4, None, "é")], "page_id long, url string, html string")
    path = warc.write_archives(pages)
    rows = sorted(spark.read.parquet(path).select("archive", "record", "chunk", "data").collect(), key=lambda r: (r["archive"], r["record"], r["chunk"]))
    assert max(len(r["data"]) for r in rows) <= warc.CHUNK
    stream = io.BytesIO(b"".join(warc.to_file((r["record"], r["chunk"], r["data"]) for r in rows)))
    bodies = {f["x-page-id"]: (f, b.partition(b"\r\n\r\n")[2]) for f, b in warc.parse(stream)}
    assert bodies["1"][1] == big.encode() and bodies["2"][1] == b"" and bodies["4"][1] == "é".encode()
    assert bodies["2"][0]["warc-type"] == "revisit" and bodies["2"][0]["x-refers-to-page-id"] == "1"
    assert bodies["4"][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()
    lost = spark.read.parquet(path).where("chunk <> 1")
    lost.write.parquet(path + "-lost")
    with pytest.raises(Exception, match="lost or changed|not what its headers say"):
        warc.read_archives(spark, path + "-lost").collect()


# --- 5 ---------------------------------------------------------------------------------------------------


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        out[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    return out


def brute_classes(texts, similarity=0.8):
    sets, up = sets_of(texts), {i: i for i in texts}
    size = {i: s.total() for i, s in sets.items()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            common = 0
            if min(size[a], size[b]) >= similarity * max(size[a], size[b]) and len(x.keys() & y.keys()):
                common = (x & y).total()
            if texts[a] == texts[b] or (common and common >= similarity * (size[a] + size[b] - common) - 1e-9):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_dedup(spark, sf, texts, monkeypatch, similarity):
    monkeypatch.setattr(dedup, "BLOCK", 20)
    monkeypatch.setattr(dedup, "MANY", 30)
    base = [f"w{i * i % 997}" for i in range(400)]
    more = {1_000_000 + k: " ".join([*base[: 5 * k], *(f"k{k}x{j}" for j in range(3)), *base[5 * k + 3 :]]) for k in range(40)}
    more |= {2_000_000 + k: " ".join(base[:200] + [f"z{k}y{j}" for j in range(60 + k)]) for k in range(60)}
    # alike as sets, but not by their counts
    more |= {3_000_000 + k: " ".join(base[:30] * (1 + 3 * k)) for k in range(3)}
    every = texts | more
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(d, similarity).collect()}
    assert got == brute_classes(every, similarity)


def test_bands_for_a_similarity():
    assert (dedup.band_rows(0.8), dedup.least_agreeing(0.8)) == (4, 75)
    assert (1 - 0.8**4) ** 32 < 5e-8 and dedup.band_rows(0.5) < 4


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    texts = ["ab " * 50, "x", " \n ", "one two three four", " ".join(f"w{i % 37}" for i in range(500)), "q" * 300 + " a b c d e f " + "r" * 200 + " a b c d e f"]
    want = [[x.tolist() for x in dedup._sets(pa.array([t]))] for t in texts]
    monkeypatch.setattr(dedup, "LONG", 16)
    assert [[x.tolist() for x in dedup._sets(pa.array([t]))] for t in texts] == want


def test_deduplicate_keeps_one_row_a_class(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a, "p"), (5, b, "q"), (5, b, "q2"), (None, b, "r"), (None, "lone words of nobody", "s"), (None, "other words of nobody else", "t"), (7, a + " more", "u"), (9, "", "v"), (9, None, "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, class_id string").withColumn("row", F.lit(1)).withColumn("label", F.lit(2)).withColumn("key", F.lit(3))
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in dedup.deduplicate(d).collect())
    assert kept == [(0, "lone words of nobody"), (0, "other words of nobody else"), (5, a), (5, b), (9, "")]
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in dedup.classes(d).collect()) == [(0, 0), (0, 0), (0, 5), (5, 5), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]


def test_components_with_hubs(spark, monkeypatch):
    from canopyql.llm import components as c

    monkeypatch.setattr(c, "HUB", 5)
    links = [(0, i) for i in range(1, 20)] + [(i, i + 1) for i in range(100, 140)] + [(140, 19)] + [(200, 201)]
    got = {r["node"]: r["label"] for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {0, 200} and sum(v == 0 for v in got.values()) == 61


def test_component_rounds_read_open_links_alone(spark, monkeypatch):
    from canopyql.llm import components as c

    made = []

    def counted(df, what="stage"):
        out = stage(df, what)
        made.append((what, out.count()))
        return out

    stage = c.stage
    monkeypatch.setattr(c, "stage", counted)
    order = np.random.default_rng(3).permutation(400).tolist()
    # a path in random order, a star, and a node with itself
    links = [(order[i], order[i + 1]) for i in range(299)] + [(order[300], order[i]) for i in range(301, 399)] + [(order[399], order[399])]
    want = {x: min(order[:300]) for x in order[:300]} | {x: min(order[300:399]) for x in order[300:399]} | {order[399]: order[399]}
    for limit in (10**6, 0):
        monkeypatch.setattr(c, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(c, "HUB", 20)
        made.clear()
        got = c.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == len(want) and {r["node"]: r["label"] for r in got} == want
        rows = [n for what, n in made if what == "links"]
        assert rows[-1] == 0 and sum(rows) <= 2 * rows[0]
    assert c.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_dedup_joins_labels_of_components_alone(spark, monkeypatch):
    from canopyql.llm import components as c

    given = []
    monkeypatch.setattr(dedup, "components", lambda links: given.append([(r["a"], r["b"]) for r in links.collect()]) or c.components(links))
    # hubs find only some of the links; the bands' own comparison must find what joins the rest
    found = dedup._Search.verified
    monkeypatch.setattr(dedup._Search, "verified", lambda self, pairs: found(self, pairs).where("(a + b) % 5 = 0"))
    base = [f"w{i * i % 997}" for i in range(400)]
    rows = {k: " ".join([*base[: 5 * k], *(f"k{k}x{j}" for j in range(16)), *base[5 * k + 16 :]]) for k in range(70)}
    got = {r["doc_id"]: r["class_id"] for r in dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(1), 0.8).collect()}
    assert got == brute_classes(rows, 0.8)
    # the second time the links that are known already stay out
    assert len(given) == 2 and given[1] and not set(given[0]) & set(given[1])


def test_workers_keep_one_table():
    from canopyql.llm import kept

    kept.forget()
    assert kept.kept("model", lambda: [1]) == [1] and kept.kept("model", lambda: [2]) == [1]
    assert kept.kept("codec", lambda: [3]) == [3] and list(kept._KEPT) == ["codec"]
    list(dedup._sketch(5)(iter(())))
    assert not kept._KEPT


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    names = r.integers(0, 2**63, 300).astype(np.uint64)
    a, b = r.integers(1, 6, 300).astype(float), r.integers(1, 6, 300).astype(float)
    a[:60] = 0
    b[240:] = 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    rows = [(names[x > 0], x[x > 0]) for x in (a, b)]
    s = dedup.dart_signatures(np.concatenate([n for n, _ in rows]), np.repeat([0, 1], [len(n) for n, _ in rows]), np.concatenate([w for _, w in rows]), 2, 2048)
    assert abs((s[0] == s[1]).mean() - want) < 0.05


# --- 6 ---------------------------------------------------------------------------------------------------


def test_extraction_on_unseen_layouts():
    field = extraction.Field(*extraction.trained())
    right = total = 0
    for html, labels in extraction.labelled_pages(120, 4321):
        got = field.labels(extraction.blocks(html))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.98


def every_path(n):
    return [[k >> i & 1 for i in range(n)] for k in range(1 << n)]


def test_viterbi_against_all_paths():
    found = extraction.blocks("<nav><a href=/>A</a></nav><article><h1>T</h1><p>Some words, here.</p><aside>Buy</aside><p>More, and more.</p></article><div>x</div><footer>f</footer>")
    r = np.random.default_rng(2)
    names = sorted({f for i, b in enumerate(found) for f in [*b.path, *extraction.text_features(b, i / len(found))]})
    for _ in range(20):
        field = extraction.Field(dict(zip(names, r.normal(size=len(names)) * 2, strict=True)), r.normal(size=(2, 2)).tolist())
        e = [sum(field.weights[f] for f in [*b.path, *extraction.text_features(b, i / len(found))]) for i, b in enumerate(found)]
        best = max(every_path(len(e)), key=lambda y: sum(s for s, x in zip(e, y, strict=True) if x) + sum(field.pairs[a][b] for a, b in zip(y, y[1:])))  # noqa: B023
        assert field.labels(found) == [bool(x) for x in best]


def test_expectations_against_all_paths():
    r = np.random.default_rng(4)
    e, pairs, size = r.normal(size=(3, 5, 2)), r.normal(size=(2, 2)), [5, 3, 1]
    real = np.arange(5)[None, :] < np.array(size)[:, None]
    e[~real] = 0
    z, p, joint = extraction.expectations(e, pairs, real)
    want_joint = np.zeros((2, 2))
    for i, n in enumerate(size):
        weight = {tuple(y): math.exp(sum(e[i, t, x] for t, x in enumerate(y)) + sum(pairs[a, b] for a, b in zip(y, y[1:]))) for y in every_path(n)}
        total = sum(weight.values())
        assert math.isclose(z[i], math.log(total))
        for t in range(n):
            assert math.isclose(p[i, t], sum(w for y, w in weight.items() if y[t]) / total)
        for y, w in weight.items():
            for a, b in zip(y, y[1:]):
                want_joint[a, b] += w / total
    assert np.allclose(joint, want_joint)


def test_extraction_of_odd_tags():
    field = extraction.Field(*extraction.trained())
    page = "<article><h1>Title of it</h1><p data-x=it's class=b>First paragraph, with words and more words.</p><textarea>form field</textarea><p title=\"a>b\">Second paragraph, it's long enough too.</p><p title=\"open>Third paragraph, with some words.</p></article>"
    got = extraction.main_text(field, page).split("\n")
    assert got == ["Title of it", "First paragraph, with words and more words.", "Second paragraph, it's long enough too.", "Third paragraph, with some words."]


def test_extraction_of_a_page():
    page = """<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text&nbsp;here, with some words.<br>And more of it.</p><aside class="ad">Buy now!</aside>
    <p>Second paragraph, quite long, with enough words to be text.</p></article><section class="comments"><p>Nice post!</p></section><form><label>Name</label></form><footer>&copy; x</footer>"""
    got = extraction.main_text(extraction.Field(*extraction.trained()), page)
    assert got == "A & B\nFirst bold text here, with some words. And more of it.\nSecond paragraph, quite long, with enough words to be text."


def test_extraction_of_pages(spark, sf):
    for r in extraction.op6_html_text(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html

        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


# --- 8 ---------------------------------------------------------------------------------------------------


def test_quality_base_and_verdicts(spark, sf, texts):
    got = {r["doc_id"]: r for r in quality.op8_quality(spark, sf).collect()}
    for i, t in texts.items():
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + k for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    good = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    bad = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def numpy_estimate(x, spread):
    """Centre and covariance of rows in units, with the least spreads."""
    y = x / quality.UNIT
    return y.mean(0), np.cov(y.T, bias=True) * spread + np.diag([s**2 for s in quality.STATS.values()])


def numpy_distance(x, centre, cov):
    y = x / quality.UNIT - centre
    return np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov), y)


def points(spark, x, name=None):
    return spark.createDataFrame([(0, name, None, *map(int, v)) for v in x], "level int, g_lang string, g_source string, " + ", ".join(f"s_{k} long" for k in quality.STATS))


def test_mahalanobis_is_the_distance(spark):
    r = np.random.default_rng(3)
    x = (r.normal(size=(500, 5)) @ r.normal(size=(5, 5)) * 400 + 4000).round().astype(int)
    rows = points(spark, x)
    e = quality.shaped(quality.moments(rows, quality.GROUP), 1.3).select("centre", "factor", "log_det").first()
    centre, cov = numpy_estimate(x, 1.3)
    got = quality._with_distance(rows.crossJoin(spark.createDataFrame([(e["centre"], e["factor"])], "centre array<double>, factor array<double>")))
    assert np.allclose(sorted(v["d2"] for v in got.collect()), sorted(numpy_distance(x, centre, cov)), rtol=1e-6)
    assert math.isclose(e["log_det"], np.linalg.slogdet(cov)[1] / 2, rel_tol=1e-9)


def test_chi_square_levels():
    draws = (np.random.default_rng(1).normal(size=(400_000, 5)) ** 2).sum(1)
    for level in (0.5, 0.975):
        q = quality.quantile(level)
        assert abs((draws < q).mean() - level) < 0.003
        assert abs(quality.consistency(level) * draws[draws < q].mean() / 5 - 1) < 0.01


def clustered(seed, share, width):
    """260 good rows, and beside them a cluster of junk, width units wide, that is a share of all."""
    r = np.random.default_rng(seed)
    good = r.normal(size=(260, 5)) @ np.diag([300, 200, 150, 400, 250]) + 3000
    bad = r.normal(size=(round(260 * share / (1 - share)), 5)) * width + [5200, 1500, 4200, 800, 5000]
    return np.concatenate([good, bad]).round().astype(int)


def numpy_cells(x):
    """Means and weights of the cells, in whole units, in plain NumPy."""
    at = np.floor(x / (quality.UNIT * quality.WIDE * np.array(list(quality.STATS.values()))))
    _, of, n = np.unique(at, axis=0, return_inverse=True, return_counts=True)
    means = np.stack([np.bincount(of.ravel(), weights=v) for v in x.T], axis=1) / n[:, None]
    return np.floor(means + 0.5).astype(int), np.floor(n**quality.POWER * quality.WEIGHT + 0.5).astype(int)


def numpy_half(y, w, subset):
    """Steps to a determinant that falls no more, from a subset of the cells."""
    size, weighed = w.sum(), lambda rows: np.repeat(y[rows], w[rows], axis=0)
    centre, cov = numpy_estimate(weighed(subset), 1.0)
    before = np.inf
    while True:
        bins = np.floor(np.log1p(numpy_distance(y, centre, cov)) * 64)
        order = np.argsort(bins)
        limit = bins[order][np.searchsorted(np.cumsum(w[order]), size // 2 + 1)]
        centre, cov = numpy_estimate(weighed(bins <= limit), quality.consistency(0.5))
        now = np.linalg.slogdet(cov)[1] / 2
        if now > before - 1e-6:
            return now, centre, cov
        before = now


@pytest.mark.parametrize("share, width", [(0.28, 30), (0.35, 60), (0.45, 0)])
def test_minimum_determinant_against_numpy(spark, share, width):
    """The same half of least determinant as steps in NumPy from many random starts, the same verdicts, and no cluster passes."""
    x = clustered(8, share, width)
    y, w = numpy_cells(x)
    r = np.random.default_rng(8)
    best = min((numpy_half(y, w, r.choice(len(y), 12, replace=False)) for _ in range(60)), key=lambda s: s[0])
    rows = points(spark, x, "en")
    found = quality.cells(rows)
    assert sorted((*v, n) for v, n in zip(y.tolist(), w.tolist(), strict=True)) == sorted((*[c[f"s_{a}"] for a in quality.NAMES], c["w"]) for c in found.collect())
    got = quality.half_estimates(found, True, quality.quartiles_of(found)).first()
    # the starts come within a twentieth of what sixty find
    assert got["log_det"] <= best[0] + 0.05
    # the verdicts: near rows, the prior of the only language (the group itself), and the last cut
    centre, cov = numpy_estimate(x[numpy_distance(x, best[1], best[2]) <= quality.quantile(0.975)], quality.consistency(0.975))
    want = numpy_distance(x, centre, cov) <= quality.quantile(quality.LEVEL)
    e = quality.estimates(rows.drop("level").withColumnsRenamed({"g_lang": "lang", "g_source": "source"})).first()
    factor = np.zeros((5, 5))
    factor[np.tril_indices(5)] = e["factor"]
    kept = numpy_distance(x, np.array(e["centre"]), factor @ factor.T) <= quality.quantile(quality.LEVEL)
    assert not kept[260:].any() and kept[:260].all() and (kept == want).all()


def test_breaking_point(spark):
    """What the README states: a cluster of junk that is half as wide as good rows passes at 45 % of its group; at 35 % none does."""
    verdict = {}
    for share in (0.35, 0.45):
        x = clustered(8, share, 120)
        e = quality.estimates(points(spark, x, "en").drop("level").withColumnsRenamed({"g_lang": "lang", "g_source": "source"})).first()
        factor = np.zeros((5, 5))
        factor[np.tril_indices(5)] = e["factor"]
        verdict[share] = (numpy_distance(x, np.array(e["centre"]), factor @ factor.T) <= quality.quantile(quality.LEVEL))[260:].mean()
    assert verdict == {0.35: 0.0, 0.45: 1.0}


def test_groups_are_drawn_towards_their_language(spark):
    """One lone row of a source is judged by its language's kind."""
    r = np.random.default_rng(9)
    x = (r.normal(size=(300, 5)) * 100 + 3000).round().astype(int)
    rows = points(spark, x, "en").withColumn("g_source", F.lit("big")).unionByName(points(spark, [[9000, 9000, 9000, 9000, 9000]], "en").withColumn("g_source", F.lit("small")))
    e = {v["g_source"]: v for v in quality.estimates(rows.drop("level").withColumnsRenamed({"g_lang": "lang", "g_source": "source"})).collect()}
    assert abs(e["big"]["centre"][0] - 3000 / quality.UNIT) < 0.1
    assert e["small"]["centre"][0] < 4000 / quality.UNIT


@pytest.mark.parametrize("share", [0.28, 0.36, 0.45])
def test_copies_of_junk_do_not_pass(spark, share):
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(400)]
    good = [" ".join(str(w).title() if k % 12 == 0 else str(w) for k, w in enumerate(r.choice(words, n))) for n in r.integers(80, 200, 400)]
    junk = " ".join(f"#{w.upper()}$%|<" for w in words[:120])
    rows = [(0, t) for t in good] + [(1, junk)] * int(400 * share / (1 - share))
    docs = spark.createDataFrame([(k, t, "en", "a") for k, t in rows], "junk int, text string, lang string, source string")
    kept = collections.Counter(x["junk"] for x in quality.quality_filter(docs).collect())
    assert kept[1] == 0 and kept[0] > 380


# --- 10 --------------------------------------------------------------------------------------------------


def test_fingerprints(spark, sf, texts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.op10_fingerprint(spark, sf).collect()}
    by_text = {}
    for n, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(n + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
        a, b = (collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (t.split(), edited.split()))
        if len(a) > 100:
            want = sum((a & b).values()) / sum((a | b).values())
            assert abs(got[i]["near_edited"] - want) < 0.25
            assert got[i]["near_next"] < 0.2 or t == nxt or len(set(a) & {tuple(nxt.split()[j : j + 5]) for j in range(len(nxt.split()))}) > 0.05 * len(a)


def test_neighbours_in_every_cut(spark, monkeypatch):
    """Ties, nulls and repeated rows, with stretches of very few ids each."""
    monkeypatch.setattr(fingerprint, "PART", 20)
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "n1"), (None, "n0"), (50, "again"), (50, "again"), (100, "z"), (0, "a"), (-5, "")]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = collections.Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter((r["doc_id"], r["text"], r["next"]["text"]) for r in got.collect()) == want


def test_samples_against_plain_python(spark):
    """Every (position, term, t) of the least a, from the variates as the module's text defines them."""
    line = " ".join(f"s{i}" for i in range(6)) + " "
    rows = [(c, line * c + " ".join(f"u{i}" for i in range(40)) + " " + "v w x y z " * (c // 2)) for c in (1, 2, 5, 30)]
    d = spark.createDataFrame(rows, "k int, text string")
    words = F.transform(F.split(F.trim("text"), " "), lambda x: F.xxhash64(x))
    terms = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, F.lit(5))))
    hashes = d.withColumn("w", words).withColumn("t", terms).select("k", F.explode("t").alias("h")).groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"))
    draws = hashes.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(127).cast("long"))))
    draws = draws.select("k", "h", "n", "j", F.xxhash64("h", "j").alias("f"), F.xxhash64("h", "j", F.lit(1)).alias("o"))
    least = {}
    for r in draws.collect():
        f, o = r["f"] % 2**64, r["o"] % 2**64
        half = lambda x: (x + 0.5) * 2.0**-32
        x = -math.log1p(-((r["j"] << 33 | f >> 31) + 0.5) * 2.0**-40)
        w, e = -math.log(half(o >> 32)), -math.log(half(o & 0xFFFFFFFF))
        c, rr = x + e, math.log((x + e) / x) + w
        b, s = w / rr, r["n"]
        t = math.floor(math.log(s) / rr + b)
        ln_y = rr * (t - b)
        a = math.exp(math.log(c) - ln_y - rr)
        position = (r["h"] ^ r["j"]) & 127
        key = (r["k"], position)
        least[key] = min(least.get(key, (9e9,)), (a, r["h"], t, f))
    got = {r["k"]: r["s"] for r in fingerprint.signature(d, "text", "s").collect()}
    later = spark.createDataFrame([(k, p, h, (h ^ p) & 127, t) for (k, p), (_, h, t, _) in least.items()], "k int, p int, h long, j long, t long")
    tags = {(r["k"], r["p"]): r["x"] % 2**64 >> 15 & 0xFFFF for r in later.select("k", "p", F.xxhash64("h", "j", "t", F.lit(2)).alias("x")).collect()}
    for (k, p), (_, _, t, f) in least.items():
        assert got[k][p] == (f >> 15 & 0xFFFF if t == 0 else tags[k, p])


def test_signature_rate_is_generalised_jaccard(spark):
    base = [f"t{i}" for i in range(900)]
    rows = [(k, " ".join(base[: 900 - 100 * k] + [f"n{k}_{i}" for i in range(100 * k)])) for k in range(8)]
    d = fingerprint.signature(spark.createDataFrame(rows, "k int, text string"), "text", "s")
    pairs = d.crossJoin(d.where("k = 0").select(F.col("s").alias("s0"), F.col("text").alias("t0"))).select("text", "t0", fingerprint.likeness(F.col("s"), F.col("s0")).alias("x"))
    off = []
    for r in pairs.collect():
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (r["text"].split(), r["t0"].split()))
        off.append(r["x"] - len(a & b) / len(a | b))
    assert max(map(abs, off)) < 0.16 and abs(float(np.mean(off))) < 0.06


def test_signature_of_unequal_weights(spark):
    texts = []
    for k in range(1, 7):
        line = " ".join(f"s{k}_{i}" for i in range(6)) + " "
        texts += [(2 * k + v, line * 60 * k + " ".join(f"u{k}_{v}_{i}" for i in range(300)) + " " + line * (20 * v)) for v in range(2)]
    got = {r["k"]: r for r in fingerprint.signature(spark.createDataFrame(texts, "k int, text string"), "text", "s").collect()}
    off = []
    for k in range(2, 14, 2):
        a, b = (collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (got[k + v]["text"].split() for v in range(2)))
        agree = np.mean([x == y for x, y in zip(got[k]["s"], got[k + 1]["s"], strict=True)])
        off.append(agree - sum((a & b).values()) / sum((a | b).values()))
    assert max(map(abs, off)) < 0.16 and abs(float(np.mean(off))) < 0.06


def test_signature_with_limit_is_that_of_all_draws(spark, monkeypatch):
    line = " ".join(f"s{i}" for i in range(6)) + " "
    rows = [(n * 10 + c, line * c + " ".join(f"u{n}_{i}" for i in range(n))) for n in (1, 3, 7, 30, 300, 2000) for c in (0, 2, 9, 80)]
    d = spark.createDataFrame(rows, "k int, text string")
    got = {r["k"]: r["s"] for r in fingerprint.signature(d, "text", "s").collect()}
    monkeypatch.setattr(fingerprint, "ENOUGH", 1_000_000)
    assert got == {r["k"]: r["s"] for r in fingerprint.signature(d, "text", "s").collect()}
    monkeypatch.setattr(fingerprint, "ENOUGH", 1)
    assert got == {r["k"]: r["s"] for r in fingerprint.signature(d, "text", "s").collect()}


# --- shared ----------------------------------------------------------------------------------------------


def test_words_and_hashes():
    import pyarrow as pa

    data, offsets = flat.flat(pa.array(["a bb", None, " é\tccc ", "dd"]))
    start, end, text = flat.words(data, offsets)
    assert [bytes(data[s:e]).decode() for s, e in zip(start, end, strict=True)] == ["a", "bb", "é", "ccc", "dd"]
    assert text.tolist() == [0, 0, 2, 2, 3]
    twice, off = flat.flat(pa.array(["x dd y dd"]))
    h = flat.hashes(twice, *flat.words(twice, off)[:2])
    assert h[1] == h[3] and len(set(h.tolist())) == 3


def test_pipeline_stages(spark, sf, texts):
    import corpus_pipeline as p

    documents = table(spark, sf, "documents")
    kept = documents
    verdict = {r["doc_id"]: r["kept"] for r in quality.op8_quality(spark, sf).collect()}
    kept = p.quality_rules(spark, documents, sf)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdict.items() if k}
    calm = p.toxic_documents(spark, kept, sf)
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    ids = {r["doc_id"] for r in calm.collect()}
    assert calm.columns == documents.columns and len(ids & toxic) <= 0.3 * len({i for i in toxic if verdict[i]})
    one = p.near_duplicates(spark, calm, sf)
    assert {r["doc_id"] for r in one.collect()} == set(brute_classes({i: texts[i] for i in ids}).values())
    mixed = p.source_mixture(spark, one, sf)
    assert mixed.columns == documents.columns
    last = p.run(spark, sf)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in mixed.collect())


def test_pipeline_leaves_what_other_threads_write(spark, sf, monkeypatch):
    """Two queries of one session at once: a stage's end deletes what the stage itself wrote, and nothing else."""
    import corpus_pipeline as p

    others, own = [], []

    def step(session, docs, sf_dir):
        thread = threading.Thread(target=lambda: others.append(stage(session.range(3).toDF("n"), "other")))
        thread.start()
        thread.join()
        own.append(stage(docs.select("doc_id"), "own").inputFiles()[0])
        return docs

    monkeypatch.setattr(p, "STAGES", [("first", step), ("second", step), ("last", lambda session, docs, sf_dir: docs)])
    assert p.run(spark, sf).count() == table(spark, sf, "documents").count()
    assert [x.count() for x in others] == [3, 3]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    assert not any(path(x).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(x)) for x in own)
