"""Clusters, vector codes and URL verdicts on small awkward tables, against plain Python and against their SQL."""

import collections
import hashlib
import itertools
import math
import re

import duckdb
import numpy as np
import pytest

from canopyql.llm import balls, codes, lattice, urls

DIM = 64
SCHEMA = "vec_id long, embedding array<float>, label int, x string, cluster double, error string"


def planted(seed=5, n=700):
    """Clusters far apart, a third of the rows equal, close ties, and vectors that are none."""
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, DIM)) * 3
    rows = [(i, (centre[i % 6] + r.normal(size=DIM) * (0.02 if i % 2 else 0.6)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, centre[0].astype(np.float32).tolist()) for i in range(n // 2)]
    rows += [(3, [0.5] * DIM), (3, [-0.5] * DIM), (None, [0.25] * DIM), (5000, None), (5001, [1.0] * (DIM - 1)), (5002, [])]
    rows += [(5003, [None, *[1.0] * (DIM - 1)]), (5004, [math.nan, *[1.0] * (DIM - 1)]), (5005, [-math.inf, *[1.0] * (DIM - 1)]), (5006, [40.0 if i % 2 else -40.0 for i in range(DIM)])]
    return [(i, v, None if k % 3 == 0 else k % 4, "e", 0.5, None) for k, (i, v) in enumerate(rows)]


def kept(rows, dim=DIM):
    return [(r[0], r[2], [math.floor(1024 * x) for x in r[1]]) for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(vectors, book, rounds):
    nearest = lambda v: min(range(len(book)), key=lambda c: (squared(v, book[c]), c))
    for _ in range(rounds):
        to = [nearest(v) for v in vectors]
        groups = [[v for v, c in zip(vectors, to, strict=True) if c == k] for k in range(len(book))]
        book = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else old for g, old in zip(groups, book, strict=True)]
    return [nearest(v) for v in vectors], book


def against_sql(sql, name, rows, got, schema):
    import pandas as pd

    d = pd.DataFrame(rows, columns=schema)
    for c in ("vec_id", "label", "page_id"):
        if c in d:
            d[c] = d[c].astype("Int64")
    con = duckdb.connect()
    con.register("given", d)
    con.sql(f"CREATE TABLE {name} AS SELECT * FROM given")
    want = con.sql(sql)
    order = want.columns
    return sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in order)) for r in got)


def test_clusters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(balls, "BLOCK", 100)
    monkeypatch.setattr(balls, "LEAF", 4)
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA)
    placed, final = balls.clusters(df, k=5, rounds=4)
    vectors = kept(rows)
    first = sorted(vectors, key=lambda v: (v[0] is None, hashlib.sha256(f"3:{v[0]}".encode()).hexdigest(), v[2]))[:5]
    to, book = lloyd([v[2] for v in vectors], [v[2] for v in first], 4)
    assert final.tolist() == book
    want = sorted(repr((v[0], c, squared(v[2], book[c]))) for v, c in zip(vectors, to, strict=True))
    assert sorted(repr(tuple(r)) for r in placed.collect()) == want
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = balls.op11_clusters(spark, str(tmp_path)).collect()
    assert against_sql(balls.OP11_SQL, "embeddings", [r[:3] for r in rows], got, ["vec_id", "embedding", "label"])


def test_balls_are_taken_whole(spark):
    """Far clusters: most vectors are counted by their ball's sum, and the counts are still exact."""
    rows = [r for r in planted() if r[0] is not None and r[0] < 700]
    vectors = balls.vectors_of(spark.createDataFrame(rows, SCHEMA), DIM)
    centroids = np.array([v[2] for v in kept(rows)[:6]])
    sums = balls.totals(balls.trees(vectors, DIM), centroids).collect()
    counted = collections.Counter()
    for s in sums:
        counted[s["centroid"]] += s["n"]
    nearest, _ = lloyd([v[2] for v in kept(rows)], centroids.tolist(), 0)
    assert counted == collections.Counter(nearest)
    assert sum(s["unseen"] for s in sums) > 350


@pytest.mark.parametrize("n", [1, 2, 33, 300])
def test_tree(n):
    r = np.random.default_rng(n)
    x = r.integers(-5, 5, size=(n, 3))
    x[: n // 2] = x[0]
    t = balls.tree(x)
    assert sorted(t["order"]) == list(range(n)) and (x[t["order"]] == t["x"]).all()
    for (a, b, left, right), total, radius in zip(t["span"], t["sums"], t["radius"], strict=True):
        own = t["x"][a:b]
        assert (own.sum(0) == total).all() and np.sqrt(((own - total / (b - a)) ** 2).sum(1)).max() <= radius + 1e-12
        if left >= 0:
            assert t["span"][left][0] == a and t["span"][left][1] == t["span"][right][0] and t["span"][right][1] == b
        else:
            assert b - a <= balls.LEAF or (own == own[0]).all()


def test_exact_for_large_components():
    x = np.array([[lattice.LIMIT, -lattice.LIMIT] * 32, [3] * 64])
    want = [[squared(a, b) for b in x.tolist()] for a in x.tolist()]
    assert lattice.squared(x, x).tolist() == want


def test_large_components_count_as_the_limit(spark):
    d = spark.createDataFrame([(1, [1e30, -1e30] * 32), (2, [0.0] * 64)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["x"] for r in balls.vectors_of(d, 64).collect()}
    assert got == {1: [lattice.LIMIT, -lattice.LIMIT] * 32, 2: [0] * 64}


@pytest.mark.parametrize("entries", [3, 40])
def test_vector_codes(spark, monkeypatch, entries):
    monkeypatch.setattr(codes, "BLOCK", 60)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0 if entries == 3 else 100)
    rows = planted(n=200)
    got, books = codes.compress(spark.createDataFrame(rows, SCHEMA), entries=entries, rounds=3)
    vectors = sorted(kept(rows), key=lambda v: (v[0] is None, v[0], v[2]))
    code, error = [""] * len(vectors), [0] * len(vectors)
    for p in range(4):
        part = [v[2][16 * p : 16 * p + 16] for v in vectors]
        to, book = lloyd(part, part[:entries], 3)
        assert books[p].tolist() == book
        code = [c + f"{k:02x}" for c, k in zip(code, to, strict=True)]
        error = [e + squared(x, book[k]) for e, x, k in zip(error, part, to, strict=True)]
    of_label = collections.Counter()
    for v, e in zip(vectors, error, strict=True):
        of_label[v[1]] += e
    want = [(v[0], v[1], c, e, of_label[v[1]]) for v, c, e in zip(vectors, code, error, strict=True)]
    # vectors of another length keep their row; their labels' sums don't count them
    want += [(r[0], r[2], None, None, of_label[r[2]]) for r in rows if r[0] in (5001, 5002)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("vec_id", "label", "code", "error", "label_error"))) for r in got.collect())


def test_vector_codes_sql(spark, tmp_path):
    rows = planted(n=300)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert against_sql(codes.OP12_SQL, "embeddings", [r[:3] for r in rows], got, ["vec_id", "embedding", "label"])


def test_pruning_is_exact():
    """Bounds that hold, however loose, give the nearest entry with ties to the lower index, from fewer distances."""
    r = np.random.default_rng(1)
    book = np.concatenate([r.integers(-40, 40, size=(30, 4)), np.zeros((2, 4), int)]).astype(np.int64)
    book[7] = book[3]
    x = (book[r.integers(0, 32, 4000)] + r.integers(-6, 7, size=(4000, 4))).astype(np.int64)
    d = lattice.squared(x, book)
    own, upper, lower = codes.first_bounds(x, book)
    assert (own == d.argmin(1)).all()
    moved = book + r.integers(-3, 4, size=book.shape)
    shift = np.sqrt(((moved - book) ** 2).sum(1))
    small, unit = codes.packed(lower)
    loose = codes.unpacked(small, unit)
    assert (loose <= lower).all() and (loose >= lower - 2 * unit[:, None]).all()
    loose = np.maximum(loose - shift, 0)
    upper = upper + shift[own]
    taken = codes.pruned(x, moved, codes.gaps(moved), own, upper, loose)
    want = lattice.squared(x, moved)
    assert (own == want.argmin(1)).all() and taken < want.size / 3
    assert (loose <= np.sqrt(want) + 1e-9).all() and (upper >= np.sqrt(want.min(1)) - 1e-9).all()


@pytest.mark.parametrize("run", [lambda d: balls.clusters(d)[0], lambda d: codes.compress(d)[0]])
def test_no_vectors(spark, run):
    d = spark.createDataFrame([(1, None, 1, "a", 0.1, "b"), (2, [math.nan] * DIM, None, "a", 0.1, "b")], SCHEMA)
    assert run(d).collect() == [] and run(d.limit(0)).collect() == []


PAGES = [
    (1, "http://A.org/es/1?q#f", '<a href="http://b.net/x">x</a><A class=k HREF = //c.net>y</A>'),
    (2, "https://example.org/en/12", "<a href='http://spam.biz:80/'>"),
    (3, "https://sub.example.ORG/es/", None),
    (4, "https://example.org", '<a href="/relative"><a href="mailto:x@y.z"><a data-href="http://no.net/">'),
    (5, "http://shop.com/de/1", '<a href="http://shop.com/fr/"><a href="http://spam.biz:80/">'),
    (6, "http://shop.com/en/1", "<a <a <a href=//b.net"),
    (7, "http://shop.com/en/1", ""),
    (8, "http://farm.net/", '<a href="http://shop.com/de/2"><a href=HTTP://Shop.com>'),
    (9, "http://ring.net/", '<a href="http://farm.net/">'),
    (10, None, '<a href="http://b.net/">'),
    (None, "no scheme", None),
    (11, "x://://y.org/fr/", ""),
    (12, "http://spam.biz:80/en", '<a href="http://example.org/en/1">' * 3),
    (13, "http://b.net/p/q", '<a href="//a.org/">'),
    (13, "http://b.net/p/q", '<a href="//a.org/">'),
    (14, "http://norg/", ""),
    (15, "http://\u0130.org\n/x\ny", ""),
]
PAGE_COLUMNS = "page_id long, url string, html string, rule string, host int, verdict string"


def brute(pages, rules, rounds=20):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    at = []
    for _, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest)[0]
        at.append((lower(host), re.split("[?#]", rest[len(host) :])[0]))
    fits = lambda h, p: [(len(r + s), len(r), r + s, v) for r, s, v in rules if (h == r or h.endswith("." + r)) and p.startswith(s) and h]
    best = [max(fits(h, p), default=None) for h, p in at]
    links = {(h, lower(b)) for (h, _), (_, _, html) in zip(at, pages, strict=True) if h for b in re.findall(urls.LINK, html or "")}
    links = {(a, b) for a, b in links if a != b}
    hosts = {h for h, _ in at if h} | set(itertools.chain(*links))
    held = []
    for verdict, way in (("allow", links), ("block", {(b, a) for a, b in links})):
        seed = {h: urls.UNIT * sum(1 for (x, _), f in zip(at, best, strict=True) if x == h and f and f[3] == verdict) for h in hosts}
        out = collections.Counter(a for a, _ in way)
        mass = dict(seed)
        for _ in range(rounds):
            new = {h: seed[h] // 20 * 3 + (0 if out[h] else mass[h] // 20 * 17) for h in hosts}
            for a, b in way:
                new[b] += mass[a] // 20 * 17 // out[a]
            mass = new
        held.append(mass)
    rows = []
    for (i, _, _), (h, p), f in zip(pages, at, best, strict=True):
        trust, distrust = (m.get(h, 0) for m in held)
        rows.append((i, h, p, f[2] if f else None, f[3] if f else "block" if distrust > trust else "allow", trust, distrust))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_url_verdicts(spark, monkeypatch, tmp_path, small):
    if small:  # every join dealt over salted keys, every host with two links a hub
        for name, value in (("BROADCAST_ROWS", 0), ("HUB", 1), ("EVERY", 2)):
            monkeypatch.setattr(urls, name, value)
    d = spark.createDataFrame([(*p, "rule", 1, None) for p in PAGES], PAGE_COLUMNS)
    want = brute(PAGES, urls.RULES)
    got = urls.verdicts(d, urls.rule_table(spark, urls.RULES)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    by = {r[0]: r[4] for r in want}
    # who links to a blocked host is distrusted, and who links to that one
    assert by[8] == by[9] == "block" and by[13] == "allow"
    d.write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op13_url_filter(spark, str(tmp_path)).collect()
    assert against_sql(urls.OP13_SQL, "pages", PAGES, got, ["page_id", "url", "html"])


def test_longest_rule_wins(spark):
    rules = [("com", "/", "block"), ("a.com", "/", "allow"), ("com", "/abc", "block"), ("a.com", "/ab", "allow"), ("a.com", "/ab", "block"), ("b.a.com", "", "allow")]
    pages = [(1, "http://a.com/abcd", None), (2, "http://x.a.com/a", None), (3, "http://b.a.com", None), (4, "http://b.a.com/abc", None), (5, "http://com/", None)]
    got = urls.verdicts(spark.createDataFrame(pages, "page_id int, url string, html string"), urls.rule_table(spark, rules)).collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {1: ("a.com/ab", "block"), 2: ("a.com/", "allow"), 3: ("b.a.com", "allow"), 4: ("a.com/ab", "block"), 5: ("com/", "block")}


def test_no_pages(spark):
    d = spark.createDataFrame([], PAGE_COLUMNS)
    assert urls.verdicts(d, urls.rule_table(spark, urls.RULES)).collect() == []


def test_long_tables_are_shuffled(spark, monkeypatch):
    """A table of many rows in small files is not broadcast, nor are its rows repeated but for keys of many rows."""
    from canopyql.llm import urls
    from canopyql.session import stage

    monkeypatch.setattr(urls, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(urls, "HUB", 50)
    rows = spark.sql("SELECT id AS page_id, CASE WHEN id < 300 THEN 'often' ELSE concat('k', id % 40) END AS k FROM range(600)")
    few = stage(spark.sql("SELECT concat('k', id) AS r, id AS v FROM range(30) UNION ALL SELECT 'often', 77"), "few")
    out = urls._beside(rows, few, "k", "r", "left")
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    want = {i: 77 if i < 300 else i % 40 if i % 40 < 30 else None for i in range(600)}
    got = [(r["page_id"], r["v"]) for r in out.collect()]
    assert len(got) == 600 and dict(got) == want
