"""Structures that keep plans linear, against all pairs: qualified chains, private names, spans, walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyql.operators import governance, graph, resolve
from canopyql.plans import verbs
from tests.test_units import symbols


def meant(rows, src, full):
    """The definitions that a qualified reference means, one by one."""
    out = []
    for i, (p, n, t, _, q, _) in enumerate(rows):
        if i == src or n != full.split("::")[-1] or t in ("field", "prop", "variant") or "vendor/" in p:
            continue
        stem = p.split("/")[-2] if p.endswith("/mod.rs") else p.split("/")[-1].rsplit(".", 1)[0]
        if q is None:
            if p.endswith(".rs") and full.split("::")[-2] == stem:
                out.append(i)
        elif q == full or q.endswith("::" + full) or full.endswith("::" + q):
            out.append(i)
    return out


def test_qualified_against_all_pairs(spark):
    r = random.Random(5)
    scopes = ["A", "B", "a", "m", "A::B", "m::A", "x::m::A", "AA"]
    names = ["run", *(f"name{k}" for k in range(14))]
    rows = []
    for _ in range(120):
        n = r.choice(names)
        rows.append((r.choice(["a.rs", "m/mod.rs", "x/A.rs", "b.ts", "vendor/a.rs"]), n, r.choice(["fn", "impl", "field", "var", "var", "var"]), r.random() < 0.8, r.choice([None, None, n, *(f"{s}::{n}" for s in scopes)]), True))
    rows += [("c.rs", f"user{k}", "fn", False, None, True) for k in range(60)]
    asked = {}
    for src in range(120, 180):
        for n in (*names, rows[src][1], "no"):
            asked[src, n] = r.choice(["crate::", "self::super::", ""]) + r.choice(scopes)
    refs = spark.createDataFrame([(s, p, n) for (s, n), p in asked.items()], "src long, path string, name string")
    got = {(x["src"], x["tk"]): (x["prov"], x["dst"]) for x in resolve.qualified(symbols(spark, rows), refs).collect()}
    want = {}
    for (s, n), p in asked.items():
        full = p.replace("crate::", "").replace("self::super::", "") + "::" + n
        hits = meant(rows, s, full) if len(n) >= 3 and n != rows[s][1] else []
        if hits:
            loose = all(rows[i][2] == "var" and rows[i][3] for i in hits)
            want[s, n] = ("qname", hits[0]) if len(hits) == 1 else ("local-only" if loose else "ambiguous", None)
    assert got == want and {v[0] for v in want.values()} == {"qname", "local-only", "ambiguous"}


def test_first_of_a_names_qualified_references_counts(spark):
    rows = [("a.rs", "run", "fn", False, "A::run", True), ("b.rs", "run", "fn", False, "B::run", True), ("c.rs", "entry", "fn", False, None, True)]
    refs = spark.createDataFrame([(2, "B", "run", 1), (2, "A", "run", 2)], "src long, path string, name string, pos int")
    assert [(x["prov"], x["dst"]) for x in resolve.qualified(symbols(spark, rows), refs).collect()] == [("qname", 1)]


def test_a_hot_name_makes_no_pair_a_definition(spark):
    """20,000 definitions of one name: a reference meets one summary of them."""
    d = spark.range(20_000).selectExpr("id AS sym_id", "concat('d', id, '.rs') AS p", "'make' AS n", "'fn' AS t", "1 AS l", "2 AS el", "false AS local", "concat('C', id % 10000, '::make') AS q", "true AS exp")
    u = spark.range(20_000, 20_100).selectExpr("id AS sym_id", "'u.rs' AS p", "concat('use', id) AS n", "'fn' AS t", "1 AS l", "2 AS el", "false AS local", "null AS q", "true AS exp")
    refs = spark.range(20_000, 20_100).selectExpr("id AS src", "concat('C', id - 20000) AS path", "'make' AS name")
    got = resolve.qualified(d.unionByName(u), refs)
    assert {r["prov"] for r in got.collect()} == {"ambiguous"} and got.count() == 100


def test_private_names_go_up_their_own_path(spark):
    """2,000 files with a private name each in one directory: rows as many as references and directories, not files by files."""
    private = [(f"m/f{i}.rs", f"name{i}", "fn", False, None, False) for i in range(2000)]
    users = [(f"m/n/u{i}.rs", f"user{i}", "fn", False, None, True) for i in range(20)]
    s = symbols(spark, private + users + [("other/x.rs", "name3", "fn", False, None, False)])
    refs = spark.createDataFrame([(2000 + i, f"name{j}", 0) for i in range(20) for j in (3, i + 100)], "src long, tk string, pos int")
    seen = []
    stage = resolve.stage
    resolve.stage = lambda df, what="stage": seen.append(stage(df, what)) or seen[-1]
    try:
        got = {(r["src"], r["tk"]): (r["prov"], r["dst"]) for r in resolve.decided_by_name(s, refs).collect()}
    finally:
        resolve.stage = stage
    assert all(got[2000 + i, "name3"] == ("visibility", 3) and got[2000 + i, f"name{i + 100}"] == ("name", i + 100) for i in range(20))
    assert max(t.count() for t in seen) < 10_000


SPAN = "sym_id long, p string, n string, l int, el int"


def test_containment_against_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        line = r.randint(0, 200)
        rows.append((i, r.choice("ab"), f"n{i}", line, line + r.choice([0, 0, 1, 3, 20, 150])))
    d = spark.createDataFrame(rows, SPAN)
    got = sorted((x["host"], x["member"]) for x in graph.contained(d, d).collect())
    assert got == sorted((h[0], m[0]) for h in rows for m in rows if h[1] == m[1] and m[3] > h[3] and m[4] <= h[4])
    assert graph.contained(d.limit(0), d).collect() == [] == graph.contained(d, d.limit(0)).collect()


def test_bins_cover_each_line_once(spark):
    spans = [(a, b) for a in range(0, 40) for b in range(a, 41)]
    d = spark.createDataFrame(spans, "l long, el long").select("l", "el", F.explode(graph._bins(F.col("l"), F.col("el"), 6)).alias("b")).select("l", "el", "b.level", "b.bin")
    lines = {}
    for x in d.collect():
        lines.setdefault((x["l"], x["el"]), []).extend(range(x["bin"] << x["level"], (x["bin"] + 1) << x["level"]))
    assert all(sorted(lines.get((a, b), [])) == list(range(a + 1, b + 1)) for a, b in spans)


def test_many_spans_of_one_file(spark):
    """30,000 members in one file and spans around each: as many rows as containments, in seconds."""
    hosts = spark.range(300).selectExpr("id AS sym_id", "'f' AS p", "cast(id * 100 AS int) AS l", "cast(id * 100 + 99 AS int) AS el")
    members = spark.range(30_000).selectExpr("id AS sym_id", "'f' AS p", "cast(id AS int) AS l", "cast(id AS int) AS el")
    assert graph.contained(hosts, members).count() == 300 * 99


def test_chains_of_containers(spark):
    rows = [(0, "f", "A", 1, 20), (1, "f", "b", 2, 9), (2, "f", "c", 3, 4), (3, "f", "d", 10, 12), (4, "f", "E", 21, 30), (5, "f", "g", 22, 22), (6, "g", "h", 2, 3)]
    d = spark.createDataFrame(rows, SPAN)
    chain = lambda df: {r["sym_id"]: r["q"] for r in df.collect()}
    assert chain(graph.container_chains(d)) == {0: "A", 1: "A::b", 2: "A::b::c", 3: "A::d", 4: "E", 5: "E::g", 6: "h"}
    assert chain(graph.container_chains(d, d.where("n = 'b'"))) == {0: "A", 1: "b", 2: "b::c", 3: "d", 4: "E", 5: "g", 6: "h"}
    deep = spark.createDataFrame([(i, "f", f"n{i}", i, 200 - i) for i in range(60)], SPAN)
    assert chain(graph.container_chains(deep))[59] == "::".join(f"n{i}" for i in range(19, 60))


def test_chains_are_those_of_the_parsers(spark):
    """What the parser of a language finds by its grammar, the spans give back."""
    from canopyql.sources import python_ast

    text = "class Outer:\n    xx = 1\n    class Inner:\n        def first(self):\n            def deep():\n                pass\n            return deep\n    def second(self):\n        pass\ndef alone():\n    pass\n"
    found = python_ast.read(text)[0]
    rows = [(i, "a.py", s["n"], s["l"], s["el"]) for i, s in enumerate(found)]
    named = {s["n"] for s in found for x in found if x["q"] and s["n"] in x["q"].split("::")[:-1]}
    d = spark.createDataFrame(rows, SPAN)
    got = {r["sym_id"]: r["q"] for r in graph.container_chains(d, d.where(d["n"].isin(*named))).collect()}
    assert {found[i]["n"]: q for i, q in got.items()} == {s["n"]: s["q"] or s["n"] for s in found}


@pytest.mark.parametrize("rounds", [0, 1, 5, 7, 20])
def test_ranks_against_numpy(spark, rounds):
    r = np.random.default_rng(4)
    n = 40
    edges = [(int(a), int(b)) for a, b in r.integers(0, n, (90, 2)) if a % 5] + [(1, 2), (1, 2), (3, 3), (7, 1000)]
    deg = np.bincount([a for a, _ in edges], minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = np.full(n, 0.15 / n + 0.85 * rank[deg == 0].sum() / n)
        for a, b in edges:
            if b < n:
                new[b] += 0.85 * rank[a] / deg[a]
        rank = new
    got = graph.pagerank(spark.range(n).withColumnRenamed("id", "sym_id"), spark.createDataFrame(edges, "src long, dst long"), rounds).collect()
    assert len(got) == n and np.allclose([x["rank"] for x in sorted(got, key=lambda x: x["sym_id"])], rank, atol=1e-12)


def test_answers_carry_confidence(spark):
    s = symbols(spark, [("a.ts", "one", "fn", False, None, None), ("b.ts", "two", "fn", False, None, None), ("c.ts", "two", "fn", False, None, None), ("d.ts", "user", "fn", False, None, None)])
    labels = spark.createDataFrame([(0, None), (1, "low"), (2, "none"), (3, None)], "sym_id long, conf string")
    rows = spark.createDataFrame([(3, 0), (3, 1)], "src long, dst long")
    assert {(r["dst"], r["conf"]) for r in verbs.with_confidence(rows, labels, "dst").collect()} == {(0, None), (1, "low")}
    ask = lambda df, name: tuple(verbs.answer(df, s, labels, name).first())
    assert ask(rows.where("dst = 0"), "one") == ("one", 1, 1, None)
    assert ask(rows.where("dst = 1"), "two") == ("two", 1, 2, "low")
    assert ask(rows.limit(0), "two") == ("two", 0, 2, "none")
    assert ask(rows.limit(0), "gone") == ("gone", 0, 0, None)


def test_drift_by_digests(spark):
    from canopyql.operators import digests

    r = random.Random(9)
    paths_ = [f"{a}/{b}/{c}.rs" for a in "abc" for b in "xyz" for c in "12"] + ["top.rs", "a/only.rs"]
    here = [("symbol", p, f"{p}|{k}") for p in paths_ for k in range(6)] + [("edge", p, f"{p}>{k}") for p in paths_ for k in range(2)]
    there = [x for x in here if r.random() > 0.02] + [("symbol", "new/dir/f.rs", "n"), ("symbol", "top.rs", "moved"), ("edge", "a/only.rs", "again"), here[0]]
    df = lambda rows: spark.createDataFrame(rows, "relation string, path string, key string")
    got = sorted((x["relation"], x["key"], bool(x["here"]), bool(x["there"])) for x in digests.drift(df(here), df(there)).collect())
    a, b = ({(x, k) for x, _, k in rows} for rows in (here, there))
    assert got == sorted((*x, x in a, x in b) for x in a ^ b)
    # a row met twice on one side alone is no drift of keys, but its path is looked at
    assert ("symbol", here[0][1]) in {tuple(x) for x in digests.differing_paths(digests.digest_tree(df(here)), digests.digest_tree(df(there))).collect()}


def test_equal_trees_compare_one_row_a_relation(spark, monkeypatch):
    from canopyql.operators import digests

    rows = spark.range(500).selectExpr("CASE WHEN id % 2 = 0 THEN 'symbol' ELSE 'edge' END AS relation", "concat('d', id % 7, '/f', id % 50) AS path", "CAST(id AS string) AS key")
    looked = []
    stage = digests.stage
    monkeypatch.setattr(digests, "stage", lambda df, what: looked.append(what) or stage(df, what))
    tree = digests.digest_tree(rows)
    assert {(x["relation"], x["n"]) for x in tree.where("depth = 0").collect()} == {("symbol", 250), ("edge", 250)}
    assert digests.differing_paths(tree, digests.digest_tree(rows.repartition(3))).collect() == [] and looked == ["differing"]


def test_parsers_as_table_functions(spark):
    from canopyql.operators import census
    from canopyql.sources import parsers

    files = [("a.py", "py", "class Some:\n    def one(self):\n        return two\n"), ("b.rs", "rust", "mod mm {\n    pub fn deep() {}\n}\n"), ("c.md", "md", "# class no"), ("d.py", "py", "def broken("), ("e.ts", "ts", None)]
    d = spark.createDataFrame(files, "path string, lang string, text string")
    got = {(r["path"], r["n"], r["l"], r["q"]) for r in parsers.table_function(d, "parsed_symbols").collect()}
    assert got == {("a.py", "Some", 1, None), ("a.py", "one", 2, "Some::one"), ("b.rs", "mm", 1, None), ("b.rs", "deep", 2, "mm::deep")}
    met = sorted((r["path"], r["node"], r["l"]) for r in parsers.table_function(d, "parsed_nodes").collect())
    assert met == [("a.py", "ClassDef", 1), ("a.py", "FunctionDef", 2), ("a.py", "Name", 3), ("a.py", "Return", 3), ("a.py", "arg", 2), ("b.rs", "fn", 2), ("b.rs", "mod", 1)]
    registry = spark.createDataFrame([("py", "ClassDef", "extracted"), ("rust", "mod", "extracted"), ("rust", "union", "extracted")], "lang string, node string, status string")
    found = census.of_files(d, registry, F.col("node").endswith("Def"))
    assert {(r["lang"], r["status"], r["types"]) for r in census.audit(found).collect()} == {("py", "extracted", 1), ("py", "unclassified", 1), ("rust", "extracted", 1), ("rust", "stale", 1)}


def test_history_by_ranges(spark, tmp_path):
    import subprocess

    from canopyql.sources import tree

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    want = []
    for k in range(1, 8):
        for name in {f"f{k % 3}.py", "odd name.py" if k % 2 else "g.py"}:
            (tmp_path / name).write_text(str(k))
            want.append((k, name))
        git("add", "-A")
        git("commit", "-qm", f"c{k}")
    spark.conf.set(tree.FILTERS, "true")
    h = tree.history(spark, str(tmp_path))
    read = spark.read.format("git_history").option("root", str(tmp_path)).option("partsize", "2").load()
    assert sorted(map(tuple, h.collect())) == sorted(map(tuple, read.collect())) == sorted(want)
    assert read.rdd.getNumPartitions() == 4 and read.where("number > 5").rdd.getNumPartitions() == 1
    some = read.where("number >= 2 AND number < 6 AND path = 'g.py'")
    assert sorted(map(tuple, some.collect())) == [x for x in sorted(want) if 2 <= x[0] < 6 and x[1] == "g.py"]
    assert {r["path"]: r["churn"] for r in tree.churn(spark, str(tmp_path), 2).collect()} == {"f0.py": 1, "f1.py": 1, "g.py": 1, "odd name.py": 1}
    assert tree.history(spark, str(tmp_path / "none")).collect() == []


def test_a_change_in_one_call(spark, tmp_path):
    import subprocess

    from canopyql.plans.repository import Repository, decl_audit, figures_of, pr_affected
    from canopyql.sources import tree

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (tmp_path / "base.py").write_text("def helper():\n    return 1\n")
    (tmp_path / "user.py").write_text("from base import helper\n\ndef caller():\n    return helper()\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    first, affected, comment = pr_affected(spark, str(tmp_path), files=["base.py"])
    assert [r["n"] for r in affected.collect()] == ["caller"] and "1 affected" in comment and "`user.py`:3 caller" in comment
    # nothing has changed: the index stays
    assert pr_affected(spark, str(tmp_path), first, files=["base.py"])[0] is first
    report = first.report()
    assert figures_of(report) == first.stats().first().asDict() and first.check(first, report=report).collect() == []
    (tmp_path / "base.py").write_text("def helper():\n    return 1\n\ndef other():\n    return helper()\n")
    again, affected, _ = pr_affected(spark, str(tmp_path), first, base="HEAD")
    assert again is not first and {r["n"] for r in affected.collect()} == {"caller"}
    problems = {r["problem"] for r in first.check(again, report=report).collect()}
    assert {"drift-symbol", "drift-edge", "report-symbols"} <= problems
    files = tree.read_tree(spark, str(tmp_path))
    registry = spark.createDataFrame([("py", "FunctionDef", "extracted")], "lang string, node string, status string")
    assert {(r["lang"], r["status"], r["nodes"]) for r in decl_audit(files, registry, F.col("node").endswith("Def"), strict=True).collect()} == {("py", "extracted", 3)}
    assert isinstance(again, Repository)


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    far = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in out.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        far[n] = seen
    return far


@pytest.mark.parametrize("seed", [1])
def test_strong_components_against_reachability(spark, seed):
    r = random.Random(seed)
    # three graphs in one: sparse, dense, and rings with tails, with a loop each
    edges = [(r.randint(0, 29), r.randint(0, 29)) for _ in range(32)] + [(r.randint(40, 55), r.randint(40, 55)) for _ in range(40)]
    edges += [(60 + i, 60 + (i + 1) % 9) for i in range(9)] + [(70 + i, 71 + i) for i in range(8)] + [(78, 60), (63, 80), (80, 81), (81, 81), (90, 91), (91, 90), (91, 92), (92, 91), (95, 95)]
    far = reachable(edges)
    want = {n: min(m for m in far[n] if n in far[m]) for n in far if n in far[n]}
    got = graph.strong_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == want and len(got) == len(want)
    assert governance.on_cycles(edges) == set(want)


def test_long_chains_and_rings_fold(spark):
    chain = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    ring = spark.range(500).selectExpr("id + 10000 AS a", "(id + 1) % 500 + 10000 AS b")
    got = graph.strong_components(chain.unionByName(ring)).groupBy("component").count().collect()
    assert [tuple(x) for x in got] == [(10000, 500)]
    assert graph.strong_components(chain.limit(0)).collect() == []


def test_modules_on_cycles(spark, monkeypatch):
    d = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("c", "e")], "a string, b string")
    for few in (5000, 2):
        monkeypatch.setattr(governance, "FEW_PAIRS", few)
        assert {r["module"] for r in governance.in_cycles(d).collect()} == {"a", "b", "d"}
    assert governance.in_cycles(d.limit(0)).collect() == []
