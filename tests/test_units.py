"""Small cases for expressions and module rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyql.functions import paths, text
from canopyql.operators import governance, resolve, score
from canopyql.sources import braces, parsers, python_ast, side


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_skips(spark):
    skip = lambda p, extra=None: one(spark, "p string", (p,), paths.skipped(F.col("p"), extra))
    assert skip("a/Node_Modules/b.js") and skip("x/third-party/y.rs") and not skip("src/builder/a.ts")
    assert skip("gen/a.ts", ["gen"]) and skip("a/b/c.ts", ["./a/b/"]) and skip("pkg/x1/y.ts", ["pkg/*"]) and not skip("z/pkg/x1", ["pkg/*"])


def test_families(spark):
    fam = lambda p: one(spark, "p string", (p,), paths.family(F.col("p")))
    assert [fam(p) for p in ("a.rs", "a.tsx", "a.mjs", "a.cjs", "a.py")] == ["rs", "ts", "ts", "other", "other"]


def test_noise(spark):
    strip = lambda t, lang: one(spark, "t string, lang string", (t, lang), text.strip_noise(F.col("t"), F.col("lang")))
    assert "secret" not in strip("x = 'secret' # secret\n", "py")
    assert "secret" not in strip("let a = /secret/g; /* secret */ f(\"secret\"); // secret", "ts")
    assert "lifetime" in strip("fn f<'lifetime>(x: &'lifetime str) {}", "rust")
    assert strip("a" * 50_000 + '"' + "b" * 100_000 + '"', "ts").strip() == "a" * 50_000
    assert "see" in strip("see https://x.org/y", "ts") and "org" in strip("see https://x.org/y", "ts")
    assert "kept" in strip('s = "/* no comment" + kept + "*/"', "ts") and "half" in strip("a = b / half / c", "ts")


def test_branches(spark):
    count = lambda t: one(spark, "t string", (t,), text.branches(F.col("t")))
    assert count("if a && b else c ? d : e ?? f") == 6
    assert count("iffy elsewhere") == 1


def test_token_estimate(spark):
    assert one(spark, "t string", ("abcde日本",), text.token_estimate(F.col("t"))) == 4


def test_fingerprint(spark):
    import hashlib

    want = hashlib.sha256(b"r\0f\0d").hexdigest()[:16]
    assert one(spark, "a string", ("r",), governance.fingerprint(F.col("a"), F.lit("f"), F.lit("d"))) == want


def test_cycles_once_a_set():
    assert [set(c) for c in governance.cycles([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")])] == [{"a", "b"}, {"a", "b", "c"}]
    assert governance.cycles([("a", "b"), ("b", "c")]) == []


SYMBOLS = "sym_id long, p string, n string, t string, l int, el int, local boolean, q string, exp boolean"


def symbols(spark, rows):
    return spark.createDataFrame([(i, p, n, t, 10 * i, 10 * i + 5, local, q, exp) for i, (p, n, t, local, q, exp) in enumerate(rows)], SYMBOLS)


def decide(spark, rows, refs, **more):
    d = resolve.resolve(symbols(spark, rows), spark.createDataFrame(refs, "src long, tk string, pos int"), **more)
    return {(r["src"], r["tk"]): (r["prov"], r["dst"]) for r in d.collect()}


def test_decision_chain(spark):
    rows = [
        ("a.ts", "run", "fn", False, None, None), ("a.ts", "use", "fn", False, None, None), ("b.ts", "run", "fn", False, None, None),
        ("a.ts", "Twin", "iface", False, None, None), ("c.ts", "Twin", "iface", False, None, None),
        ("d.ts", "vis", "struct", False, None, True), ("e.ts", "vis", "struct", False, None, False),
        ("a.ts", "tmp", "var", True, None, None), ("b.ts", "tmp", "var", True, None, None), ("x.rs", "only", "fn", False, None, None), ("a.ts", "fld", "field", False, None, None),
    ]
    got = decide(spark, rows, [(1, "run", 0), (1, "Twin", 1), (1, "vis", 2), (1, "tmp", 3), (1, "only", 4), (1, "fld", 5), (5, "Twin", 0)])
    assert got == {(1, "run"): ("scope-unique", 0), (1, "Twin"): ("lexical", 3), (1, "vis"): ("visibility", 5), (1, "tmp"): ("local-only", None), (5, "Twin"): ("ambiguous", None)}


def test_qualified_uses_up_the_name(spark):
    rows = [("a.rs", "run", "fn", False, "Runner::run", True), ("a.rs", "run", "fn", False, "Alpha::run", True), ("b.rs", "entry", "fn", False, None, True)]
    q = spark.createDataFrame([(2, "crate::Runner", "run"), (2, "Nowhere", "gone")], "src long, path string, name string")
    got = decide(spark, rows, [(2, "run", 0), (2, "gone", 1)], qrefs=q)
    assert got == {(2, "run"): ("qname", 0)}


def test_hub_factors(spark):
    rows = [("a.ts", "hub", "fn", False, None, None), ("a.ts", "x1", "fn", False, None, None), ("b.ts", "x2", "fn", False, None, None), ("tests/c.ts", "x3", "fn", False, None, None), ("a.ts", "parse", "fn", False, None, None)]
    s = symbols(spark, rows)
    e = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (2, 4)], "src long, dst long")
    got = {r["n"]: r for r in score.hub_scores(s, e).collect()}
    assert abs(got["hub"]["score"] - (0.7 + 1 + 0.5) * 1.15) < 1e-9
    assert abs(got["parse"]["score"] - 0.15 * 0.85) < 1e-9
    assert got["hub"]["caller_files"] == 3
    listed = {r["n"]: r["score"] for r in score.hub_scores(s, e, score.HubConfig(whitelist=("parse",))).collect()}
    assert abs(listed["parse"] - 0.85) < 1e-9


def test_budget_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, 500), (2, 1)], "position int, est int")
    assert [r["position"] for r in score.within_budget(rows, F.col("est"), 100).collect()] == [1]


def test_python_parser():
    rows, imports, _ = python_ast.read("import os as o\nfrom a.b import long_name\nLIMIT = 3\nclass A(Base):\n    size: int = 0\n    async def go(self, x: Shape) -> Other:\n        return helper(x) if x else LIMIT\n")
    got = {r["n"]: r for r in rows}
    assert got["go"]["t"] == "method" and got["go"]["q"] == "A::go" and got["go"]["cx"] == 2
    assert "helper" in got["go"]["refs"] and "x" not in got["go"]["refs"] and set(got["go"]["trefs"]) == {"Shape", "Other"}
    assert got["size"]["t"] == "field" and got["LIMIT"]["t"] == "var" and imports == [("os", "o"), ("long_name", "long_name")]
    assert parsers.parse("py", "def (:") is None and parsers.parse("ts", "x" * (parsers.MOST_CHARS + 1)) is None


RUST = """use crate::defs::{first_fn as second_fn, deep::{self, Other}};
pub use crate::x::Shared;
/* fn hidden() {} /* nested */ */
pub trait Runner { fn run(&self) -> u32; }
impl<T: Into<String>> fmt::Display for Holder<T> where T: Bound {
    fn run(&self, cfg: &Config) -> Result<u32> { let value = helper(cfg); match value { 1 => a_case(), _ => value } }
}
pub(crate) async fn entry() -> u32 {
    let text = r#"fn not_this() {}"#; let sign = '"';
    Runner::run(&text) + items.iter().map(|item| item.size).sum()
}
enum Kind { One(u8), Two { x: u8 } }
mod inner { pub const fn build() -> Config { Config { limit: LIMIT } } }
"""


def test_rust_reader():
    rows, imports, handed = braces.read("rust", RUST)
    got = {r["q"] or r["n"]: r for r in rows}
    assert set(got) == {"Runner", "Runner::run", "Holder", "Holder::run", "entry", "Kind", "Kind::One", "Kind::Two", "inner", "inner::build"}
    assert got["Holder"]["tr"] == "Display" and got["Runner"]["exp"] and not got["Holder::run"]["exp"]
    assert got["Holder::run"]["refs"] == ["helper", "a_case"] and got["Holder::run"]["trefs"] == ["Config", "Result"] and got["Holder::run"]["cx"] == 3
    assert ("Runner", "run") in got["entry"]["qrefs"] and "text" not in got["entry"]["refs"] and "not_this" not in got["entry"]["refs"]
    assert (got["entry"]["l"], got["entry"]["el"]) == (8, 11) and got["inner::build"]["trefs"] == ["Config"]
    assert imports == [("first_fn", "second_fn"), ("Other", "Other"), ("Shared", "Shared")] and handed == [("Shared", "Shared")]


SCRIPT = """import base, { usedHelper as uh, type Spec } from './b'
export { Registry as Reg } from "./tool"
export interface Item extends Base { firstField: number; run(a: Spec): void }
export abstract class Registry<T> implements Face {
  private specs: Spec[] = [];
  async register(spec: Spec): Promise<void> { const inner = this.find(spec); if (inner && spec) push(inner) }
}
export function caller(count: number, { opt }: Options = {}) {
  const localValue = usedHelper(count)
  const pattern = /a"b[/]c/g
  return localValue ? opt : otherThing
}
export const arrow = async (first: First): Promise<Second> => first.map(each => each.call(final))
function outer() { function nested() { return innerCall() } return nested() }
"""


def test_script_reader():
    rows, imports, handed = braces.read("ts", SCRIPT)
    got = {r["q"] or r["n"]: r for r in rows}
    assert {k: r["t"] for k, r in got.items()} == {"Item": "iface", "Item::firstField": "prop", "Item::run": "prop", "Registry": "class", "Registry::specs": "field", "Registry::register": "method", "Registry::register::inner": "var", "caller": "fn", "caller::localValue": "var", "caller::pattern": "var", "arrow": "var", "outer": "fn", "outer::nested": "fn"}
    assert got["caller"]["refs"] == ["usedHelper", "otherThing"] and got["caller"]["trefs"] == ["Options"] and got["caller"]["cx"] == 2
    assert got["arrow"]["trefs"] == ["First", "Promise", "Second"] and "first" not in got["arrow"]["refs"] and "final" in got["arrow"]["refs"]
    assert got["caller"]["exp"] and not got["outer"]["exp"] and got["caller::localValue"]["local"] and not got["arrow"]["local"]
    assert got["Registry::register"]["trefs"] == ["Promise", "Spec"] and (got["caller"]["l"], got["caller"]["el"]) == (8, 12)
    assert imports == [("base", "base"), ("usedHelper", "uh"), ("Spec", "Spec")] and handed == [("Registry", "Reg")]


def test_readers_survive_broken_texts():
    for text in ("fn (", "pub struct", "impl for {", "}}}}", "use a::{b", '"open', "/* open", "class {", "export", "import {", "const [a", "=> {", "interface X {", "enum E { A(", "fn f(a: b", "#", "type T =", "`open ${", "@"):
        for cut in (text, text * 3, RUST[: len(text) * 9], SCRIPT[: len(text) * 7]):
            braces.read("rust", cut), braces.read("ts", cut)


def test_noises_and_flags():
    assert score.positive("12", "top") == 12
    for bad in ("0", "-1", "1.5", "", "x", None, True, "²"):
        with pytest.raises(ValueError, match="top"):
            score.positive(bad, "top")


def test_rule_file_quotes_and_lists():
    rules = side.parse_policy('modules:\n  - id: "a # b"  # note\n    roots:\n      - ./x/\n      - "y: z"\n    managed: true\n  - id: c\n    roots: [p, \'q, r\']\nglobal: # all\n  forbidCycles: false\n')
    assert [(m["id"], m["roots"], m["managed"]) for m in rules["modules"]] == [("a # b", ["x", "y: z"], True), ("c", ["p", "q, r"], False)]
    assert rules["global"] == {"forbidCycles": False, "forbidDeepImports": True}


def test_numbering_by_ranges(spark):
    from canopyql.operators.numbering import numbered

    d = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 5 + 1).alias("w")).repartition(7)
    got = sorted((r["k"], r["number"]) for r in numbered(d, [F.col("k")], each=90).collect())
    assert got == [(i, i) for i in range(1000)]
    rows = sorted(numbered(d, [F.col("k").desc()], size="w", each=90).collect(), key=lambda r: -r["k"])
    at = 0
    for r in rows:
        assert r["number"] == at
        at += r["w"]


def test_spans_and_own_complexity_across_blocks(spark, monkeypatch):
    import random

    from canopyql.operators import extract

    monkeypatch.setattr(extract, "BLOCK", 8)
    r = random.Random(3)
    rows = [(f"f{k}", line, r.choice([0, 0, 2, 4, 8])) for k in range(3) for line in sorted(r.sample(range(1, 120), 40))]
    d = spark.createDataFrame(rows, "path string, l int, indent int")
    got = {(x["path"], x["l"]): x["next"] for x in extract.next_no_deeper(d, "path").collect()}
    for p, line, indent in rows:
        assert got[p, line] == min((b for q, b, i in rows if q == p and b > line and i <= indent), default=None)
    spans = [(i, p, line, min(130, line + r.randint(0, 40)), r.randint(1, 9)) for i, (p, line, _) in enumerate(rows)]
    own = {x["sym_id"]: x["cx_own"] for x in extract.own_complexity(spark.createDataFrame(spans, "sym_id long, p string, l int, el int, cx int")).collect()}
    for i, p, a, b, cx in spans:
        assert own[i] == max(0, cx - sum(c for _, q, x, _, c in spans if q == p and a < x <= b))


def pairwise_decisions(rows, refs, aliases):
    """Every reference against every definition: what the summaries must amount to."""
    members, family = ("field", "prop", "variant"), lambda p: "rs" if p.endswith(".rs") else "ts" if p.endswith(".ts") else "other"
    names, out = {n for _, n, *_ in rows}, {}
    for src, tk in refs:
        p, own_t = rows[src][0], rows[src][2]
        wanted, alias = (tk, False) if tk in names else (aliases.get((p, tk)), True)
        c = [(i, r) for i, r in enumerate(rows) if r[1] == wanted and i != src and r[2] not in (*members, "impl") and (family(r[0]) == family(p) or "other" in (family(r[0]), family(p)))]
        if not c:
            continue
        same = [x for x in c if x[1][0] == p]
        below = lambda r: "/" in r[0] and p.startswith(r[0].rsplit("/", 1)[0] + "/")  # noqa: B023, E731
        seen = [x for x in c if x[1][0] == p or x[1][5] is None or x[1][5] or (family(x[1][0]) != "ts" and below(x[1]))]
        value, sec = lambda r: r[2] in ("var", "const"), own_t == "sec"
        if len(c) == 1:
            out[src, tk] = ("alias" if alias else "doc" if sec else "same-file" if same else "name", c[0][0])
        elif not sec and all(x[1][2] in ("fn", "method") for x in c) and len({x[1][0] for x in c}) > 1 and len(c) <= 3 and len(same) == 1:
            out[src, tk] = ("scope-unique", same[0][0])
        elif not sec and len(same) == 1 and same[0][1][4] is None and not value(same[0][1]):
            out[src, tk] = ("lexical", same[0][0])
        elif not sec and len(seen) == 1 and seen[0][1][0] != p and not seen[0][1][3]:
            out[src, tk] = ("visibility", seen[0][0])
        else:
            out[src, tk] = ("local-only" if all(value(x[1]) and x[1][3] for x in c) else "ambiguous", None)
    return out


def test_decisions_against_all_pairs(spark):
    import random

    r = random.Random(11)
    paths_ = ["a.rs", "m/a.rs", "m/n/b.rs", "m/c.ts", "m/n/d.ts", "e.py", "m/f.md", "g.ts"]
    rows = [(r.choice(paths_), r.choice(["one", "two", "three", "four"]), r.choice(["fn", "fn", "method", "struct", "var", "const", "impl", "field", "sec"]), r.random() < 0.3, r.choice([None, "q::x"]), r.choice([None, True, False, False])) for _ in range(40)]
    refs = [(i, t) for i, x in enumerate(rows) for t in ("one", "two", "three", "four", "also", "more") if t != x[1]]
    aliases = {(p, t): r.choice(["one", "two", "three"]) for p in paths_ for t in ("also", "more") if r.random() < 0.7}
    table = spark.createDataFrame([(p, t, n) for (p, t), n in aliases.items()], "path string, local string, original string")
    got = decide(spark, rows, [(i, t, 0) for i, t in refs], aliases=table)
    assert got == pairwise_decisions(rows, refs, aliases)


def test_census_of_declarations(spark):
    from canopyql.operators import census

    declared = parsers.declaration_table(spark)
    registry = declared.select("lang", "node", F.lit("extracted").alias("status"), F.lit("").alias("reason"))
    assert census.self_check(declared, registry).isEmpty()
    met = spark.createDataFrame([("rust", "fn", "b.rs", 3), ("rust", "fn", "a.rs", 9), ("rust", "fn", "a.rs", 2), ("rust", "let", "a.rs", 1)], "lang string, node string, path string, l int")
    counted = census.counted(met)
    assert {(r["node"], r["n"], r["sample"]) for r in counted.collect()} == {("fn", 3, "a.rs:2"), ("let", 1, "a.rs:1")}
    found = census.classify(counted.drop("sample"), registry.where("node = 'fn' AND lang = 'rust'"), F.col("node") == "let")
    assert {(r["status"], r["types"], r["nodes"]) for r in census.audit(found).collect()} == {("extracted", 1, 3), ("unclassified", 1, 1)}
    with pytest.raises(ValueError, match="rust/let"):
        census.audit(found, strict=True)


@pytest.mark.parametrize("most", [400, 2_000_000])
def test_notes_bound_by_the_best_way(spark, monkeypatch, most):
    from canopyql.plans import verbs

    monkeypatch.setattr(verbs, "PAIRS", most)
    names, files = ["a", "b", "c", None], ["x", "y", None]
    notes = [(i % 37, names[i % 4], files[i % 3], names[i // 4 % 4], names[i // 16 % 4]) for i in range(80)]
    notes += [(100 + i, names[i % 4], files[i // 4 % 3], names[i // 12 % 4], names[i // 48 % 4]) for i in range(192)] + [(None, "a", "x", "b", "c")] * 2
    symbols = [(i % 17, names[i % 3], files[i % 2]) for i in range(20)] + [(None, "a", "x"), (None, "b", "y")]
    want = {}
    for note, sym, file, rel, alias in notes:
        for s, n, p in symbols:
            for i, hit in enumerate((sym == n, file == p, rel == n, alias == n), 1):
                if hit and (n if i != 2 else p) is not None:
                    want[note, s] = min(i, want.get((note, s), 9))
    n = spark.createDataFrame(notes, "note_id long, sym string, file string, rel string, alias string")
    s = spark.createDataFrame(symbols, "sym_id long, n string, p string")
    got = [((r["note_id"], r["sym_id"]), r["priority"]) for r in verbs.bind_notes(n, s).collect()]
    assert len(got) == len(want) and dict(got) == want
    # notes and symbols with ids of their own: the pairs themselves are neither grouped nor shuffled
    once = verbs.bind_notes(n.where("note_id >= 100"), s.dropDuplicates(["sym_id"]))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "min(priority" not in plan and "Aggregate [note_id" not in plan


@pytest.mark.parametrize(("a", "b"), [(400, 400), (900, 100), (1, 900), (900, 1)])
def test_notes_and_symbols_are_seldom_repeated(spark, monkeypatch, a, b):
    """A file of many notes and many symbols is dealt over many tasks, and neither side is repeated for all of them."""
    from canopyql.plans import verbs

    monkeypatch.setattr(verbs, "PAIRS", 400)
    notes = spark.range(a).select(F.col("id").alias("note_id"), *[F.lit(x).cast("string").alias(c) for c, x in (("sym", "s"), ("file", "x"), ("rel", None), ("alias", None))])
    symbols = spark.range(b).select(F.col("id").alias("sym_id"), F.lit("n").alias("n"), F.lit("x").alias("p"))
    out = verbs.bind_notes(notes, symbols)
    assert out.count() == out.distinct().count() == a * b
    joined = out._jdf.queryExecution().optimizedPlan()
    while joined.nodeName() != "Join":
        joined = joined.children().apply(0)
    rows = 0
    for i in range(2):
        side = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, joined.children().apply(i))
        rows += side.count()
    assert rows < 2.5 * a * b / 20 + 3 * (a + b)


@pytest.mark.parametrize("many", [2, 50_000])
def test_pairs_within_groups(spark, monkeypatch, many):
    from canopyql.operators import graph

    monkeypatch.setattr(graph, "MANY", many)
    rows = [(i * 7 % 9, i * i % 13) for i in range(60)]
    want = {(a, b) for g, a in rows for h, b in rows if g == h and a < b}
    out = graph.pairs_within(spark.createDataFrame(rows, "group long, member long"))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    # pairs are not rows of a join before they are distinct
    assert "Join Inner" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("span", "nodes"), [(1 << 22, 1_000_000), (3, 0)])
def test_ranks_write_a_byte_or_two_an_edge(spark, monkeypatch, tmp_path, span, nodes):
    """Suppliers of a part are linked pair by pair, but the pairs are written as packed lists, once, and never shuffled."""
    from canopyql.operators import graph
    from canopyql.plans import catalog

    written = []
    real = graph.stage

    def stage(df, what="stage"):
        out = real(df, what)
        written.append((out.count(), sum(os.path.getsize(f.removeprefix("file:").replace("//", "/")) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(graph, "stage", stage)
    monkeypatch.setattr(graph, "SPAN", span, raising=False)
    monkeypatch.setattr(graph, "BROADCAST_NODES", nodes, raising=False)
    n, r = 700, np.random.default_rng(3)
    items = {(part, int(s)) for part in range(8) for s in r.choice(n, 350, replace=False)}
    spark.createDataFrame([*items, (9, None), (None, 3)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n - 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    link = np.zeros((n, n), bool)
    for part in range(8):
        of = sorted(s for p, s in items if p == part)
        link[np.ix_(of, of)] = True
    link = np.triu(link, 1)
    deg, rank = link.sum(1)[: n - 1], np.full(n - 1, 1 / (n - 1))
    for _ in range(20):
        got = link[: n - 1, : n - 1].T @ np.where(deg > 0, rank / np.maximum(deg, 1), 0)
        rank = 0.15 / (n - 1) + 0.85 * (got + rank[deg == 0].sum() / (n - 1))
    rows = sorted(catalog.queries()["pagerank20"](spark, str(tmp_path)).collect())
    assert [x["sym_id"] for x in rows] == list(range(n - 1)) and np.allclose([x["rank"] for x in rows], rank, atol=2e-9)
    assert max(rows for rows, _ in written) <= n and max(size for _, size in written) < 1.5 * link.sum()


def test_pairs_of_any_ids(spark):
    from canopyql.operators import graph

    low, high = -(2**63), 2**63 - 1
    rows = [(1, low), (1, high), (1, 0), (1, -5), (2, high), (2, 0), (2, 127), (2, 128), (2, 1 << 40), (3, 7)]
    want = {(a, b) for g, a in rows for h, b in rows if g == h and a < b}
    got = [tuple(r) for r in graph.pairs_within(spark.createDataFrame(rows, "group long, member long")).collect()]
    assert len(got) == len(want) and set(got) == want
    # the same as edges that go both ways, some twice
    edges = [*want, *((b, a) for a, b in want), (0, high)]
    ids = sorted({a for a, _ in edges})
    at = {x: i for i, x in enumerate(ids)}
    step = np.zeros((len(ids), len(ids)))
    for a, b in edges:
        step[at[b], at[a]] += 1
    rank = np.full(len(ids), 1 / len(ids))
    for _ in range(4):
        rank = 0.15 / len(ids) + 0.85 * (step / step.sum(0)) @ rank
    out = graph.pagerank(spark.createDataFrame([(x,) for x in ids], "sym_id long"), spark.createDataFrame(edges, "src long, dst long"), 4).collect()
    assert np.allclose([x["rank"] for x in sorted(out)], rank, atol=1e-12)


@pytest.mark.parametrize("most", [0, 200_000])
def test_places_settle_references(spark, monkeypatch, most):
    """Many references of few names and files are settled once a name and file; the wide summaries never meet them one by one."""
    monkeypatch.setattr(resolve, "BROADCAST_NAMES", most)
    monkeypatch.setattr(resolve, "BROADCAST_HASHES", most)
    met = []
    real = resolve._beside
    monkeypatch.setattr(resolve, "_beside", lambda rows, names, on, how: met.append((rows.count(), list(names.columns))) or real(rows, names, on, how))
    rows = [(i, f"lib/f{i % 3}.ts", ["alpha", "beta", "gamma"][i % 3] if i < 6 else f"user{i}", "fn", i, i, False, None, True) for i in range(90)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    texts = symbols.withColumn("body", F.lit("alpha beta gamma unknown words here"))
    refs = resolve.references(texts, F.col("body"))
    out = resolve.decided_by_name(symbols, refs)
    got = {(r["src"], r["tk"]): (r["prov"], r["dst"]) for r in out.collect()}
    names = {"alpha": (0, 3), "beta": (1, 4), "gamma": (2, 5)}
    want = {(i, n): ("ambiguous", None) for i in range(90) for n, ids in names.items() if i not in ids}
    assert got == want
    assert all(count <= 18 for count, columns in met if "any_low" in columns or "sf_low" in columns)


def test_qualified_by_bounded_tasks(spark, monkeypatch):
    rows = [(i, f"lib/f{i}.rs", f"name{i % 4}" if i < 40 else f"user{i}", "fn", i, i, False, f"m{i}::name{i % 4}", True) for i in range(60)]
    symbols = spark.createDataFrame(rows, SYMBOLS)
    refs = spark.createDataFrame([(i, f"m{i % 40}", f"name{j}") for i in range(40, 60) for j in range(4)] + [(50, "m1", "nothing")], "src long, path string, name string")
    monkeypatch.setattr(resolve, "SORTED", 10)
    out = resolve.qualified(symbols, refs)
    got = {(r["src"], r["tk"]): (r["prov"], r["dst"]) for r in out.collect()}
    assert got == {(i, f"name{i % 4}"): ("qname", i % 40) for i in range(40, 60)}
    assert "RepartitionByExpression" in out._jdf.queryExecution().optimizedPlan().toString()
