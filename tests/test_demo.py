"""A small corpus worked out by hand: symbols, spans, edges, ranks and scores."""

import pytest

from canopyql.plans.repository import STEPS, Repository, change_comment
from canopyql.sources import side, tree

ORDERS = '''"""Orders."""

RATE = 0.1


class Order:
    def __init__(self, items):
        self.items = items

    def total(self):
        return sum(item["price"] for item in self.items)


def discount(order):
    """Uses total."""
    return order.total() * (1 - RATE)


def checkout(order):
    return {"payable": discount(order)}
'''
TOOL = """export interface Spec {
  name: string;
}

export class Registry {
  private specs: Spec[] = [];

  register(spec: Spec): void {
    this.specs.push(spec);
  }
}

// Builds one.
// With a default.
export function buildRegistry(): Registry {
  const registry = new Registry();
  registry.register({ name: "grep" });
  return registry;
}
"""
USAGE = """import { buildRegistry as make, Spec } from "./tool";
export { Registry as Reg } from "./tool";

export function describe(): string {
  const made = make();
  return made ? `${made}` : "none";
}
"""
RUST = """/// A thing.
pub const fn build_thing() -> u8 { 1 }
static mut COUNTER: u8 = 0;
use crate::other::{helper as assist};
pub use crate::other::Shared;
"""
GUIDE = "# Guide\n\nSee buildRegistry and discount.\n\n## Details\n"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    for name, text in {"a/orders.py": ORDERS, "a/tool.ts": TOOL, "a/usage.ts": USAGE, "b/lib.rs": RUST, "docs/guide.md": GUIDE, "node_modules/x.js": "function hidden() {}", "notes.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return tree.read_tree(spark, str(root))


@pytest.fixture(scope="module")
def repo(spark, files):
    """By lines alone."""
    return Repository.build(spark, files, parse=False)


def test_tree_skips_and_languages(files):
    got = {r["path"]: r["lang"] for r in files.collect()}
    assert got == {"a/orders.py": "py", "a/tool.ts": "ts", "a/usage.ts": "ts", "b/lib.rs": "rust", "docs/guide.md": "md"}


def test_symbols_spans_and_complexity(repo):
    rows = {(r["p"], r["n"]): r for r in repo.symbols.collect()}
    got = {k: (r["t"], r["l"], r["el"], r["local"]) for k, r in rows.items()}
    assert got[("a/orders.py", "RATE")] == ("var", 3, 5, False)
    assert got[("a/orders.py", "Order")] == ("class", 6, 13, False)
    assert got[("a/orders.py", "total")] == ("fn", 10, 13, False)
    assert got[("a/tool.ts", "registry")][3] is True
    assert rows[("a/orders.py", "Order")]["cx_own"] == 0
    assert rows[("a/tool.ts", "buildRegistry")]["doc"] == "Builds one. With a default."
    assert rows[("docs/guide.md", "Guide")]["t"] == "sec"
    assert rows[("docs/guide.md", "Guide")]["el"] >= rows[("docs/guide.md", "Details")]["l"] - 1
    ids = [r["sym_id"] for r in sorted(rows.values(), key=lambda r: (r["p"], r["l"]))]
    assert ids == list(range(len(ids)))


def test_const_fn_and_static_mut_have_their_names(repo):
    names = {r["n"]: r["t"] for r in repo.symbols.where("p = 'b/lib.rs'").collect()}
    assert names == {"build_thing": "fn", "COUNTER": "const"}


def test_edges(repo):
    s = {r["sym_id"]: r["n"] for r in repo.symbols.collect()}
    got = {(s[r["src"]], s[r["dst"]], r["prov"]) for r in repo.edges.collect()}
    assert ("checkout", "discount", "same-file") in got
    assert ("discount", "RATE", "same-file") in got
    assert ("Registry", "Spec", "same-file") in got
    assert ("describe", "buildRegistry", "alias") in got
    assert ("Guide", "buildRegistry", "doc") in got
    assert not [e for e in got if e[0] == e[1]]


def test_aliases_and_reexports(repo):
    assert {(r["local"], r["original"]) for r in repo.aliases.collect()} == {("make", "buildRegistry"), ("assist", "helper")}
    assert {(r["name"], r["as"]) for r in repo.reexports.collect()} == {("Registry", "Reg"), ("Shared", "Shared")}


def test_questions(spark, repo, tmp_path):
    n = {r["n"]: r["sym_id"] for r in repo.symbols.collect()}
    assert {r["src"] for r in repo.callers("discount").collect()} == {n["checkout"]}
    assert n["checkout"] in {r["sym_id"] for r in repo.impact("total", 3).collect()}
    assert abs(sum(r["rank"] for r in repo.ranks().collect()) - 1) < 1e-9
    found = repo.search("registry", 5).collect()
    assert found[0]["n"] in ("Registry", "registry") and [r["position"] for r in found] == list(range(1, len(found) + 1))
    assert found[0]["amb"] == 1 and len(repo.search("registry", 5, budget=1).collect()) == 1
    assert [r["term"] for r in repo.misses("Registry nothing").collect()] == ["nothing"]
    with pytest.raises(ValueError, match="top"):
        repo.search("registry", 0)
    assert repo.symbol("iscoun").first()["exact"] is False
    changed = spark.createDataFrame([("a/orders.py",)], "path string")
    assert {r["n"] for r in repo.affected(changed).collect()} == {"Guide"} - {"Guide"}  # only a document names them, and it makes no call
    assert {r["n"] for r in repo.affected(spark.createDataFrame([("a/tool.ts",)], "path string")).collect()} == {"describe", "made"}
    assert [(r["path"], r["as"]) for r in repo.handed_on("Registry").collect()] == [("a/usage.ts", "Reg")]
    assert [r["path"] for r in repo.importers("helper").collect()] == ["b/lib.rs"]
    assert "<details>" in change_comment(repo.affected(changed), ["a/orders.py"])
    tag = repo.tags(repo.symbol("total")).first()["tag"]
    assert tag.startswith('<s t="fn" n="total" p="a/orders.py" l="10"')
    report = repo.report()
    assert "## Hubs" in report and "## Files" in report and "5 files" in report
    assert {r["step"] for r in repo.steps().collect()} == set(STEPS)
    repo.save(str(tmp_path / "index"))
    again = Repository.load(spark, str(tmp_path / "index"))
    assert repo.drift(again).isEmpty() and repo.check(again).isEmpty()
    repo.save_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "edges")).count() == repo.edges.count()
    repo.export(str(tmp_path / "views"))
    assert spark.read.json(str(tmp_path / "views" / "hub_ranking")).count() == repo.hubs(50).count()


POLICY = """
version: 1
modules:
  - id: app   # the application
    roots: [a]
    managed: true
    requires: []
    publicEntrypoints: [a/tool.ts]
  - id: docs
    roots: docs
    managed: true
global:
  forbidCycles: true
"""


def test_policy(spark, repo):
    rules = side.parse_policy(POLICY)
    assert [m["id"] for m in rules["modules"]] == ["app", "docs"]
    assert rules["modules"][1]["roots"] == ["docs"]
    assert not side.policy_errors(rules)
    assert side.policy_errors(side.parse_policy("modules:\n  - id: x\n"))
    assert repo.policy(spark, rules).isEmpty()
    rules = side.parse_policy(POLICY.replace("roots: [a]", "roots: [a, b]").replace("requires: []", "requires: [ghost]").replace("a/tool.ts]", "a/tool.ts, a/none.ts]") + "  # end\n")
    got = {(r["rule"], r["detail"]) for r in repo.policy(spark, rules).collect()}
    assert got == {("unknown-module", "ghost"), ("missing-entrypoint", "a/none.ts")}


TWO = """
modules:
  - id: tools
    roots: [a/tool.ts]
    managed: true
    publicEntrypoints: [a/other.ts]
  - id: rest
    roots: [a]
"""


def test_policy_dependencies(spark, repo):
    found = repo.policy(spark, side.parse_policy(TWO))
    rows = {r["rule"]: r for r in found.collect()}
    assert set(rows) == {"module-dependency", "deep-import", "missing-entrypoint"} and all(r["new"] for r in rows.values())
    assert rows["module-dependency"]["file"] == "a/usage.ts" and rows["module-dependency"]["module"] == "rest"
    known = repo.policy(spark, side.parse_policy(TWO), found.where("rule = 'deep-import'"))
    assert {r["rule"] for r in known.where("new").collect()} == {"module-dependency", "missing-entrypoint"}
    loose = side.parse_policy(TWO + "global:\n  forbidDeepImports: false\n")
    assert repo.policy(spark, loose).where("rule = 'deep-import'").isEmpty()


def test_notes_round_trip(spark, tmp_path):
    path = str(tmp_path / "notes")
    side.append_note(spark, path, {"sym": "total", "note": "sum of items", "tags": ["x"]})
    side.append_note(spark, path, {"file": "gone.py", "note": "old"})
    with open(f"{path}/bad.json", "w") as f:
        f.write("{not json\n")
    notes = side.read_notes(spark, path)
    assert notes.where("note IS NOT NULL").count() == 2


def test_arriving_files_are_streamed(spark, tmp_path):
    from canopyql.streaming import incremental

    (tmp_path / "in" / "src").mkdir(parents=True)
    (tmp_path / "in" / "src" / "a.py").write_text("def alpha():\n    return 1\n")
    (tmp_path / "in" / "src" / "b.bin").write_text("x")
    seen = []
    stream = incremental.stream_tree(spark, str(tmp_path / "in"))
    incremental.reindex(stream, str(tmp_path / "state"), lambda df, _: seen.extend(r["lang"] for r in df.collect())).awaitTermination(120)
    assert seen == ["py"]


def test_git_listing(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    (tmp_path / "a.py").write_text("x = 1\n")
    run("init", "-q", "-b", "main")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "b.py").write_text("y = 2\n")
    run("checkout", "-qb", "work")
    (tmp_path / "a.py").write_text("x = 3\n")
    run("commit", "-qam", "second")
    spark.dataSource.register(tree.GitListing)
    assert sorted(r["path"] for r in spark.read.format("git_listing").option("root", str(tmp_path)).load().collect()) == ["a.py", "b.py"]
    assert sorted(r["path"] for r in tree.git_files(spark, str(tmp_path)).collect()) == ["a.py", "b.py"]
    assert {r["path"]: r["churn"] for r in tree.churn(spark, str(tmp_path)).collect()} == {"a.py": 2}
    assert [r["path"] for r in tree.changed_files(spark, str(tmp_path), "main", ["./c.py"]).collect()] == ["a.py", "c.py"]
    first = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "main"], check=True, capture_output=True, text=True).stdout.strip()
    assert tree.head(str(tmp_path)) not in (None, first) and tree.distance(str(tmp_path), first) == (1, 0) and tree.distance(str(tmp_path), "none") is None
    gone = tree.missing_files(spark.createDataFrame([("a.py",), ("zz.py",)], "path string"), tree.read_tree(spark, str(tmp_path)))
    assert [r["path"] for r in gone.collect()] == ["zz.py"]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"def fine():\n    return '\xff\xfe'\n")
    (tmp_path / "b.py").write_text("def other():\n    return fine()\n")
    files = tree.read_tree(spark, str(tmp_path))
    assert [r["path"] for r in tree.unreadable(files).collect()] == ["a.py"]
    got = Repository.build(spark, files)
    assert {r["n"] for r in got.symbols.collect()} == {"fine", "other"}
    assert [r["prov"] for r in got.edges.collect()] == ["name"]
