"""A small repository through the parsers: every provenance, types, dispatch, imports, ambiguity."""

import pytest

from canopyql.plans.repository import Repository
from canopyql.sources import tree

FILES = {
    "src/shape.rs": "pub trait Drawer {\n    fn draw(&self) -> u32;\n}\npub struct Circle;\nimpl Drawer for Circle {\n    fn draw(&self) -> u32 { area_of() }\n}\npub fn area_of() -> u32 { 7 }\npub fn start_here() -> u32 {\n    let it = Circle;\n    Drawer::draw(&it) + area_of()\n}\n",
    "src/far.rs": "pub fn far_caller() -> u32 { area_of() }\n",
    "src/util.ts": "export function addOne(x: number) { return x + 1 }\nexport function useIt(y: number) {\n  const onlyHere = addOne(y)\n  return onlyHere\n}\n",
    "src/user.ts": "import { addOne } from './util'\nexport function importing(z: number) { return addOne(z) }\n",
    "README.md": "# A repository\n\n## How to\n\nuseIt and area_of are reached.\n",
    "src/named.rs": "pub fn first_name() -> u32 { 1 }\n",
    "src/renames.rs": "use crate::named::first_name as second_name;\npub fn by_alias() -> u32 { second_name() }\n",
    "src/s_one.ts": "export function twin() { return 1 }\nexport function twinCaller() { return twin() }\n",
    "src/s_two.ts": "export function twin() { return 2 }\n",
    "src/l_one.ts": "export interface Entry { oneField: number }\nexport function entryUser() { return Entry }\n",
    "src/l_two.ts": "export interface Entry { twoField: string }\n",
    "src/v_one.ts": "export function target() { return 1 }\n",
    "src/v_two.ts": "function target() { return 2 }\n",
    "src/v_three.ts": "export function targetCaller() { return target() }\n",
    "src/t_one.rs": "pub struct Config { pub limit: u32 }\n",
    "src/t_two.rs": "pub fn make_config() -> Config { Config { limit: 1 } }\n",
    "src/p_one.rs": "pub struct Pair;\nimpl Pair { pub fn size(&self) -> u32 { 1 } }\n",
    "src/p_two.rs": "pub struct Pair;\n",
    "src/p_use.rs": "pub fn pair_user() { other(Pair) }\n",
    "docs/one.md": "# Same Title\n",
    "docs/two.md": "# Same Title\n",
    "src/own.rs": "pub fn outer_fn(a: u32) -> u32 {\n    fn inner_fn(b: u32) -> u32 { if b > 1 { 2 } else { 3 } }\n    if a > 0 { inner_fn(a) } else { 0 }\n}\n",
    "src/da/same.rs": "pub fn in_a() {}\n",
    "src/db/same.rs": "pub fn in_b() {}\n",
    "src/bad.py": "def broken(:\n    pass\n",
}


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("parsed")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return Repository.build(spark, tree.read_tree(spark, str(root)))


@pytest.fixture(scope="module")
def names(repo):
    return {r["sym_id"]: (r["p"].split("/")[-1], r["q"] or r["n"]) for r in repo.symbols.collect()}


def edges(repo, names, prov):
    return sorted((names[r["src"]][1], *names[r["dst"]]) for r in repo.edges.where(f"prov = '{prov}'").collect())


def test_each_provenance(repo, names):
    assert edges(repo, names, "qname") == [("start_here", "shape.rs", "Drawer::draw")]
    assert edges(repo, names, "alias") == [("by_alias", "named.rs", "first_name")]
    assert edges(repo, names, "scope-unique") == [("twinCaller", "s_one.ts", "twin")]
    assert edges(repo, names, "lexical") == [("entryUser", "l_one.ts", "Entry")]
    assert edges(repo, names, "visibility") == [("targetCaller", "v_one.ts", "target")]
    assert ("How to", "util.ts", "useIt") in edges(repo, names, "doc")
    assert not [e for p in ("qname", "name", "same-file") for e in edges(repo, names, p) if e[2] == "Circle::draw"]


def test_types_are_apart_from_calls(spark, repo, names):
    links = {(names[r["src"]][1], names[r["dst"]][1]) for r in repo.type_links.collect()}
    assert ("make_config", "Config") in links
    assert not [r for r in repo.calls.collect() if names[r["dst"]][1] == "Config"]
    ids = {v[1]: k for k, v in names.items()}
    assert {r["sym_id"] for r in repo.type_references("Config").where("direction = 'in'").collect()} == {ids["make_config"]}
    assert ids["make_config"] not in {r["sym_id"] for r in repo.impact("Config", 1).collect()}
    assert (ids["make_config"], "type") in {(r["sym_id"], r["family"]) for r in repo.impact("Config", 1, types=True).collect()}


def test_impact_and_dispatch(spark, repo, names):
    got = {(names[r["sym_id"]][1], r["family"]) for r in repo.impact("draw").collect()}
    assert ("Circle::draw", "dispatch") in got and ("start_here", "call") in got
    assert [(r["name"], r["providers"]) for r in repo.providers("Drawer").collect()] == [("draw", 1)]
    assert {r["n"] for r in repo.affected(spark.createDataFrame([("src/shape.rs",)], "path string"), 1).collect()} == {"far_caller"}
    assert {r["tr"] for r in repo.implementations("Drawer").collect()} == {"Drawer"}


def test_imports_and_context(repo, names):
    assert [r["path"] for r in repo.importers("addOne").collect()] == ["src/user.ts"]
    facts = {(r["relation"], r["n"]) for r in repo.context("Config").collect()}
    assert ("definition", "Config") in facts and ("type-in", "make_config") in facts
    facts = {(r["relation"], r["p"], r["n"]) for r in repo.context("addOne").collect()}
    assert ("import", "src/user.ts", "addOne") in facts and ("caller", "src/user.ts", "importing") in facts


def test_ambiguity(repo):
    groups = {r["name"]: r for r in repo.ambiguous(docs=True).collect()}
    assert (groups["Pair"]["defs"], groups["Pair"]["impls"], groups["Pair"]["refs"]) == (3, 1, 1)
    assert "Same Title" in groups and "Same Title" not in {r["name"] for r in repo.ambiguous().collect()}
    assert "Pair" in {r["name"] for r in repo.ambiguous(live=True).collect()}


def test_own_complexity_duplicates_and_unparsed(repo):
    rows = {r["n"]: r for r in repo.symbols.collect()}
    assert rows["outer_fn"]["cx_own"] < rows["outer_fn"]["cx"] and rows["inner_fn"]["cx_own"] == rows["inner_fn"]["cx"] == 2
    assert [(r["name"], r["copies"]) for r in repo.duplicates().collect()] == [("same.rs", 2)]
    assert rows["broken"]["t"] == "fn" and rows["broken"]["exp"] is None  # by lines
    files = {r["p"]: r for r in repo.files().collect()}
    assert set(files) == set(FILES) and files["src/own.rs"]["cx_max"] == 3


def test_integrity(repo):
    s, e = repo.symbols, repo.edges
    assert s.where("el < l OR l < 1").isEmpty() and s.groupBy("p", "l", "n", "t").count().where("count > 1").isEmpty()
    assert e.where("src = dst").isEmpty() and e.groupBy("src", "dst", "prov").count().where("count > 1").isEmpty()
    assert e.join(s.select("sym_id", "t"), e["dst"] == s["sym_id"]).where("t IN ('field', 'prop', 'variant')").isEmpty()
    stats = repo.stats().first()
    assert stats["files"] == len(FILES) and stats["edges"] == e.count()
    ids = sorted(r["sym_id"] for r in s.collect())
    assert ids == list(range(len(ids)))
