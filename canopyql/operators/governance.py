"""Module rules: dependencies between modules, entry points, cycles, fingerprints, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.operators.graph import strong_components


def modules_of(paths_table: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, module): the module with the longest root above a path, the earlier declared on ties.

    roots: (root, module, position). Paths are spread into their prefixes, which makes the longest-prefix
    match an equi-join followed by an aggregate.
    """
    spread = paths_table.select("path").distinct().select("path", F.explode(paths.prefixes(F.col("path"))).alias("root"))
    hit = spread.join(roots, "root").groupBy("path").agg(F.max_by("module", F.struct(F.char_length("root").alias("a"), (-F.col("position")).alias("b"))).alias("module"))
    return paths_table.select("path").distinct().join(hit, "path", "left")


def dependencies(links: DataFrame, module_of: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """One row a module pair: n, sample (first path), deep (links past the entry points), deep_sample.

    links: (from_path, to_path, ord); entrypoints: (module, entry) of the modules that name any.
    """
    a = module_of.select(F.col("path").alias("from_path"), F.col("module").alias("a"))
    b = module_of.select(F.col("path").alias("to_path"), F.col("module").alias("b"))
    named = entrypoints.select(F.col("module").alias("b")).distinct().withColumn("named", F.lit(True))
    entry = entrypoints.select(F.col("module").alias("b"), F.col("entry").alias("to_path"), F.lit(True).alias("is_entry"))
    x = links.join(a, "from_path").join(b, "to_path").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    x = x.join(named, "b", "left").join(entry, ["b", "to_path"], "left")
    deep = F.coalesce("named", F.lit(False)) & ~F.coalesce("is_entry", F.lit(False))
    return x.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("from_path", "ord").alias("sample"),
        F.sum(deep.cast("int")).alias("deep"),
        F.min_by("from_path", F.when(deep, F.col("ord"))).alias("deep_sample"),
    )


def fingerprint(rule: Column, file: Column, detail: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0000", rule, file, detail), 256), 1, 16)


def unmapped(links: DataFrame, module_of: DataFrame) -> DataFrame:
    a = module_of.select(F.col("path").alias("from_path"), F.col("module").alias("a"))
    b = module_of.select(F.col("path").alias("to_path"), F.col("module").alias("b"))
    return links.join(a, "from_path").join(b, "to_path").agg(F.coalesce(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("int")), F.lit(0)).cast("long").alias("unmapped"))


def unique_imports(imports: DataFrame, symbols: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """(from_path, to_path) of imported names (path, name) that exactly one symbol has, impls and members aside."""
    one = symbols.where(~F.col("t").isin("impl", *members)).groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("to_path")).where("c = 1")
    return imports.select(F.col("path").alias("from_path"), F.col("name").alias("n")).distinct().join(one, "n").select("from_path", "to_path")


def unknown(roots: DataFrame, requires: DataFrame, entries: DataFrame, known_paths: DataFrame) -> DataFrame:
    """(rule, module, detail): modules that are required but not declared, and entry points that are no file of known_paths (path)."""
    a = requires.join(roots.select(F.col("module").alias("required")).distinct(), "required", "left_anti").select(F.lit("unknown-module").alias("rule"), "module", F.col("required").alias("detail"))
    b = entries.join(known_paths.select(F.col("path").alias("entry")).distinct(), "entry", "left_anti").select(F.lit("missing-entrypoint").alias("rule"), "module", F.col("entry").alias("detail"))
    return a.union(b)


#: Pairs up to which a rule file's modules are looked at on the driver; more are left to ``graph.strong_components``.
FEW_PAIRS = 5_000


def on_cycles(pairs: list[tuple]) -> set:
    """The members of pairs that reach themselves: in order of leaving a walk, those that walks backwards meet together."""
    out: dict = {}
    into: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)

    def walk(start, along: dict, seen: set) -> list:
        left, stack = [], [(start, iter(along.get(start, ())))]
        seen.add(start)
        while stack:
            for x in stack[-1][1]:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(along.get(x, ()))))
                    break
            else:
                left.append(stack.pop()[0])
        return left

    seen: set = set()
    order = [x for a in out if a not in seen for x in walk(a, out, seen)]
    seen, found = set(), {a for a, b in pairs if a == b}
    for a in reversed(order):
        if a not in seen and len(group := walk(a, into, seen)) > 1:
            found |= set(group)
    return found


def in_cycles(pairs: DataFrame) -> DataFrame:
    """(module): modules that reach themselves over pairs (a, b)."""
    pairs = pairs.select("a", "b").distinct()
    few = pairs.limit(FEW_PAIRS + 1).collect()
    if len(few) > FEW_PAIRS:
        return strong_components(pairs).select(F.col("node").alias("module"))
    return pairs.sparkSession.createDataFrame([(x,) for x in sorted(on_cycles([tuple(r) for r in few]))], pairs.select(F.col("a").alias("module")).schema)


def cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles closed by back edges of a depth-first walk, one for each set of members; modules are few and named by hand."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    found: dict[frozenset, list[str]] = {}
    for root in sorted(out):
        if state.get(root):
            continue
        walk = [(root, iter(out.get(root, [])))]
        state[root], path = 1, [root]
        while walk:
            nxt = next(walk[-1][1], None)
            if nxt is None:
                state[walk.pop()[0]] = 2
                path.pop()
            elif state.get(nxt) == 1:
                ring = path[path.index(nxt) :]
                found.setdefault(frozenset(ring), [*ring, nxt])
            elif not state.get(nxt):
                state[nxt] = 1
                path.append(nxt)
                walk.append((nxt, iter(out.get(nxt, []))))
    return list(found.values())


def compare(violations: DataFrame, baseline: DataFrame) -> DataFrame:
    """violations with new: not accounted for by a fingerprint of the baseline."""
    known = baseline.select("fp").distinct().withColumn("known", F.lit(True))
    return violations.join(known, "fp", "left").withColumn("new", F.col("known").isNull()).drop("known")
