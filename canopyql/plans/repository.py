"""An indexed repository: tables built once, questions asked of them."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.functions.text import escaped, strip_noise, token_estimate
from canopyql.operators import census, digests, extract, governance, graph, resolve, score
from canopyql.plans import verbs
from canopyql.session import stage
from canopyql.sources import parsers, side, tree

STEPS = ("extract", "symbols", "graph", "scores", "ambiguity")


@dataclass
class Repository:
    """The relations of an index; ``build`` makes them from files (path, lang, bytes, text)."""

    files_table: DataFrame
    symbols: DataFrame
    edges: DataFrame
    decided: DataFrame
    type_edges: DataFrame
    aliases: DataFrame
    imports: DataFrame
    reexports: DataFrame
    churn: DataFrame
    config: score.HubConfig = field(default_factory=score.HubConfig)
    commit: str | None = None
    timings: list[tuple[str, int]] = field(default_factory=list)

    @staticmethod
    def build(spark: SparkSession, files: DataFrame, churn: DataFrame | None = None, config: score.HubConfig | None = None, commit: str | None = None, parse: bool = True) -> Repository:
        """Files go through their language's parser; those without one, that don't parse or are very long are read line by line."""
        began, timings = time.time(), []

        def done(step: str) -> None:
            nonlocal began
            timings.append((step, round(1000 * (time.time() - began))))
            began = time.time()

        none = spark.createDataFrame([], parsers.FILE)
        parsed = stage(parsers.parsed(files), "parsed") if parse else none
        exact = parsed.select(F.col("path").alias("p"), "lang", F.explode("symbols").alias("s")).select("p", "lang", "s.*")
        done("extract")
        by_line = files.join(parsed.select("path"), "path", "left_anti") if parse else files
        wanted = exact.select(F.col("p").alias("path"), "l").distinct()
        docs = extract.doc_comments(extract.lines_of(files.join(parsed.select("path"), "path", "left_semi"))).join(wanted, ["path", "l"], "left_semi").select(F.col("path").alias("p"), "l", "doc")
        exact = exact.join(docs, ["p", "l"], "left").withColumn("body", F.lit(None).cast("string"))
        found = extract.by_lines(by_line)
        symbols = stage(extract.with_ids(found.unionByName(exact.select(found.columns))), "symbols")
        done("symbols")
        one = lambda column, a, b: parsed.select("path", F.explode(column).alias("x")).select("path", F.col("x.name").alias(a), F.col("x.local").alias(b))
        renamed = one("imports", "original", "local").where("local <> original").select("path", "local", "original")
        aliases = stage(extract.aliases_of(by_line).unionByName(renamed).distinct(), "aliases")
        imports = stage(extract.imports_of(by_line).unionByName(one("imports", "name", "local")).distinct(), "imports")
        reexports = stage(extract.reexports_of(by_line).unionByName(one("handed", "name", "as")).distinct(), "reexports")
        texts = resolve.references(symbols.where("refs IS NULL"), strip_noise(F.col("body"), F.col("lang")))
        refs = texts.unionByName(resolve.references(symbols.where("refs IS NOT NULL"), tokens=F.col("refs")))
        qrefs = symbols.select(F.col("sym_id").alias("src"), F.posexplode("qrefs").alias("pos", "x")).select("src", "x.path", "x.name", "pos")
        decided = stage(resolve.resolve(symbols, refs, aliases, qrefs), "decided")
        types = stage(resolve.type_edges(symbols, resolve.references(symbols, tokens=F.col("trefs"), least=2)), "types")
        edges = stage(resolve.edges(decided), "edges")
        done("graph")
        history = churn if churn is not None else spark.createDataFrame([], "path string, churn long")
        table = files.select("path", "lang", "bytes").join(symbols.groupBy(F.col("p").alias("path")).agg(F.count(F.lit(1)).alias("n_symbols")), "path", "left")
        table = stage(table.withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0))), "files")
        return Repository(table, symbols.drop("body", "refs", "trefs", "qrefs"), edges, decided, types, aliases, imports, reexports, history, config or score.HubConfig(), commit, timings)

    def _tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}

    def save(self, path: str) -> None:
        side.write_artifact(self._tables(), path, self.commit)

    def save_json(self, path: str) -> None:
        side.write_json(self._tables(), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Repository:
        tables, commit = side.read_artifact(spark, path)
        return Repository(**tables, commit=commit)

    @property
    def calls(self) -> DataFrame:
        return resolve.calls(self.edges)

    @property
    def type_links(self) -> DataFrame:
        return self.type_edges.where("dst IS NOT NULL").select("src", "dst").distinct()

    def stats(self) -> DataFrame:
        """One row: files, symbols, edges, type edges, ambiguous and local-only references."""
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        of = lambda prov: self.decided.where(F.col("prov") == prov)
        parts = [n(self.files_table, "files"), n(self.symbols, "symbols"), n(self.edges, "edges"), n(self.type_links, "type_edges"), n(of("ambiguous"), "ambiguous"), n(of("local-only"), "local_only")]
        return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)

    @cached_property
    def _ranks(self) -> DataFrame:
        return graph.pagerank(self.symbols, self.calls)

    @cached_property
    def _hubs(self) -> DataFrame:
        return stage(score.hub_scores(self.symbols, self.calls, self.config), "hubs")

    def ranks(self) -> DataFrame:
        """(sym_id, rank), made when first asked for."""
        return self._ranks

    def hub_scores(self) -> DataFrame:
        """The symbols that can be hubs, with all factors of their scores; made when first asked for."""
        return self._hubs

    def hubs(self, top: int = 25, collation: str | None = None) -> DataFrame:
        """The highest scores; names of equal score in binary order, or in that of a collation."""
        return score.hub_ranking(self.hub_scores(), score.positive(top, "top"), collation)

    def symbol(self, name: str) -> DataFrame:
        return verbs.find_symbol(self.symbols, name)

    def callers(self, name: str) -> DataFrame:
        """The links to all definitions of a name; conf says how far those to a definition can be trusted."""
        return verbs.with_confidence(graph.callers(self.calls, self.symbols, name), self.confidence(), "dst")

    def answer(self, rows: DataFrame, name: str) -> DataFrame:
        """(name, n, defs, conf): one row about the rows that ``callers``, ``callees`` or ``impact`` gave for a name."""
        return verbs.answer(rows, self.symbols, self.confidence(), name)

    def handed_on(self, name: str) -> DataFrame:
        """(path, as): files that hand the name on; such a file makes no call, so few callers need not mean few users."""
        return self.reexports.where(F.col("name") == name).select("path", "as")

    def callees(self, name: str) -> DataFrame:
        """The links from the first definition of a name, each with conf of the symbol that it leads to."""
        return verbs.with_confidence(graph.callees(self.calls, self.symbols, name), self.confidence(), "dst")

    def impact(self, name: str, depth: int = 3, all_definitions: bool = False, types: bool = False) -> DataFrame:
        """(sym_id, depth, family, conf, rank): what reaches the first definition of a name (or all), by rank; then, as family
        ``dispatch``, the methods that implement a trait's method of that name and are not among them."""
        hits = self.symbols.where(F.col("n") == name).select("sym_id")
        seeds = hits if all_definitions else hits.agg(F.min("sym_id").alias("sym_id")).where("sym_id IS NOT NULL")
        e = self.calls.select("src", "dst", F.lit("call").alias("family"))
        if types:
            e = e.unionByName(self.type_links.withColumn("family", F.lit("type")))
        found = stage(graph.impact(e, seeds, score.positive(depth, "depth")), "impact")
        given = graph.dispatch(self.symbols).join(hits.withColumnRenamed("sym_id", "method"), "method", "left_semi").select(F.col("provider").alias("sym_id")).distinct()
        given = given.join(found.select("sym_id"), "sym_id", "left_anti").select("sym_id", F.lit(None).cast("int").alias("depth"), F.lit("dispatch").alias("family"))
        labelled = verbs.with_confidence(found.unionByName(given), self.confidence(), "sym_id")
        return labelled.join(self.ranks(), "sym_id").orderBy(F.col("family") == "dispatch", F.col("rank").desc(), "sym_id")

    def affected(self, changed: DataFrame, depth: int = 2) -> DataFrame:
        """What reaches any symbol of the changed files (path), without those."""
        seeds = self.symbols.join(changed.withColumnRenamed("path", "p"), "p", "left_semi").select("sym_id")
        return graph.impact(self.calls, seeds, score.positive(depth, "depth")).join(self.symbols, "sym_id").orderBy("p", "l")

    def search(self, query: str, top: int = 12, budget: int | None = 6000, collation: str | None = None) -> DataFrame:
        """The symbols that answer a question, with rank, position, hub (norm) and amb (definitions of the name); as many of
        them as fit the budget of tokens, one at least. ``misses`` tells the terms that no symbol is named by."""
        norms = score.hub_norm(self.hub_scores())
        found = score.lens_top(score.lens(self.symbols, query, norms, self.churn), score.positive(top, "top"), collation)
        same = self.symbols.groupBy("n").agg(F.count(F.lit(1)).alias("amb"))
        x = found.drop("hub_norm").join(norms, "sym_id", "left").join(same, "n").withColumn("hub", F.coalesce("hub_norm", F.lit(0.0))).drop("hub_norm")
        # at most top rows
        x = x.withColumn("position", F.row_number().over(Window.orderBy(F.col("rank").desc(), score.ordered("p", collation), "l", "sym_id")))
        if budget is not None:
            x = score.within_budget(x, token_estimate(F.concat_ws(" ", "t", "n", "p", "sig")), score.positive(budget, "budget"))
        return x.orderBy("position")

    def misses(self, query: str) -> DataFrame:
        return score.misses(self.symbols, query)

    def context(self, name: str, notes: DataFrame | None = None, depth: int = 2) -> DataFrame:
        """(relation, sym_id, p, l, n, detail): all that is known of a name's definitions, one row a fact."""
        s = self.symbols.select("sym_id", "p", "l", "n")
        hits = stage(self.symbols.where(F.col("n") == name).select("sym_id", "sig"), "hits")
        ids = hits.select("sym_id")

        def near(e: DataFrame, end: str, other: str, relation: str, detail: str | None = None) -> DataFrame:
            x = verbs.linked(e, ids, end)
            return x.select(F.lit(relation).alias("relation"), F.col(other).alias("sym_id"), (F.col(detail) if detail else F.lit(None)).cast("string").alias("detail"))

        reach = graph.impact(self.calls, ids, depth, keep_seeds=False)
        parts = [
            hits.select(F.lit("definition").alias("relation"), "sym_id", F.col("sig").alias("detail")),
            near(self.calls, "dst", "src", "caller", "prov"), near(self.calls, "src", "dst", "callee", "prov"),
            reach.select(F.lit("impact").alias("relation"), "sym_id", F.col("depth").cast("string").alias("detail")),
            near(self.type_links, "dst", "src", "type-in"), near(self.type_links, "src", "dst", "type-out"),
            near(self.edges.where("prov = 'doc'"), "dst", "src", "doc"),
        ]
        if notes is not None:
            bound = verbs.bind_notes(notes, self.symbols).join(ids, "sym_id", "left_semi").join(notes.select("note_id", "note"), "note_id")
            parts.append(bound.select(F.lit("note").alias("relation"), "sym_id", F.col("note").alias("detail")))
        facts = reduce(lambda a, b: a.unionByName(b), parts).join(s, "sym_id").select("relation", "sym_id", "p", "l", "n", "detail")
        files = self.imports.where(F.col("name") == name).select(F.lit("import").alias("relation"), F.lit(None).cast("long").alias("sym_id"), F.col("path").alias("p"), F.lit(None).cast("int").alias("l"), F.col("name").alias("n"), F.col("local").alias("detail"))
        return facts.unionByName(files.distinct())

    def importers(self, name: str) -> DataFrame:
        """(path, local): files that import a name."""
        return self.imports.where(F.col("name") == name).select("path", "local").distinct()

    def ambiguous(self, docs: bool = False, live: bool = False, collation: str | None = None) -> DataFrame:
        """Names with several definitions, the most referred to first; those of headings alone only if docs, those without references not if live."""
        g = score.ambiguity_groups(self.symbols, resolve.ambiguous_references(self.decided))
        g = g if docs else g.where("docs < defs")
        return (g.where("refs > 0") if live else g).orderBy(F.col("refs").desc(), F.col("defs").desc(), score.ordered("name", collation))

    def members(self) -> DataFrame:
        return score.group_members(self.symbols, graph.in_degree(self.calls))

    def confidence(self) -> DataFrame:
        return score.confidence(self.symbols, graph.in_degree(self.calls), self.config)

    def implementations(self, name: str) -> DataFrame:
        """impl blocks of a trait or for a type."""
        return self.symbols.where((F.col("t") == "impl") & ((F.col("tr") == name) | (F.col("n") == name)))

    def providers(self, trait: str) -> DataFrame:
        """(method, providers) of a trait's methods: how many methods implement each."""
        named = self.symbols.select(F.col("sym_id").alias("method"), F.col("n").alias("name"), "p", "l", "el")
        inside = graph.contained(self.symbols.where((F.col("t") == "trait") & (F.col("n") == trait)), self.symbols).select(F.col("member").alias("method"))
        return graph.dispatch(self.symbols).join(inside, "method", "left_semi").groupBy("method").agg(F.count_distinct("provider").alias("providers")).join(named, "method")

    def type_references(self, name: str) -> DataFrame:
        """(direction, sym_id): symbols that refer to a type of that name (in), and types that its definitions refer to (out)."""
        ids = self.symbols.where(F.col("n") == name).select("sym_id")
        inward = self.type_links.join(ids.withColumnRenamed("sym_id", "dst"), "dst", "left_semi").select(F.lit("in").alias("direction"), F.col("src").alias("sym_id"))
        return inward.union(self.type_links.join(ids.withColumnRenamed("sym_id", "src"), "src", "left_semi").select(F.lit("out"), F.col("dst")))

    def tree(self, top: int = 40, each: int = 8) -> DataFrame:
        return graph.tree(self.symbols, self.ranks(), top, each)

    def files(self, directory: str | None = None) -> DataFrame:
        """Files, those without symbols too, with their symbols' number and complexity."""
        s = self.symbols.groupBy("p").agg(F.max("cx").alias("cx_max"), F.sum("cx").alias("cx_sum"), F.min_by("n", F.struct(-F.col("cx"), "sym_id")).alias("worst"))
        x = self.files_table.select(F.col("path").alias("p"), "bytes", "n_symbols").join(s, "p", "left")
        x = x.withColumns({"cx_max": F.coalesce("cx_max", F.lit(0)), "cx_sum": F.coalesce("cx_sum", F.lit(0).cast("long"))})
        return x if directory is None else x.where(paths.under(F.col("p"), F.lit(directory)))

    def duplicates(self) -> DataFrame:
        """Base names that several files have."""
        return self.files_table.groupBy(paths.base_name(F.col("path")).alias("name")).agg(F.count_distinct("path").alias("copies")).where("copies > 1").orderBy(F.col("copies").desc(), "name")

    def drift(self, other: Repository) -> DataFrame:
        """(relation, key, here, there) of symbols and edges that only one of two indexes has; churn does not count."""
        return digests.drift(self.keys(), other.keys(), (self.digest_tree, other.digest_tree))

    def keys(self) -> DataFrame:
        """(relation, path, key): what makes two indexes equal, symbols and edges, below the paths that they stand in."""
        s = self.symbols
        key = s.select(F.lit("symbol").alias("relation"), F.col("p").alias("path"), F.concat_ws("|", "p", "n", "t", F.col("l").cast("string"), F.col("el").cast("string")).alias("key"))
        place = s.select(F.col("sym_id").alias("src"), F.col("p").alias("path"))
        edge = self.edges.join(place, "src").select(F.lit("edge").alias("relation"), "path", F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"), "prov").alias("key"))
        return key.unionByName(edge)

    @cached_property
    def digest_tree(self) -> DataFrame:
        """The digest tree of ``keys``, written once."""
        return stage(digests.digest_tree(self.keys()), "digests")

    def check(self, now: Repository, notes: DataFrame | None = None, root: str | None = None, report: str | None = None) -> DataFrame:
        """(problem, detail): what a fresh index has otherwise, notes about what is gone, how far the tree has moved since,
        and figures that a report states and the fresh index does not have."""
        out = self.drift(now).select(F.concat(F.lit("drift-"), "relation").alias("problem"), F.col("key").alias("detail"))
        if notes is not None:
            out = out.unionByName(verbs.drifted_notes(notes, now.symbols).select(F.lit("note").alias("problem"), F.coalesce("sym", "file").alias("detail")))
        moved = tree.distance(root, self.commit) if root and self.commit else None
        found = [(f"tree-{k}", f"{n} commits") for k, n in zip(("ahead", "behind"), moved or (), strict=False) if n]
        if report is not None:
            stated, is_now = figures_of(report), now.stats().first().asDict()
            found += [(f"report-{k}", f"{stated.get(k, 'missing')}, now {n}") for k, n in is_now.items() if stated.get(k) != n]
        return out.unionByName(out.sparkSession.createDataFrame(found, "problem string, detail string"))

    def steps(self) -> DataFrame:
        """(step, ms, rows): the five steps of a run, the last two made now, with their times."""
        spark = self.symbols.sparkSession
        rows = {"extract": self.files_table.count(), "symbols": self.symbols.count(), "graph": self.edges.count()}
        out = [(s, ms, rows[s]) for s, ms in self.timings]
        later: tuple[tuple[str, Callable[[], int]], ...] = (("scores", lambda: self.hub_scores().count()), ("ambiguity", lambda: self.ambiguous().count()))
        for step, run in later:
            began = time.time()
            n = run()
            out.append((step, round(1000 * (time.time() - began)), n))
        return spark.createDataFrame(out, "step string, ms long, rows long")

    def policy(self, spark: SparkSession, rules: dict, baseline: DataFrame | None = None) -> DataFrame:
        """Violations of the module rules, each new or accounted for."""
        if errors := side.policy_errors(rules):
            raise ValueError("; ".join(errors))
        roots, requires, entries = side.policy_tables(spark, rules)
        managed = [m["id"] for m in rules["modules"] if m["managed"]]
        s = self.symbols.select("sym_id", "p")
        links = self.calls.join(s.select(F.col("sym_id").alias("src"), F.col("p").alias("from_path")), "src").join(s.select(F.col("sym_id").alias("dst"), F.col("p").alias("to_path")), "dst")
        # calls come first, in the order of their symbols, then imports in the order of paths
        order = lambda kind, src, dst: F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.col("from_path").alias("a"), F.col("to_path").alias("b")).alias("ord")
        links = links.select("from_path", "to_path", order(0, F.col("src").cast("long"), F.col("dst").cast("long")))
        named = governance.unique_imports(self.imports, self.symbols, resolve.MEMBERS)
        links = links.unionByName(named.select("from_path", "to_path", order(1, F.lit(0).cast("long"), F.lit(0).cast("long"))))
        links = links.where(~paths.is_vendor(F.col("to_path")))
        known = self.files_table.select("path")
        module_of = stage(governance.modules_of(known, roots), "modules")
        deps = governance.dependencies(links, module_of, entries.where(F.col("module").isin(managed)))
        deps = stage(deps.where(F.col("a").isin(managed) | F.col("b").isin(managed)), "deps")
        found = verbs.violations(deps, requires)
        if not rules["global"]["forbidDeepImports"]:
            found = found.where("rule <> 'deep-import'")
        wrong = governance.unknown(roots, requires, entries, known).select("rule", F.when(F.col("rule") == "missing-entrypoint", F.col("detail")).otherwise("").alias("file"), "detail", "module")
        rings = []
        if rules["global"]["forbidCycles"]:
            # modules are few and named by hand: the pairs of those on cycles fit on the driver
            on = governance.in_cycles(deps).withColumnRenamed("module", "a")
            rings = governance.cycles([(r["a"], r["b"]) for r in deps.select("a", "b").join(on, "a", "left_semi").collect()])
        own = [("cycle", "", " -> ".join(ring), next((m for m in ring if m in managed), ring[0])) for ring in rings if set(managed) & set(ring)]
        extra = wrong.union(spark.createDataFrame(own, "rule string, file string, detail string, module string"))
        found = found.unionByName(extra.withColumn("fp", governance.fingerprint(F.col("rule"), F.col("file"), F.col("detail"))))
        return governance.compare(found, baseline if baseline is not None else spark.createDataFrame([], "fp string"))

    def tags(self, rows: DataFrame, *extra: str) -> DataFrame:
        """One line of text a row (sym_id and columns named in extra): the symbol as a tag."""
        in_ = graph.in_degree(self.calls).withColumnRenamed("dst", "sym_id")
        x = rows.select("sym_id", *extra).join(self.symbols, "sym_id").join(in_, "sym_id", "left")
        attribute = lambda k, c: F.concat(F.lit(f' {k}="'), escaped(c.cast("string")), F.lit('"'))
        own = F.when(F.col("cx_own") != F.col("cx"), attribute("cxOwn", F.col("cx_own"))).otherwise("")
        parts: list[Column] = [attribute("t", F.col("t")), attribute("n", F.col("n")), F.coalesce(attribute("q", F.col("q")), F.lit("")), attribute("p", F.col("p")), attribute("l", F.col("l")), attribute("cx", F.col("cx")), own, attribute("in", F.coalesce("n_in", F.lit(0)))]
        parts += [attribute(e, F.col(e)) for e in extra]
        return x.select("sym_id", F.concat(F.lit("<s"), *parts, F.lit(">"), escaped(F.col("sig")), F.lit("</s>")).alias("tag"))

    def export(self, path: str, top: int = 50) -> None:
        """Five derived views as JSON lines."""
        hubs = self.hub_scores()
        views = {"skeletons": self.symbols, "call_graph": self.calls, "imports": self.imports, "scored_symbols": hubs, "hub_ranking": score.hub_ranking(hubs, top)}
        for name, df in views.items():
            df.write.mode("overwrite").json(f"{path}/{name}")

    def report(self, top: int = 15, notes: DataFrame | None = None) -> str:
        """A Markdown report: figures, hubs, ambiguous names, heavy files, the files' best symbols, notes."""
        line = lambda r, *c: "| " + " | ".join(str(r[x]) for x in c) + " |"
        table = lambda title, *c: ["", f"## {title}", "", "| " + " | ".join(c) + " |", "|" + " --- |" * len(c)]
        stats = self.stats().first().asDict()
        out = ["# Repository map", "", ", ".join(f"{n:,} {k.replace('_', ' ')}" for k, n in stats.items()) + "."]
        out += table("Hubs", "symbol", "file", "score")
        out += [line(r.asDict() | {"score": round(r["score"], 3)}, "n", "p", "score") for r in self.hubs(top).collect()]
        out += table("Ambiguous names", "name", "definitions", "references")
        out += [line(r, "name", "defs", "refs") for r in self.ambiguous().limit(top).collect()]
        out += table("Heavy files", "file", "symbols", "complexity")
        out += [line(r, "p", "n_symbols", "cx_sum") for r in self.files().orderBy(F.col("cx_sum").desc(), "p").limit(top).collect()]
        out += ["", "## Files", ""]
        for r in self.tree(top, 6).groupBy("p").agg(F.max("best").alias("best"), F.sort_array(F.collect_list(F.struct("position", "n", "l"))).alias("all")).orderBy(F.col("best").desc(), "p").collect():
            out.append(f"- `{r['p']}`: " + ", ".join(f"{x['n']} ({x['l']})" for x in r["all"]))
        if notes is not None:
            out += ["", "## Notes", ""] + [f"- {r['sym'] or r['file'] or ''}: {r['note']}" for r in notes.orderBy("note").limit(top).collect()]
        return "\n".join(out) + "\n"


def figures_of(report: str) -> dict[str, int]:
    """The figures that a report's first paragraph states, by their names."""
    line = next((x for x in report.split("\n") if re.match(r"[0-9][0-9,]* [a-z]", x)), "")
    return {name.strip().replace(" ", "_"): int(n.replace(",", "")) for n, name in re.findall(r"([0-9][0-9,]*) ([a-z][a-z ]*)", line)}


def pr_affected(spark: SparkSession, root: str, kept: Repository | None = None, base: str | None = None, files: list[str] | None = None, depth: int = 2) -> tuple[Repository, DataFrame, str]:
    """(index, affected, comment) of a change: indexes the tree, keeps the index given unless anything in it has changed,
    finds what reaches the changed files (since a revision, and those named), and says so in a comment."""
    now = Repository.build(spark, tree.read_tree(spark, root, listed=tree.git_files(spark, root)), tree.churn(spark, root), commit=tree.head(root))
    repo = now if kept is None or not kept.drift(now).isEmpty() else kept
    changed = tree.changed_files(spark, root, base, files)
    affected = stage(repo.affected(changed, depth), "affected")
    names = [r["path"] for r in changed.collect()]
    seeds = repo.symbols.join(changed.withColumnRenamed("path", "p"), "p", "left_semi").count()
    head = f"{seeds} symbols in the changed files, {affected.count()} affected, depth {depth}" + (f", since {base}" if base else "")
    return repo, affected, head + "\n\n" + change_comment(affected.orderBy("depth", "p", "l"), names)


def decl_audit(files: DataFrame, registry: DataFrame, declares: Column, strict: bool = False) -> DataFrame:
    """One row a language and status of the node types in a tree's files; strict: ValueError if one that declares is not registered."""
    return census.audit(stage(census.of_files(files, registry, declares), "census"), strict)


def change_comment(affected: DataFrame, changed: list[str], most: int = 40) -> str:
    """A change's effect as a Markdown comment."""
    rows = affected.limit(most + 1).collect()
    lines = [f"- `{r['p']}`:{r['l']} {r['n']} (depth {r['depth']})" for r in rows[:most]]
    more = ["- and more"] if len(rows) > most else []
    return "\n".join([f"**{len(changed)} changed files may affect:**", "<details>", "", *lines, *more, "", "</details>"])
