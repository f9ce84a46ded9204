"""Registered queries, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.functions.text import strip_noise, token_estimate
from canopyql.operators import census, digests, extract, governance, graph, resolve, score
from canopyql.plans import virtual as v
from canopyql.plans.verbs import answer, with_confidence
from canopyql.session import stage, table
from canopyql.sources import parsers, tree

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
_BASE = "WITH RECURSIVE " + v.SQL.replace("GENERIC_LIST", ", ".join(f"'{g}'" for g in score.GENERIC))


def query(name: str, sql: str | None = None, base: bool = True):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = (_BASE if base else "") + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scans and text -------------------------------------------------------------------------------------

_URL_PATH = r"^https?://[^/]+/([^?#]*)"


@query(
    "scan_filter_skip",
    rf"""SELECT page_id, path FROM (SELECT page_id, regexp_extract(url, '{_URL_PATH}', 1) AS path, octet_length(encode(html)) AS bytes FROM pages)
    WHERE NOT regexp_matches(path, '{paths.SKIPPED_PATTERN}') AND NOT list_contains(string_split(path, '/'), 'fr') AND NOT (path = 'de/1' OR starts_with(path, 'de/1/'))
      AND NOT regexp_matches(path, '^es/[^/]*7(/|$)') AND bytes <= {paths.MAX_BYTES}""",
    base=False,
)
def scan_filter_skip(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", _URL_PATH, 1).alias("path"), F.octet_length("html").alias("bytes"))
    return p.where(~paths.skipped(F.col("path"), ["fr", "de/1", "es/*7"]) & (F.col("bytes") <= paths.MAX_BYTES)).select("page_id", "path")


@query("scan_languages", ", x AS (SELECT CASE WHEN p LIKE '%.ts' THEN 'ts' WHEN p LIKE '%.rs' THEN 'rust' WHEN p LIKE '%.py' THEN 'py' ELSE 'md' END AS language, p, body FROM syms) SELECT language, count(*) AS n, count(DISTINCT p) AS files, CAST(sum(octet_length(encode(body))) AS BIGINT) AS bytes FROM x GROUP BY language")
def scan_languages(spark, d):
    s = v.index(spark, d).symbols.withColumn("language", paths.language(F.col("p")))
    return s.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("files"), F.sum("bytes").cast("long").alias("bytes"))


@query("tokens_distinct", "SELECT src, tk FROM refs")
def tokens_distinct(spark, d):
    return v.index(spark, d).references.select("src", "tk")


@query(
    "noise_strip",
    r"""SELECT page_id, length(b) AS n_left, sha256(b) AS digest FROM (SELECT page_id,
      regexp_replace(html, '([:A-Za-z0-9_]//)|/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*|"(?:[^"\\\n]|\\[^\n])*"|''(?:\\[^\n]|[^''\\\n])''|`(?:[^`\\]|\\(?:.|\n))*`', '\1 ', 'g') AS b FROM pages)""",
    base=False,
)
def noise_strip(spark, d):
    b = table(spark, d, "pages").select("page_id", strip_noise(F.col("html"), F.lit("rust")).alias("b"))
    return b.select("page_id", F.char_length("b").cast("long").alias("n_left"), F.sha2("b", 256).alias("digest"))


@query("branch_count", "SELECT sym_id, cx FROM syms")
def branch_count(spark, d):
    return v.index(spark, d).symbols.select("sym_id", "cx")


@query("line_symbols", v.SOURCES_SQL + "SELECT path, l, n, t, indent FROM decl", base=False)
def line_symbols(spark, d):
    return extract.declarations(v.sources(spark, d)).select("path", "l", "n", "t", "indent")


@query("doc_comment", v.SOURCES_SQL + "SELECT path, l, doc FROM decl", base=False)
def doc_comment(spark, d):
    return extract.declarations(v.sources(spark, d)).select("path", "l", "doc")


@query(
    "span_infer",
    v.SOURCES_SQL + """, size AS (SELECT path, 3 * count(*) AS n_lines FROM decl GROUP BY path)
    SELECT path, l, CAST(coalesce((SELECT min(b.l) FROM decl b WHERE b.path = a.path AND b.l > a.l AND b.indent <= a.indent) - 1, n_lines) AS INT) AS el FROM decl a JOIN size USING (path)""",
    base=False,
)
def span_infer(spark, d):
    files = v.sources(spark, d)
    return extract.spans(extract.declarations(files), files).select("path", "l", "el")


@query(
    "container_chain",
    v.SOURCES_SQL + """, size AS (SELECT path, 3 * count(*) AS n_lines FROM decl GROUP BY path),
    s AS (SELECT path, l, n, CAST(coalesce((SELECT min(b.l) FROM decl b WHERE b.path = a.path AND b.l > a.l AND b.indent <= a.indent) - 1, n_lines) AS INT) AS el FROM decl a JOIN size USING (path)),
    up AS (SELECT m.path, m.l, h.n, h.l AS h_l, row_number() OVER (PARTITION BY m.path, m.l ORDER BY h.l DESC) AS near FROM s m JOIN s h ON h.path = m.path AND m.l > h.l AND m.el <= h.el)
    SELECT s.path, s.l, coalesce(any_value(c.chain) || '::', '') || s.n AS q FROM s LEFT JOIN (SELECT path, l, string_agg(n, '::' ORDER BY h_l) AS chain FROM up WHERE near <= 40 GROUP BY path, l) c ON c.path = s.path AND c.l = s.l GROUP BY s.path, s.l, s.n""",
    base=False,
)
def container_chain(spark, d):
    files = v.sources(spark, d)
    s = stage(extract.spans(extract.declarations(files), files).select(F.col("path").alias("p"), "l", "el", "n", F.concat_ws(":", "path", "l").alias("sym_id")), "spans")
    return graph.container_chains(s).join(s.select("sym_id", F.col("p").alias("path"), "l"), "sym_id").select("path", "l", "q")


@query(
    "parsed_symbols",
    v.CODE_SQL
    + """SELECT path, 'C' || k AS n, CASE lang WHEN 'rust' THEN 'impl' ELSE 'class' END AS t, before + 1 AS l, before + CASE lang WHEN 'py' THEN 3 ELSE 5 END AS el, NULL::VARCHAR AS q FROM placed
    UNION ALL SELECT path, name, CASE lang WHEN 'rust' THEN 'fn' ELSE 'method' END, before + 2, before + CASE lang WHEN 'py' THEN 3 ELSE 4 END, 'C' || k || '::' || name FROM placed""",
    base=False,
)
def parsed_symbols(spark, d):
    return parsers.table_function(v.code(spark, d), "parsed_symbols").select("path", "n", "t", "l", "el", "q")


@query("parsed_refs", v.CODE_SQL + "SELECT path, name AS n, w[2] AS tk FROM placed WHERE length(w[2]) >= 3 AND w[2] <> name UNION ALL SELECT path, 'C' || k, unnest(list_distinct(CASE lang WHEN 'py' THEN [w[2]] ELSE [name, w[2]] END)) FROM placed", base=False)
def parsed_refs(spark, d):
    return parsers.table_function(v.code(spark, d), "parsed_symbols").select("path", "n", F.explode("refs").alias("tk"))


@query(
    "parsed_containers",
    v.CODE_SQL + "SELECT path, 'C' || k AS n, 'C' || k AS q FROM placed UNION ALL SELECT path, name, 'C' || k || '::' || name FROM placed",
    base=False,
)
def parsed_containers(spark, d):
    s = parsers.table_function(v.code(spark, d), "parsed_symbols").select(F.concat_ws(":", "path", "l").alias("sym_id"), F.col("path").alias("p"), "l", "el", "n")
    s = stage(s, "spans")
    return graph.container_chains(s).join(s.select("sym_id", F.col("p").alias("path"), "n"), "sym_id").select("path", "n", "q")


_NODES = """, met AS (
    SELECT lang, unnest(CASE lang WHEN 'py' THEN ['ClassDef', 'FunctionDef', 'arg', 'Return', 'Name'] WHEN 'ts' THEN ['class', name, 'return'] ELSE ['impl', 'fn', w[2]] END) AS node FROM placed
), reg(lang, node, status) AS (VALUES ('py', 'ClassDef', 'extracted'), ('py', 'Name', 'covered'), ('ts', 'class', 'extracted'), ('rust', 'impl', 'extracted'), ('rust', 'union', 'extracted')),
    cen AS (SELECT lang, node, count(*) AS n FROM met GROUP BY lang, node),
    cls AS (SELECT lang, node, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'stale' WHEN status IS NOT NULL THEN status WHEN node LIKE '%Def' OR node = 'fn' THEN 'unclassified' END AS status FROM cen FULL JOIN reg USING (lang, node))"""


def _nodes_registry(spark) -> DataFrame:
    return spark.createDataFrame([("py", "ClassDef", "extracted", ""), ("py", "Name", "covered", ""), ("ts", "class", "extracted", ""), ("rust", "impl", "extracted", ""), ("rust", "union", "extracted", "")], "lang string, node string, status string, reason string")


@query("node_census", v.CODE_SQL.rstrip() + _NODES + " SELECT lang, node, n, status FROM cls", base=False)
def node_census(spark, d):
    return census.of_files(v.code(spark, d), _nodes_registry(spark), F.col("node").endswith("Def") | (F.col("node") == "fn"))


@query("decl_audit", v.CODE_SQL.rstrip() + _NODES + " SELECT lang, status, count(*) AS types, CAST(sum(n) AS BIGINT) AS nodes FROM cls WHERE status IS NOT NULL GROUP BY lang, status", base=False)
def decl_audit(spark, d):
    return census.audit(node_census(spark, d))


_CHANGED = """, was AS (SELECT p || '|' || n || '|' || t || '|' || l || '|' || el AS key FROM syms),
    now AS (SELECT p || '|' || n || '|' || t || '|' || l || '|' || (CASE WHEN starts_with(p, 'lib/en/src1') AND sym_id % 7 = 0 THEN el + 1 ELSE el END) AS key FROM syms WHERE NOT (p LIKE '%.py' AND sym_id % 11 = 0))"""


@query("drift_digest", _CHANGED + " SELECT key, w.key IS NOT NULL AS was, n.key IS NOT NULL AS now FROM (SELECT DISTINCT key FROM was) w FULL JOIN (SELECT DISTINCT key FROM now) n USING (key) WHERE w.key IS NULL OR n.key IS NULL")
def drift_digest(spark, d):
    s = v.index(spark, d).symbols
    keyed = lambda x: x.select(F.lit("symbol").alias("relation"), F.col("p").alias("path"), F.concat_ws("|", "p", "n", "t", F.col("l").cast("string"), F.col("el").cast("string")).alias("key"))
    now = s.where(~(F.col("p").endswith(".py") & (F.col("sym_id") % 11 == 0))).withColumn("el", F.when(F.col("p").startswith("lib/en/src1") & (F.col("sym_id") % 7 == 0), F.col("el") + 1).otherwise(F.col("el")))
    out = digests.drift(keyed(s), keyed(now))
    return out.select("key", F.col("here").isNotNull().alias("was"), F.col("there").isNotNull().alias("now"))


@query("cx_own", "SELECT s.sym_id, CAST(greatest(s.cx - coalesce(sum(i.cx), 0), 0) AS INT) AS cx_own FROM syms s LEFT JOIN syms i ON i.p = s.p AND i.l > s.l AND i.l <= s.el GROUP BY s.sym_id, s.cx")
def cx_own(spark, d):
    return extract.own_complexity(v.index(spark, d).symbols)


@query("alias_scan", v.MODULES_SQL + " SELECT DISTINCT path, 'beta' || k AS local_name, 'alpha' || k AS original FROM m", base=False)
def alias_scan(spark, d):
    return extract.aliases_of(v.modules_text(spark, d)).withColumnRenamed("local", "local_name")


@query("reexports", v.MODULES_SQL + " SELECT path, 'Delta' || k AS name, 'pub' || k AS shown FROM m WHERE ts UNION ALL SELECT path, 'eps' || k, 'eps' || k FROM m WHERE ts UNION ALL SELECT path, 'delta' || k, 'delta' || k FROM m WHERE NOT ts", base=False)
def reexports(spark, d):
    return extract.reexports_of(v.modules_text(spark, d)).withColumnRenamed("as", "shown")


@query("imports_of", v.MODULES_SQL + ", i AS (SELECT path, 'alpha' || k AS name FROM m UNION ALL SELECT path, 'Gamma' || k FROM m WHERE ts UNION ALL SELECT path, unnest(['gamma' || k, 'delta' || k]) FROM m WHERE NOT ts) SELECT name, count(DISTINCT path) AS files FROM i GROUP BY name", base=False)
def imports_of(spark, d):
    return extract.imports_of(v.modules_text(spark, d)).groupBy("name").agg(F.count_distinct("path").alias("files"))


_REGISTRY = {"article": ("extracted", ""), "h1": ("extracted", ""), "p": ("covered", ""), "b": ("covered", ""), "nav": ("skipped", "menus"), "footer": ("skipped", ""), "script": ("skipped", "code"), "main": ("planned", "rare"), "x1": ("odd", "")}
_DECLARED = {"article": "class", "h1": "sec", "h2": "sec", "li": "item"}
_CENSUS = rf""", c AS (SELECT 'html' AS lang, tag AS node, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag),
  r(node, status, reason) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _REGISTRY.items())}), decl(node, kind) AS (VALUES {", ".join(f"('{k}', '{a}')" for k, a in _DECLARED.items())}),
  cl AS (SELECT 'html' AS lang, coalesce(c.node, r.node) AS node, coalesce(c.n, 0) AS n, CASE WHEN c.node IS NULL THEN 'stale' WHEN r.status IS NOT NULL THEN r.status WHEN c.node LIKE 'h%' OR c.node LIKE '%l' THEN 'unclassified' END AS status FROM c FULL JOIN r USING (node))"""


def _census(spark, d) -> DataFrame:
    found = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("node"))
    counts = found.groupBy(F.lit("html").alias("lang"), "node").agg(F.count(F.lit(1)).alias("n"))
    return census.classify(counts, _registry(spark), F.col("node").startswith("h") | F.col("node").endswith("l"))


def _registry(spark) -> DataFrame:
    return spark.createDataFrame([("html", k, *v_) for k, v_ in _REGISTRY.items()], "lang string, node string, status string, reason string")


@query("census_classify", _CENSUS + " SELECT lang, node, n, status FROM cl")
def census_classify(spark, d):
    return _census(spark, d)


@query("census_audit", _CENSUS + " SELECT lang, status, count(*) AS types, CAST(sum(n) AS BIGINT) AS nodes FROM cl WHERE status IS NOT NULL GROUP BY lang, status")
def census_audit(spark, d):
    return census.audit(_census(spark, d))


@query(
    "census_self_check",
    _CENSUS
    + """, dm AS (SELECT node, kind FROM decl WHERE node IN (SELECT node FROM c)) SELECT 'html' AS lang, node, 'declared, not registered as extracted' AS problem FROM dm WHERE node NOT IN (SELECT node FROM r WHERE status = 'extracted')
    UNION ALL SELECT 'html', node, 'registered as extracted, not declared' FROM r WHERE status = 'extracted' AND node NOT IN (SELECT node FROM dm)
    UNION ALL SELECT 'html', node, 'unknown kind' FROM dm WHERE kind NOT IN ('class', 'sec') UNION ALL SELECT 'html', node, 'unknown status' FROM r WHERE status = 'odd'
    UNION ALL SELECT 'html', node, 'no reason given' FROM r WHERE status IN ('planned', 'skipped') AND reason = ''""",
)
def census_self_check(spark, d):
    # what is declared: the tags that pages hold, each with its kind
    kinds = spark.createDataFrame(list(_DECLARED.items()), "node string, kind string")
    met = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("node")).distinct()
    declared = met.join(F.broadcast(kinds), "node").select(F.lit("html").alias("lang"), "node", "kind")
    return census.self_check(declared, _registry(spark))


# --- resolution -----------------------------------------------------------------------------------------


@query("edges_all", "SELECT src, dst, prov FROM edges")
def edges_all(spark, d):
    return v.index(spark, d).edges.select("src", "dst", "prov")


@query("edges_by_prov", "SELECT prov, count(*) AS n FROM edges GROUP BY prov")
def edges_by_prov(spark, d):
    return edges_all(spark, d).groupBy("prov").agg(F.count(F.lit(1)).alias("n"))


def _one_kind(kind: str) -> None:
    @query("edges_" + kind.replace("-", "_"), f"SELECT src, tk, dst FROM dec WHERE prov = '{kind}'")
    def run(spark, d):
        return v.index(spark, d).decided.where(F.col("prov") == kind).select("src", "tk", "dst")


for _kind in ("name", "same-file", "scope-unique", "lexical", "visibility", "alias", "doc"):
    _one_kind(_kind)


@query(
    "edges_qualified",
    r""", qr AS (
      SELECT r.src, r.tk, regexp_replace(CASE r.src % 4 WHEN 0 THEN s.lang WHEN 1 THEN 'crate::' || s.lang WHEN 2 THEN 'x::y::' || s.lang ELSE 'self::super::' || regexp_extract(s.p, '([^/]*)\.[^.]*$', 1) END || '::' || r.tk, '^(?:(?:crate|self|super)::)+', '') AS whole
      FROM refs r JOIN syms s ON s.sym_id = r.src WHERE (r.src + length(r.tk)) % 3 = 0
    ), qd AS (SELECT sym_id, n, t, local, p, CASE WHEN sym_id % 10 = 0 THEN 'app::' || q ELSE q END AS q FROM syms WHERE t NOT IN ('field', 'prop', 'variant') AND NOT vendor),
    qc AS (
      SELECT qr.src, qr.tk, d.sym_id AS dst, d.t IN ('var', 'const') AND coalesce(d.local, FALSE) AS inside FROM qr JOIN qd d ON d.n = qr.tk AND d.sym_id <> qr.src
      WHERE d.q = whole OR ends_with(d.q, '::' || whole) OR ends_with(whole, '::' || d.q)
         OR (d.q IS NULL AND d.p LIKE '%.rs' AND regexp_extract(d.p, '([^/]*)\.[^.]*$', 1) = regexp_extract(whole, '([^:]*)::[^:]*$', 1))
    ), qg AS (SELECT src, tk, count(*) AS k, min(dst) AS one, bool_and(inside) AS inner_all FROM qc GROUP BY src, tk)
    SELECT src, tk, CASE WHEN k = 1 THEN 'qname' WHEN inner_all THEN 'local-only' ELSE 'ambiguous' END AS prov, CASE WHEN k = 1 THEN one END AS dst FROM qg""",
)
def edges_qualified(spark, d):
    x = v.index(spark, d)
    return resolve.qualified(*v.qualified_references(x.symbols, x.references)).select("src", "tk", "prov", "dst")


@query("local_only", "SELECT tk, count(*) AS n FROM dec WHERE prov = 'local-only' GROUP BY tk")
def local_only(spark, d):
    return v.index(spark, d).decided.where("prov = 'local-only'").groupBy("tk").agg(F.count(F.lit(1)).alias("n"))


@query("amb_refs", "SELECT name, refs FROM amb_refs")
def amb_refs(spark, d):
    return resolve.ambiguous_references(v.index(spark, d).decided)


@query("type_edges", "SELECT src, tk, dst FROM tdec WHERE dst IS NOT NULL")
def type_edges(spark, d):
    return v.index(spark, d).types.where("dst IS NOT NULL").select("src", "tk", "dst")


@query("typerefs", ", t AS (SELECT DISTINCT src, dst FROM tdec WHERE dst IS NOT NULL) SELECT s.n, count(*) AS n_refs, count(DISTINCT t.src) AS from_syms FROM t JOIN syms s ON s.sym_id = t.dst GROUP BY s.n")
def typerefs(spark, d):
    s = v.index(spark, d).symbols
    t = v.index(spark, d).types.where("dst IS NOT NULL").select("src", "dst").distinct()
    return t.join(s.select(F.col("sym_id").alias("dst"), "n"), "dst").groupBy("n").agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("src").alias("from_syms"))


_GROUPS = "SELECT n AS name, count(*) AS defs, CAST(sum((t = 'impl')::INT) AS BIGINT) AS impls, CAST(sum((t = 'sec')::INT) AS BIGINT) AS docs, bool_and(vendor) AS vendor_only FROM syms GROUP BY n HAVING count(*) > 1"


@query("amb_groups", f", g AS ({_GROUPS}) SELECT g.*, coalesce(r.refs, 0) AS refs FROM g LEFT JOIN amb_refs r USING (name) WHERE g.docs < g.defs")
def amb_groups(spark, d):
    x = v.index(spark, d)
    g = score.ambiguity_groups(x.symbols, resolve.ambiguous_references(x.decided))
    return g.where("docs < defs").select("name", "defs", "impls", "docs", "vendor_only", "refs")


@query("amb_live", f", g AS ({_GROUPS}) SELECT g.name, g.defs, r.refs FROM g JOIN amb_refs r USING (name) WHERE r.refs > 0 ORDER BY r.refs DESC, g.defs DESC, g.name LIMIT 20")
def amb_live(spark, d):
    x = v.index(spark, d)
    g = score.ambiguity_groups(x.symbols, resolve.ambiguous_references(x.decided)).where("refs > 0")
    return g.orderBy(F.col("refs").desc(), F.col("defs").desc(), "name").limit(20).select("name", "defs", "refs")


@query("amb_expand", ", g AS (SELECT n FROM syms GROUP BY n HAVING count(*) > 1) SELECT s.n, s.sym_id, coalesce(i.n_in, 0) AS n_in, row_number() OVER (PARTITION BY s.n ORDER BY coalesce(i.n_in, 0) DESC, s.p, s.l, s.sym_id) AS position FROM syms s JOIN g USING (n) LEFT JOIN nin i ON i.dst = s.sym_id")
def amb_expand(spark, d):
    return score.group_members(v.index(spark, d).symbols, graph.in_degree(v.index(spark, d).calls))


@query("stats_row", "SELECT (SELECT count(*) FROM syms) AS symbols, (SELECT count(DISTINCT p) FROM syms) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT coalesce(sum(refs), 0)::BIGINT FROM amb_refs) AS ambiguous, (SELECT count(*) FROM dec WHERE prov = 'local-only') AS local_only, (SELECT count(*) FROM tdec WHERE dst IS NOT NULL) AS type_edges")
def stats_row(spark, d):
    x = v.index(spark, d)
    s, dec = x.symbols, x.decided
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(s, "symbols"), s.agg(F.count_distinct("p").alias("files")), n(x.edges, "edges"), n(dec.where("prov = 'ambiguous'"), "ambiguous"), n(dec.where("prov = 'local-only'"), "local_only"), n(x.types.where("dst IS NOT NULL"), "type_edges")]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


@query("edge_integrity", "SELECT count(*) AS edges, count(*) FILTER (src = dst) AS loops, count(*) FILTER (src NOT IN (SELECT sym_id FROM syms) OR dst NOT IN (SELECT sym_id FROM syms)) AS dangling, count(*) FILTER (dst IN (SELECT sym_id FROM syms WHERE t IN ('field', 'prop', 'variant'))) AS to_members FROM edges")
def edge_integrity(spark, d):
    ends = v.index(spark, d).symbols.select("sym_id", "t")
    e = edges_all(spark, d).join(ends.select(F.col("sym_id").alias("src"), F.lit(1).alias("has_src")), "src", "left").join(ends.select(F.col("sym_id").alias("dst"), F.col("t").alias("d_t")), "dst", "left")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return e.agg(F.count(F.lit(1)).alias("edges"), count(F.col("src") == F.col("dst"), "loops"), count(F.col("has_src").isNull() | F.col("d_t").isNull(), "dangling"), count(F.col("d_t").isin(*resolve.MEMBERS), "to_members"))


# --- graph ----------------------------------------------------------------------------------------------


def _staged(spark, d) -> tuple[DataFrame, DataFrame, str]:
    x = v.index(spark, d)
    return x.symbols, x.calls, x.most_called


@query("in_degree", "SELECT dst, n_in FROM nin")
def in_degree(spark, d):
    return graph.in_degree(v.index(spark, d).calls)


@query("callers", "SELECT src, dst, prov FROM calls WHERE dst IN (SELECT sym_id FROM syms WHERE n = (SELECT name FROM seed))")
def callers(spark, d):
    s, calls, name = _staged(spark, d)
    return graph.callers(calls, s, name).select("src", "dst", "prov")


@query("callees", "SELECT src, dst, prov FROM calls WHERE src = (SELECT min(sym_id) FROM syms WHERE n = (SELECT name FROM seed))")
def callees(spark, d):
    s, calls, name = _staged(spark, d)
    return graph.callees(calls, s, name).select("src", "dst", "prov")


_REACH = ", start AS ({seed}), reach(id, d) AS (SELECT id, 0 FROM start UNION SELECT e.src, r.d + 1 FROM reach r JOIN ({edges}) e ON e.dst = r.id WHERE r.d < {depth}) SELECT id AS sym_id, min(d) AS depth FROM reach GROUP BY id HAVING id NOT IN (SELECT id FROM start)"
_FIRST = "SELECT min(sym_id) AS id FROM syms WHERE n = (SELECT name FROM seed)"
_PATH = "lib/en/src1.ts"


def _first_of(s: DataFrame, name: str) -> DataFrame:
    return s.where(F.col("n") == name).agg(F.min("sym_id").alias("sym_id")).where("sym_id IS NOT NULL")


def _impact(depth: int) -> None:
    @query(f"impact_d{depth}", _REACH.format(seed=_FIRST, edges="SELECT src, dst FROM calls", depth=depth))
    def run(spark, d):
        s, calls, name = _staged(spark, d)
        return graph.impact(calls.select("src", "dst"), _first_of(s, name), depth).select("sym_id", "depth")


for _depth in (1, 2, 3):
    _impact(_depth)


@query("impact_types", _REACH.format(seed=_FIRST, edges="SELECT src, dst FROM calls UNION SELECT src, dst FROM tdec WHERE dst IS NOT NULL", depth=3))
def impact_types(spark, d):
    s, calls, name = _staged(spark, d)
    types = v.index(spark, d).types.where("dst IS NOT NULL").select("src", "dst", F.lit("type").alias("family"))
    both = calls.select("src", "dst", F.lit("call").alias("family")).unionByName(types)
    return graph.impact(both, _first_of(s, name), 3).select("sym_id", "depth")


@query("affected", _REACH.format(seed=f"SELECT sym_id AS id FROM syms WHERE p = '{_PATH}'", edges="SELECT src, dst FROM calls", depth=2))
def affected(spark, d):
    s, calls, _ = _staged(spark, d)
    return graph.impact(calls.select("src", "dst"), s.where(F.col("p") == _PATH).select("sym_id"), 2).select("sym_id", "depth")


_SUPPLY = """WITH e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b USING (l_partkey) WHERE a.l_suppkey < b.l_suppkey),
v AS (SELECT s_suppkey AS id FROM supplier), g AS (SELECT src, count(*) AS deg FROM e GROUP BY src), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, c)"""


def _pagerank_sql(rounds: int) -> str:
    steps = [
        f"r{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(x.got, 0) + coalesce((SELECT sum(r) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM g)), 0) / n) AS r FROM v CROSS JOIN c LEFT JOIN (SELECT e.dst, sum(r.r / g.deg) AS got FROM e JOIN r{i - 1} r ON r.id = e.src JOIN g ON g.src = e.src GROUP BY e.dst) x ON x.dst = v.id)"
        for i in range(1, rounds + 1)
    ]
    return _SUPPLY + ", " + ", ".join(steps) + f" SELECT id AS sym_id, round(r, 9) AS rank FROM r{rounds}"


@query("pagerank20", _pagerank_sql(20), base=False)
def pagerank20(spark, d):
    items = table(spark, d, "lineitem").where("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    e = graph.lists_within(items.select(F.col("l_partkey").alias("group"), F.col("l_suppkey").alias("member")))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sym_id"))
    return graph.pagerank(nodes, e).select("sym_id", F.round("rank", 9).alias("rank"))


@query("sorted_names", "SELECT n, row_number() OVER (ORDER BY n COLLATE en, n) AS position FROM (SELECT DISTINCT n FROM syms ORDER BY n COLLATE en, n LIMIT 50)")
def sorted_names(spark, d):
    names = v.index(spark, d).symbols.select("n").distinct()
    first = names.orderBy(score.ordered("n", "UNICODE")).limit(50)
    return first.withColumn("position", F.row_number().over(Window.orderBy(score.ordered("n", "UNICODE"))).cast("long"))


@query("hub_collated", "SELECT n, sym_id, score FROM (SELECT n, sym_id, round(score, 6) AS score FROM hub) ORDER BY score DESC, n COLLATE en, n, sym_id LIMIT 40")
def hub_collated(spark, d):
    h = v.index(spark, d).hubs.select("n", "sym_id", F.round("score", 6).alias("score"))
    return score.hub_ranking(h, 40, "UNICODE")


@query("tree_top", ", x AS (SELECT p, sym_id, coalesce(n_in, 0) AS r FROM syms LEFT JOIN nin ON dst = sym_id), b AS (SELECT p, max(r) AS best FROM x GROUP BY p ORDER BY best DESC, p LIMIT 40), w AS (SELECT x.p, x.sym_id, row_number() OVER (PARTITION BY x.p ORDER BY x.r DESC, x.sym_id) AS position FROM x JOIN b USING (p)) SELECT p, sym_id, position FROM w WHERE position <= 8")
def tree_top(spark, d):
    s, calls, _ = _staged(spark, d)
    ranks = s.select("sym_id").join(graph.in_degree(calls), F.col("sym_id") == F.col("dst"), "left").select("sym_id", F.coalesce("n_in", F.lit(0)).alias("rank"))
    return graph.tree(s.select("sym_id", "p"), ranks).select("p", "sym_id", F.col("position").cast("long").alias("position"))



_DISPATCH = """, sp AS (SELECT sym_id, p, t, n, tr, l, el + 400 AS el FROM syms), me AS (SELECT sym_id, p, n, l, l AS el FROM syms WHERE t IN ('fn', 'method')),
    de AS (SELECT h.n AS trait, m.n, min(m.sym_id) AS method FROM sp h JOIN me m ON m.p = h.p AND m.l > h.l AND m.el <= h.el WHERE h.t = 'trait' GROUP BY h.n, m.n),
    gi AS (SELECT h.tr AS trait, m.n, m.sym_id AS provider FROM sp h JOIN me m ON m.p = h.p AND m.l > h.l AND m.el <= h.el WHERE h.t = 'impl' AND h.tr IS NOT NULL)"""


@query("dispatch", _DISPATCH + " SELECT DISTINCT method, provider FROM de JOIN gi USING (trait, n) WHERE method <> provider")
def dispatch(spark, d):
    s = v.index(spark, d).symbols.select("sym_id", "p", "t", "n", "tr", "l", "el")
    method = F.col("t").isin("fn", "method")
    return graph.dispatch(s.withColumn("el", F.when(method, F.col("l")).otherwise(F.col("el") + 400)))


@query("providers", _DISPATCH + " SELECT method, count(DISTINCT provider) AS providers FROM de JOIN gi USING (trait, n) WHERE method <> provider GROUP BY method")
def providers(spark, d):
    return dispatch(spark, d).groupBy("method").agg(F.count_distinct("provider").alias("providers"))


@query("impls", "SELECT tr AS trait, count(*) AS n_impls, count(DISTINCT p) AS files FROM syms WHERE t = 'impl' GROUP BY tr")
def impls(spark, d):
    return v.index(spark, d).symbols.where("t = 'impl'").groupBy(F.col("tr").alias("trait")).agg(F.count(F.lit(1)).alias("n_impls"), F.count_distinct("p").alias("files"))


@query("fk_impact", """WITH RECURSIVE e(src, dst) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    reach(id, d) AS (SELECT 'r2', 0 UNION SELECT e.src, d + 1 FROM reach JOIN e ON e.dst = id WHERE d < 3) SELECT id AS sym_id, min(d) AS depth FROM reach WHERE d > 0 GROUP BY id""", base=False)
def fk_impact(spark, d):
    t = lambda n, a, b, x, y: table(spark, d, n).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    e = t("nation", "n", "r", "n_nationkey", "n_regionkey").unionByName(t("customer", "c", "n", "c_custkey", "c_nationkey")).unionByName(t("orders", "o", "c", "o_orderkey", "o_custkey"))
    return graph.impact(e, spark.createDataFrame([("r2",)], "sym_id string"), 3).select("sym_id", "depth")


# --- scores ---------------------------------------------------------------------------------------------


def _hubs(spark, d) -> DataFrame:
    return v.index(spark, d).hubs


@query("hub_factors", "SELECT sym_id, win, callers, caller_files, amb, norm, k, pw, nw, sw, bw FROM hub")
def hub_factors(spark, d):
    return _hubs(spark, d).select("sym_id", "win", "callers", "caller_files", "amb", "norm", "k", "pw", "nw", "sw", "bw")


@query("hub_top", "SELECT sym_id, n, p, score FROM hub ORDER BY score DESC, n, sym_id LIMIT 25")
def hub_top(spark, d):
    return score.hub_ranking(_hubs(spark, d)).select("sym_id", "n", "p", "score")


@query("hub_norm", "SELECT sym_id, round(hub_norm, 6) AS hub_norm FROM norms")
def hub_norm(spark, d):
    return score.hub_norm(_hubs(spark, d)).select("sym_id", F.round("hub_norm", 6).alias("hub_norm"))


@query("hub_collapse", ", x AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, sym_id) AS rn FROM hub) SELECT n, sym_id, amb, score FROM x WHERE rn = 1")
def hub_collapse(spark, d):
    return score.collapse(_hubs(spark, d)).select("n", "sym_id", "amb", "score")


_LENS = "tion the ts"
_LENS_POINTS = " + ".join(f"CASE WHEN lower(n) = '{t}' THEN 12 WHEN contains(lower(n), '{t}') THEN 8 ELSE 0 END + CASE WHEN contains(lower(p), '{t}') THEN 4 ELSE 0 END + CASE WHEN contains(lower(doc), '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(sig), '{t}') THEN 2 ELSE 0 END" for t in _LENS.split())
_LENS_SQL = f", lens AS (SELECT * FROM (SELECT s.sym_id, s.n, s.p, s.l, s.t, s.sig, {_LENS_POINTS} AS points, round({_LENS_POINTS} + 1.5 * coalesce(hub_norm, 0) + 0.02 * coalesce(churn, 0), 6) AS rank FROM syms s LEFT JOIN norms USING (sym_id) LEFT JOIN churn ON churn.path = s.p) WHERE points > 0), wide AS (SELECT * FROM lens ORDER BY rank DESC, p, l, sym_id LIMIT 36), one AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY rank DESC, p, l, sym_id) AS rn FROM wide), top AS (SELECT *, row_number() OVER (ORDER BY rank DESC, p, l, sym_id) AS position FROM one WHERE rn = 1 ORDER BY rank DESC, p, l, sym_id LIMIT 12)"


def _lens(spark, d) -> DataFrame:
    norms = score.hub_norm(_hubs(spark, d))
    return score.lens(v.index(spark, d).symbols, _LENS, norms, v.churn(spark, d)).withColumn("rank", F.round("rank", 6))


@query("lens_all", _LENS_SQL + " SELECT sym_id, rank FROM lens")
def lens_all(spark, d):
    return _lens(spark, d).select("sym_id", "rank")


@query("lens_for", _LENS_SQL + " SELECT sym_id, n, rank FROM top")
def lens_for(spark, d):
    return score.lens_top(_lens(spark, d)).select("sym_id", "n", "rank")


@query("lens_budget", _LENS_SQL + ", est AS (SELECT position, sym_id, sum(CAST(ceil(length(regexp_replace(sig, '[^\\x00-\\x{2e7f}]', '', 'g')) / 4 + length(sig) - length(regexp_replace(sig, '[^\\x00-\\x{2e7f}]', '', 'g'))) AS BIGINT)) OVER (ORDER BY position) + 16 AS used FROM top) SELECT sym_id, position, CAST(used AS BIGINT) AS used FROM est WHERE position = 1 OR used <= 200")
def lens_budget(spark, d):
    top = score.lens_top(_lens(spark, d)).withColumn("position", F.row_number().over(Window.orderBy(F.col("rank").desc(), "p", "l", "sym_id")).cast("long"))
    return score.within_budget(top, token_estimate(F.col("sig")), 200).select("sym_id", "position", F.col("used").cast("long").alias("used"))


@query("lens_no_hit", ", q(term) AS (VALUES ('tion'), ('the'), ('nosuchname'), ('and')) SELECT term FROM q WHERE term NOT IN (SELECT lower(n) FROM syms)")
def lens_no_hit(spark, d):
    return score.misses(v.index(spark, d).symbols, "Tion the, nosuchname AND (the)")


@query("symbol_fuzzy", ", e AS (SELECT sym_id, n FROM syms WHERE n = 'hent'), f AS (SELECT sym_id, n FROM syms WHERE contains(lower(n), 'hent') ORDER BY sym_id LIMIT 10) SELECT * FROM e UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM e)")
def symbol_fuzzy(spark, d):
    from canopyql.plans.verbs import find_symbol

    return find_symbol(v.index(spark, d).symbols, "hent").select("sym_id", "n")


_LABELS = f""", a AS (SELECT n, count(*) AS amb FROM syms GROUP BY n), lab AS (SELECT s.sym_id, CASE WHEN amb > 1 AND coalesce(n_in, 0) = 0 THEN 'none' WHEN amb > 1 OR (s.n IN ({", ".join(f"'{g}'" for g in score.GENERIC)}) AND coalesce(n_in, 0) > 0 AND s.t NOT IN ('sec', 'doc') AND NOT s.local AND NOT s.vendor) THEN 'low' END AS conf FROM syms s JOIN a USING (n) LEFT JOIN nin ON dst = sym_id)"""


@query("conf_label", _LABELS + " SELECT sym_id, conf FROM lab")
def conf_label(spark, d):
    return score.confidence(v.index(spark, d).symbols, graph.in_degree(v.index(spark, d).calls))


@query("callers_conf", _LABELS + " SELECT src, dst, prov, conf FROM calls JOIN lab ON sym_id = dst WHERE dst IN (SELECT sym_id FROM syms WHERE n = (SELECT name FROM seed))")
def callers_conf(spark, d):
    s, calls, name = _staged(spark, d)
    return with_confidence(graph.callers(calls, s, name), conf_label(spark, d), "dst").select("src", "dst", "prov", "conf")


@query("impact_conf", _LABELS + _REACH.format(seed=_FIRST, edges="SELECT src, dst FROM calls", depth=2).replace("SELECT id AS sym_id, min(d) AS depth FROM reach GROUP BY id HAVING", ", found AS (SELECT id AS sym_id, min(d) AS depth FROM reach GROUP BY id HAVING") + ") SELECT sym_id, depth, conf FROM found JOIN lab USING (sym_id)")
def impact_conf(spark, d):
    s, calls, name = _staged(spark, d)
    found = graph.impact(calls.select("src", "dst"), _first_of(s, name), 2)
    return with_confidence(found, conf_label(spark, d), "sym_id").select("sym_id", "depth", "conf")


@query("answer_conf", _LABELS + ", k AS (SELECT n AS name, count(*) AS defs, min(sym_id) AS sym_id FROM syms WHERE n = (SELECT name FROM seed) GROUP BY n), c AS (SELECT count(*) AS n FROM calls WHERE dst IN (SELECT sym_id FROM syms WHERE n = (SELECT name FROM seed))) SELECT name, n, defs, CASE WHEN defs > 1 AND n = 0 THEN 'none' WHEN defs > 1 THEN 'low' ELSE conf END AS conf FROM k CROSS JOIN c LEFT JOIN lab USING (sym_id)")
def answer_conf(spark, d):
    s, calls, name = _staged(spark, d)
    return answer(graph.callers(calls, s, name), s, conf_label(spark, d), name)


# --- files ----------------------------------------------------------------------------------------------


@query("files_cx", "SELECT p, count(*) AS n_symbols, max(cx) AS cx_max, CAST(sum(cx) AS BIGINT) AS cx_sum, arg_min(sym_id, (-cx) * 10000000000 + sym_id) AS worst FROM syms GROUP BY p")
def files_cx(spark, d):
    return v.index(spark, d).symbols.groupBy("p").agg(F.count(F.lit(1)).alias("n_symbols"), F.max("cx").alias("cx_max"), F.sum("cx").alias("cx_sum"), F.min_by("sym_id", F.struct(-F.col("cx"), "sym_id")).alias("worst"))


@query("files_size", "SELECT p, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(cx) AS BIGINT) AS cx_sum FROM syms GROUP BY p ORDER BY chars DESC, cx_sum DESC, p LIMIT 12")
def files_size(spark, d):
    x = v.index(spark, d).symbols.groupBy("p").agg(F.sum("n_chars").alias("chars"), F.sum("cx").alias("cx_sum"))
    return x.orderBy(F.col("chars").desc(), F.col("cx_sum").desc(), "p").limit(12)


@query("files_syms", "SELECT p, count(*) AS n, CAST(sum(cx) AS BIGINT) AS cx_sum FROM syms WHERE p = 'lib/en' OR starts_with(p, 'lib/en/') GROUP BY p")
def files_syms(spark, d):
    s = v.index(spark, d).symbols
    return s.where(paths.under(F.col("p"), F.lit("lib/en"))).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("cx_sum"))


@query("files_dupes", "SELECT string_split(p, '/')[-1] AS name, count(DISTINCT p) AS copies FROM (SELECT 'a/' || p_brand || '/' || regexp_extract(p_name, '^[^ ]+') AS p FROM part) GROUP BY 1 HAVING count(DISTINCT p) > 1", base=False)
def files_dupes(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("a/"), "p_brand", F.lit("/"), F.regexp_extract("p_name", "^[^ ]+", 0)).alias("p"))
    return p.groupBy(paths.base_name(F.col("p")).alias("name")).agg(F.count_distinct("p").alias("copies")).where("copies > 1")


@query("churn", "WITH h AS (SELECT event_id, 'lib/en/src' || (user_id % 20) || '.ts' AS path FROM events) SELECT path, count(*) AS churn FROM h WHERE event_id IN (SELECT event_id FROM h ORDER BY event_id DESC LIMIT 800) GROUP BY path", base=False)
def churn(spark, d):
    return tree.churn_of(v.history(spark, d))


@query("changed_files", f"SELECT DISTINCT path FROM (SELECT regexp_extract(url, '{_URL_PATH}', 1) AS path FROM pages) WHERE path <> ''", base=False)
def changed_files(spark, d):
    path = F.regexp_extract("url", _URL_PATH, 1)
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(".\\"), F.replace(path, F.lit("/"), F.lit("\\")))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("./"), path)).otherwise(path)
    return tree.changed_of(table(spark, d, "pages").select(odd.alias("path")))


# --- notes ----------------------------------------------------------------------------------------------

_NOTES = rf""", notes AS (SELECT conv_id * 1000 + turn AS note_id, role AS kind, text AS note, w[1] AS sym, w[2] AS rel, w[3] AS alias, CASE WHEN turn % 3 = 0 THEN 'lib/en/src' || (conv_id % 25) || '.ts' END AS file
  FROM (SELECT *, regexp_extract_all(text, '{v.NAME3}') AS w FROM conversations))"""


@query("notes_bindings", _NOTES + """ SELECT note_id, sym_id, min(priority) AS priority FROM (
    SELECT note_id, sym_id, 1 AS priority FROM notes JOIN syms ON n = notes.sym UNION ALL SELECT note_id, sym_id, 2 FROM notes JOIN syms ON p = notes.file
    UNION ALL SELECT note_id, sym_id, 3 FROM notes JOIN syms ON n = notes.rel UNION ALL SELECT note_id, sym_id, 4 FROM notes JOIN syms ON n = notes.alias) GROUP BY note_id, sym_id""")
def notes_bindings(spark, d):
    from canopyql.plans.verbs import bind_notes

    return bind_notes(v.notes(spark, d), v.index(spark, d).symbols)


@query("notes_drift", _NOTES + " SELECT note_id FROM notes WHERE (sym IS NOT NULL AND sym NOT IN (SELECT n FROM syms)) OR (file IS NOT NULL AND file NOT IN (SELECT p FROM syms))")
def notes_drift(spark, d):
    from canopyql.plans.verbs import drifted_notes

    return drifted_notes(v.notes(spark, d), v.index(spark, d).symbols).select("note_id")


@query("notes_filter", _NOTES + " SELECT note_id FROM notes WHERE kind = 'user' AND contains(lower(note), 'the') AND file LIKE 'lib/en/src1%' UNION ALL SELECT note_id FROM notes WHERE sym = 'The' OR rel = 'The'")
def notes_filter(spark, d):
    from canopyql.plans.verbs import filter_notes

    n = v.notes(spark, d)
    return filter_notes(n, file="lib/en/src1", kind="user", text="THE").unionByName(filter_notes(n, sym="The")).select("note_id")


@query("context_counts", _NOTES + """, d AS (SELECT sym_id, n, p FROM syms WHERE n = (SELECT name FROM seed)), t AS (SELECT DISTINCT src, dst FROM tdec WHERE dst IS NOT NULL)
    SELECT (SELECT count(*) FROM d) AS defs, (SELECT count(*) FROM calls WHERE dst IN (SELECT sym_id FROM d)) AS callers, (SELECT count(*) FROM calls WHERE src IN (SELECT sym_id FROM d)) AS callees,
      (SELECT count(*) FROM t WHERE dst IN (SELECT sym_id FROM d)) AS type_in, (SELECT count(*) FROM t WHERE src IN (SELECT sym_id FROM d)) AS type_out,
      (SELECT count(*) FROM edges WHERE prov = 'doc' AND dst IN (SELECT sym_id FROM d)) AS doc_mentions, (SELECT count(*) FROM notes WHERE sym = (SELECT name FROM seed) OR rel = (SELECT name FROM seed)) AS notes""")
def context_counts(spark, d):
    from canopyql.plans.verbs import context_counts as count

    x = v.index(spark, d)
    return count(x.symbols, x.edges, x.types.where("dst IS NOT NULL").select("src", "dst").distinct(), v.notes(spark, d), x.most_called)


# --- module rules ---------------------------------------------------------------------------------------

_POLICY = """WITH RECURSIVE place AS (SELECT n_nationkey, r_name || '/' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
links AS (SELECT a.place || '/customer' AS from_path, b.place || '/supplier' AS to_path, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN place a ON a.n_nationkey = c_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN place b ON b.n_nationkey = s_nationkey),
roots(root, module, pos) AS (VALUES ('AFRICA', 'africa', 0), ('AMERICA', 'america', 1), ('ASIA', 'asia', 2), ('EUROPE', 'europe', 3), ('ASIA/CHINA', 'china', 4), ('EUROPE/FRANCE', 'france', 5)),
requires(module, required) AS (VALUES ('africa', 'america'), ('america', 'asia'), ('asia', 'europe'), ('europe', 'africa'), ('china', 'asia'), ('asia', 'ghost')),
entries(module, entry) AS (VALUES ('asia', 'ASIA/JAPAN/supplier'), ('asia', 'ASIA/NOWHERE/supplier'), ('europe', 'EUROPE/GERMANY/supplier')),
allp AS (SELECT from_path AS path FROM links UNION SELECT to_path FROM links),
mo AS (SELECT path, (SELECT module FROM roots WHERE path = root OR starts_with(path, root || '/') ORDER BY length(root) DESC, pos LIMIT 1) AS module FROM allp),
x AS (SELECT l.*, a.module AS a, b.module AS b, b.module IN (SELECT module FROM entries) AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.module = b.module AND e.entry = l.to_path) AS deep FROM links l JOIN mo a ON a.path = l.from_path JOIN mo b ON b.path = l.to_path),
deps AS (SELECT a, b, count(*) AS n, arg_min(from_path, ord) AS sample, CAST(sum(deep::INT) AS BIGINT) AS deep, arg_min(from_path, ord) FILTER (deep) AS deep_sample FROM x WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY a, b),
bad AS (SELECT 'module-dependency' AS rule, sample AS file, a || ' -> ' || b || ' (' || n || ')' AS detail, a AS module FROM deps WHERE NOT EXISTS (SELECT 1 FROM requires r WHERE r.module = a AND r.required = b)
  UNION ALL SELECT 'deep-import', deep_sample, a || ' -> ' || b || ' (' || deep || ')', a FROM deps WHERE deep > 0),
fps AS (SELECT *, substr(sha256(rule || chr(0) || file || chr(0) || detail), 1, 16) AS fp FROM bad)"""


def _dependencies(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    links = v.supply_links(spark, d)
    roots, _, entries = v.modules(spark)
    all_paths = links.select(F.col("from_path").alias("path")).union(links.select("to_path")).distinct()
    module_of = stage(governance.modules_of(all_paths, roots), "modules")
    return governance.dependencies(links, module_of, entries), module_of, links


def _violations(spark, d) -> DataFrame:
    from canopyql.plans.verbs import violations

    return violations(_dependencies(spark, d)[0], v.modules(spark)[1])


@query("policy_modules", _POLICY + " SELECT path, module FROM mo", base=False)
def policy_modules(spark, d):
    return _dependencies(spark, d)[1]


@query("policy_deps", _POLICY + " SELECT a, b, n, sample FROM deps", base=False)
def policy_deps(spark, d):
    return _dependencies(spark, d)[0].select("a", "b", "n", "sample")


@query("policy_deep", _POLICY + " SELECT a, b, deep, deep_sample FROM deps WHERE deep > 0", base=False)
def policy_deep(spark, d):
    return _dependencies(spark, d)[0].where("deep > 0").select("a", "b", "deep", "deep_sample")


@query("policy_unmapped", _POLICY + " SELECT count(*) AS unmapped FROM x WHERE a IS NULL OR b IS NULL", base=False)
def policy_unmapped(spark, d):
    _, module_of, links = _dependencies(spark, d)
    return governance.unmapped(links, module_of)


@query("policy_unknown", _POLICY + " SELECT 'unknown-module' AS rule, module, required AS detail FROM requires WHERE required NOT IN (SELECT module FROM roots) UNION ALL SELECT 'missing-entrypoint', module, entry FROM entries WHERE entry NOT IN (SELECT path FROM allp)", base=False)
def policy_unknown(spark, d):
    roots, requires, entries = v.modules(spark)
    return governance.unknown(roots, requires, entries, _dependencies(spark, d)[1])


@query("policy_fp", _POLICY + " SELECT rule, file, detail, module, fp FROM fps", base=False)
def policy_fp(spark, d):
    return _violations(spark, d)


@query("policy_new", _POLICY + ", known AS (SELECT fp FROM fps WHERE rule = 'deep-import') SELECT fp, fp NOT IN (SELECT fp FROM known) AS is_new FROM fps", base=False)
def policy_new(spark, d):
    x = stage(_violations(spark, d), "violations")
    return governance.compare(x, x.where("rule = 'deep-import'").select("fp")).select("fp", F.col("new").alias("is_new"))


@query("policy_cycle", _POLICY + ", r(a, z) AS (SELECT a, b FROM deps UNION SELECT r.a, e.b FROM r JOIN deps e ON e.a = r.z) SELECT DISTINCT a AS module FROM r WHERE a = z", base=False)
def policy_cycle(spark, d):
    return governance.in_cycles(_dependencies(spark, d)[0])


# --- relational shapes on the star schema ---------------------------------------------------------------


@query("ambiguous_parts", "SELECT n AS name, count(*) AS defs, count(DISTINCT p_brand) AS brands FROM (SELECT regexp_extract(p_name, '^[^ ]+') AS n, p_brand FROM part) GROUP BY n HAVING count(*) > 1", base=False)
def ambiguous_parts(spark, d):
    p = table(spark, d, "part").select(F.regexp_extract("p_name", "^[^ ]+", 0).alias("name"), "p_brand")
    return p.groupBy("name").agg(F.count(F.lit(1)).alias("defs"), F.count_distinct("p_brand").alias("brands")).where("defs > 1")


