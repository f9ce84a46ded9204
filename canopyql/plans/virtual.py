"""A virtual repository over the relational tables, so that every operator can be checked against SQL.

A document is a symbol: its source and language make the path, its first identifier the name, its text
the body. ``SQL`` defines the same relations for the oracle.

A session indexes a directory once, as a repository is indexed once and asked often: ``index`` writes each
relation to the shared folder when it is first asked for. The tables are taken as they were then; ``forget``
makes the next question index again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.functions.text import branches
from canopyql.operators import graph, resolve, score
from canopyql.session import stage, table

KINDS = ("fn", "method", "struct", "var", "impl", "field", "fn", "class", "const", "enum", "trait", "mod")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols with their bodies."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    top = F.when(F.col("source").isin("src3", "src7"), "tests/").when(F.col("source") == "src19", "vendor/").otherwise("lib/")
    ending = F.when(F.col("lang") == "en", ".ts").when(F.col("lang") == "de", ".rs").when(F.col("lang") == "fr", ".py").otherwise(".md")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    kind = F.when(F.col("lang") == "es", "sec").otherwise(F.get(kinds, (F.col("doc_id") % len(KINDS)).cast("int")))
    x = d.select(
        F.col("doc_id").alias("sym_id"), F.concat(top, "lang", F.lit("/"), "source", ending).alias("p"), "lang",
        F.regexp_extract("text", r"[\p{L}_$][\p{L}\p{N}_$]{2,}", 0).alias("n"), kind.alias("t"),
        F.col("doc_id").cast("int").alias("l"), (F.col("doc_id") + F.floor(F.col("n_chars") / 1000)).cast("int").alias("el"),
        F.substring(F.split("text", "\n")[0], 1, 200).alias("sig"), F.col("lang").alias("doc"), F.col("text").alias("body"), branches(F.col("text")).alias("cx"),
        (F.col("quality") == 1).alias("exp"), F.col("n_chars"), F.octet_length("text").alias("bytes"),
    )
    x = x.withColumn("local", F.col("t").isin("var", "const") & (F.col("sym_id") % 3 == 0))
    x = x.withColumn("q", F.when(F.col("sym_id") % 5 == 0, F.concat("lang", F.lit("::"), "n")))
    return x.withColumn("tr", F.when(F.col("t") == "impl", F.col("n")))


def _aliases(with_bodies: DataFrame) -> DataFrame:
    """(path, local, original): a path's last identifiers stand for the names that its symbols have."""
    last = F.regexp_extract("body", r"([\p{L}_$][\p{L}\p{N}_$]{2,})[^\p{L}_$]*$", 1)
    x = with_bodies.select(F.col("p").alias("path"), last.alias("local"), F.col("n").alias("original")).where("local <> ''")
    return x.groupBy("path", "local").agg(F.min("original").alias("original"))


def qualified_references(symbols: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with longer chains, (src, path, name)): a third of the references, written with a path that ends in a language or a file's name."""
    at = F.split("s_p", "/")
    stem = F.regexp_replace(at[2], r"\.[^.]*$", "")
    path = F.when(F.col("src") % 4 == 0, at[1]).when(F.col("src") % 4 == 1, F.concat(F.lit("crate::"), at[1])).when(F.col("src") % 4 == 2, F.concat(F.lit("x::y::"), at[1])).otherwise(F.concat(F.lit("self::super::"), stem))
    refs = references.where((F.col("src") + F.char_length("tk")) % 3 == 0).select("src", path.alias("path"), F.col("tk").alias("name"))
    return symbols.withColumn("q", F.when(F.col("sym_id") % 10 == 0, F.concat(F.lit("app::"), "q")).otherwise(F.col("q"))), refs


class Index:
    """The relations of the virtual repository of one directory, each written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def symbols(self) -> DataFrame:
        return stage(texts(self.spark, self.sf_dir).drop("body"), "symbols")

    @cached_property
    def references(self) -> DataFrame:
        return stage(resolve.references(texts(self.spark, self.sf_dir), F.col("body")), "references")

    @cached_property
    def aliases(self) -> DataFrame:
        return stage(_aliases(texts(self.spark, self.sf_dir)), "aliases")

    @cached_property
    def decided(self) -> DataFrame:
        return stage(resolve.resolve(self.symbols, self.references, self.aliases), "decided")

    @cached_property
    def edges(self) -> DataFrame:
        return stage(resolve.edges(self.decided), "edges")

    @property
    def calls(self) -> DataFrame:
        return resolve.calls(self.edges)

    @cached_property
    def types(self) -> DataFrame:
        return stage(resolve.type_edges(self.symbols, self.references.where(F.col("tk").rlike("^[A-Z]"))), "types")

    @cached_property
    def hubs(self) -> DataFrame:
        return stage(score.hub_scores(self.symbols, self.calls), "hubs")

    @cached_property
    def most_called(self) -> str:
        """The name of the symbol with most callers: the example that the graph queries ask about."""
        top = self.symbols.select("sym_id", "n").join(graph.in_degree(self.calls), F.col("sym_id") == F.col("dst")).orderBy(F.col("n_in").desc(), "sym_id").first()
        return top["n"] if top else ""


_INDEXES: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    return _INDEXES.setdefault((spark.sparkContext.applicationId, sf_dir), Index(spark, sf_dir))


def forget() -> None:
    _INDEXES.clear()


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("lib/en/src"), (F.col("user_id") % 20).cast("string"), F.lit(".ts"))
    return e.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("churn"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as notes: sym, file, rel and aliases from what they say."""
    c = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}_$][\p{L}\p{N}_$]{2,}"), F.lit(0))
    x = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("role").alias("kind"), "text", words.alias("w"), F.col("conv_id"), F.col("turn"))
    file = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("lib/en/src"), (F.col("conv_id") % 25).cast("string"), F.lit(".ts")))
    return x.select("note_id", "kind", F.col("text").alias("note"), F.get("w", F.lit(0)).alias("sym"), F.get("w", F.lit(1)).alias("rel"), F.get("w", F.lit(2)).alias("alias"), file.alias("file"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, text): parts as lines of code, three a part: a comment, a declaration and what belongs to it.

    A brand's parts make files in one of four languages, 2,000 parts at most in a file.
    """
    p = table(spark, sf_dir, "part")
    nn = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    kinds = {"rust": ".rs", "ts": ".ts", "py": ".py", "md": ".md"}
    lang = F.element_at(F.array(*[F.lit(k) for k in kinds]), (nn % 4 + 1).cast("int"))
    words = F.split("p_name", " ")
    x = p.select("p_partkey", "p_size", lang.alias("lang"), nn.alias("nn"), words[0].alias("w1"), words[1].alias("w2"), (F.col("p_partkey") % 4).cast("int").alias("v"))
    x = x.withColumn("name", F.concat_ws("_", "w1", F.col("p_partkey").cast("string")))
    ind = F.when((F.col("lang") == "py") & (F.col("v") == 3), "").otherwise(F.repeat(F.lit("    "), F.pmod("p_size", F.lit(3)).cast("int")))
    said = lambda mark: F.concat(F.col("ind"), F.lit(mark), F.lit(" about "), F.col("w2"))
    form = lambda *parts: F.concat(F.col("ind"), *[F.col("name") if q == "N" else F.lit(q) for q in parts])
    forms = {
        "rust": [form("pub fn ", "N", "(x: u8) -> u8 {"), form("struct ", "N", " {"), form("impl Show for ", "N", " {"), form("const ", "N", ": u8 = 1;")],
        "ts": [form("export async function ", "N", "() {"), form("export class ", "N", " {"), form("export const ", "N", " = (a) => {"), form("let ", "N", ": number = 1;")],
        "py": [form("async def ", "N", "(self):"), form("class ", "N", ":"), form("def ", "N", "():"), form("N", " = 1")],
        "md": [F.concat(F.repeat(F.lit("#"), (F.pmod("p_size", F.lit(3)) + 1).cast("int")), F.lit(" "), F.col("name"))] * 4,
    }
    x = x.withColumn("ind", ind)
    declared, comment = F.lit(None).cast("string"), F.when(F.col("lang") == "md", "").when(F.col("lang") == "py", said("#")).otherwise(said("//"))
    for k, of in forms.items():
        for i, f in enumerate(of):
            declared = F.when((F.col("lang") == k) & (F.col("v") == i), f).otherwise(declared)
    chunk = F.concat_ws("\n", comment, declared, F.concat(F.col("ind"), F.lit("    give back "), F.col("w1")))
    ending = F.element_at(F.create_map(*[F.lit(y) for kv in kinds.items() for y in kv]), F.col("lang"))
    path = F.concat(F.lit("src/b"), F.col("nn").cast("string"), F.lit("/f"), F.floor(F.col("p_partkey") / 2000).cast("string"), ending)
    lines = x.select(path.alias("path"), "lang", F.struct("p_partkey", chunk.alias("chunk")).alias("c"))
    return lines.groupBy("path", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["chunk"]), "\n").alias("text"))


SOURCES_SQL = """WITH x AS (
  SELECT p_partkey, p_size % 3 AS s, p_partkey % 4 AS v, ['rust', 'ts', 'py', 'md'][regexp_extract(p_brand, '[0-9]+')::INT % 4 + 1] AS lang, regexp_extract(p_brand, '[0-9]+') AS nn, string_split(p_name, ' ') AS w FROM part
), d AS (
  SELECT 'src/b' || nn || '/f' || (p_partkey // 2000) || CASE lang WHEN 'rust' THEN '.rs' ELSE '.' || lang END AS path, lang, w[1] || '_' || p_partkey AS n,
         CASE lang WHEN 'md' THEN '' WHEN 'py' THEN '# about ' || w[2] ELSE 'about ' || w[2] END AS doc,
         CASE WHEN lang = 'md' THEN 1 + s WHEN lang = 'py' AND v = 3 THEN 0 ELSE 4 * s END AS indent,
         CASE lang WHEN 'md' THEN 'sec' WHEN 'rust' THEN ['fn', 'struct', 'impl', 'const'][v + 1] WHEN 'ts' THEN ['fn', 'class', 'fn', 'var'][v + 1] ELSE ['fn', 'class', 'fn', 'var'][v + 1] END AS t, p_partkey
  FROM x
), decl AS (SELECT *, CAST(3 * row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 1 AS INT) AS l FROM d)
"""


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, text): parts as code that parses: a class (an impl, in one language) with one method a part, 200 parts a file at most."""
    p = table(spark, sf_dir, "part")
    w = F.split("p_name", " ")
    lang = F.element_at(F.array(F.lit("py"), F.lit("ts"), F.lit("rust")), (F.col("p_partkey") % 3 + 1).cast("int"))
    k = F.col("p_partkey").cast("string")
    name = F.concat(w[0], F.lit("_"), k)
    forms = {
        "py": [F.lit("class C"), k, F.lit(":\n    def "), name, F.lit("(self):\n        return "), w[1], F.lit("\n")],
        "ts": [F.lit("class C"), k, F.lit(" {\n  "), name, F.lit("() {\n    return "), w[1], F.lit(";\n  }\n}")],
        "rust": [F.lit("impl C"), k, F.lit(" {\n    pub fn "), name, F.lit("(&self) -> u8 {\n        "), w[1], F.lit("()\n    }\n}")],
    }
    chunk = F.when(lang == "py", F.concat(*forms["py"])).when(lang == "ts", F.concat(*forms["ts"])).otherwise(F.concat(*forms["rust"]))
    ending = F.when(lang == "py", ".py").when(lang == "ts", ".ts").otherwise(".rs")
    path = F.concat(F.lit("code/d"), F.floor(F.col("p_partkey") / 1000).cast("string"), F.lit("/f"), F.floor(F.col("p_partkey") / 600).cast("string"), ending)
    x = p.select(path.alias("path"), lang.alias("lang"), F.struct("p_partkey", chunk.alias("chunk")).alias("c"))
    return x.groupBy("path", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["chunk"]), "\n").alias("text"))


CODE_SQL = """WITH x AS (
  SELECT p_partkey AS k, ['py', 'ts', 'rust'][p_partkey % 3 + 1] AS lang, string_split(p_name, ' ') AS w FROM part
), c AS (
  SELECT *, 'code/d' || (k // 1000) || '/f' || (k // 600) || CASE lang WHEN 'py' THEN '.py' WHEN 'ts' THEN '.ts' ELSE '.rs' END AS path, w[1] || '_' || k AS name, CASE lang WHEN 'py' THEN 4 ELSE 5 END AS high FROM x
), placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY path ORDER BY k) - 1) * high AS INT) AS before FROM c)
"""


def modules_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, lang, text): suppliers as import and re-export statements, 20 suppliers a file."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("k"), F.floor(F.col("s_suppkey") / 20).alias("m"))
    k = F.col("k")
    ts = F.concat(F.lit("import { alpha"), k, F.lit(" as beta"), k, F.lit(", type Gamma"), k, F.lit(" } from './m';\nexport { Delta"), k, F.lit(" as pub"), k, F.lit(", eps"), k, F.lit(" } from './m';"))
    rust = F.concat(F.lit("use crate::m::{alpha"), k, F.lit(" as beta"), k, F.lit(", gamma"), k, F.lit("};\npub use crate::m::delta"), k, F.lit(";"))
    is_ts = F.col("m") % 2 == 0
    x = s.select(F.concat(F.lit("lib/m"), F.col("m").cast("string"), F.when(is_ts, ".ts").otherwise(".rs")).alias("path"), F.when(is_ts, "ts").otherwise("rust").alias("lang"), F.struct("s_suppkey", F.when(is_ts, ts).otherwise(rust).alias("chunk")).alias("c"))
    return x.groupBy("path", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["chunk"]), "\n").alias("text"))


MODULES_SQL = "WITH m AS (SELECT s_nationkey AS k, (s_suppkey // 20) % 2 = 0 AS ts, 'lib/m' || (s_suppkey // 20) || CASE WHEN (s_suppkey // 20) % 2 = 0 THEN '.ts' ELSE '.rs' END AS path FROM supplier)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(number, path): events as commits of one file each."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.concat(F.lit("lib/en/src"), (F.col("user_id") % 20).cast("string"), F.lit(".ts")).alias("path"))


def supply_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_path, to_path, ord): customers' nations to suppliers' nations, one link a line item."""
    t = lambda n: table(spark, sf_dir, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("place"))
    cust = t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("place", F.lit("/customer")).alias("from_path"))
    supp = t("supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat("place", F.lit("/supplier")).alias("to_path"))
    x = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select("from_path", "to_path", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


def modules(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """roots (root, module, position), requires (module, required), entry points (module, entry)."""
    roots = [("AFRICA", "africa", 0), ("AMERICA", "america", 1), ("ASIA", "asia", 2), ("EUROPE", "europe", 3), ("ASIA/CHINA", "china", 4), ("EUROPE/FRANCE", "france", 5)]
    requires = [("africa", "america"), ("america", "asia"), ("asia", "europe"), ("europe", "africa"), ("china", "asia"), ("asia", "ghost")]
    entries = [("asia", "ASIA/JAPAN/supplier"), ("asia", "ASIA/NOWHERE/supplier"), ("europe", "EUROPE/GERMANY/supplier")]
    return (spark.createDataFrame(roots, "root string, module string, position int"), spark.createDataFrame(requires, "module string, required string"), spark.createDataFrame(entries, "module string, entry string"))


IDENT = r"[\p{L}_$][\p{L}\p{N}_$]*"
NAME3 = r"[\p{L}_$][\p{L}\p{N}_$]{2,}"
_VENDOR, _TEST = paths.VENDOR_PATTERN, paths.TEST_PATTERN
_FAMILY = "CASE WHEN {0} LIKE '%.rs' THEN 'rs' WHEN regexp_matches({0}, '\\.(ts|tsx|js|jsx|mjs)$') THEN 'ts' ELSE 'other' END"
_KIND = "CASE WHEN lang = 'es' THEN 'sec' ELSE [" + ", ".join(f"'{k}'" for k in KINDS) + f"][CAST(d.doc_id % {len(KINDS)} AS INT) + 1] END"
_BRANCH_WORDS = "('if','else','elif','for','while','match','case','switch','catch','except','when')"
SQL = rf"""
syms AS (
  SELECT *, t IN ('var', 'const') AND sym_id % 3 = 0 AS local, CASE WHEN sym_id % 5 = 0 THEN lang || '::' || n END AS q, CASE WHEN t = 'impl' THEN n END AS tr,
         {_FAMILY.format("p")} AS family, regexp_matches(p, '{_VENDOR}') AS vendor, regexp_matches(p, '{_TEST}') AS test
  FROM (
    SELECT d.doc_id AS sym_id,
      CASE WHEN source IN ('src3', 'src7') THEN 'tests/' WHEN source = 'src19' THEN 'vendor/' ELSE 'lib/' END || lang || '/' || source
        || CASE lang WHEN 'en' THEN '.ts' WHEN 'de' THEN '.rs' WHEN 'fr' THEN '.py' ELSE '.md' END AS p,
      lang, regexp_extract(text, '{NAME3}') AS n, {_KIND} AS t, CAST(d.doc_id AS INT) AS l, CAST(d.doc_id + n_chars // 1000 AS INT) AS el,
      substr(string_split(text, chr(10))[1], 1, 200) AS sig, lang AS doc, text AS body, quality = 1 AS exp, n_chars,
      CAST(1 + len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: w IN {_BRANCH_WORDS})) + len(regexp_extract_all(text, '&&|\|\||\?\?|\?[^?]')) AS INT) AS cx
    FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)
  )
),
refs AS (
  SELECT src, tk FROM (SELECT sym_id AS src, n, unnest(list_distinct(regexp_extract_all(body, '{IDENT}'))) AS tk FROM syms) WHERE tk <> n AND length(tk) >= 3
),
aliases AS (
  SELECT p AS path, local_name, min(n) AS original FROM (SELECT p, n, regexp_extract(body, '({NAME3})[^\p{{L}}_$]*$', 1) AS local_name FROM syms) WHERE local_name <> '' GROUP BY p, local_name
),
wanted AS (
  SELECT src, tk, tk AS name, FALSE AS via_alias FROM refs
  UNION ALL
  SELECT r.src, r.tk, a.original, TRUE FROM refs r JOIN syms s ON s.sym_id = r.src JOIN aliases a ON a.path = s.p AND a.local_name = r.tk
  WHERE r.tk NOT IN (SELECT n FROM syms)
),
cand AS (
  SELECT w.src, w.tk, w.via_alias, s.p AS s_p, s.t = 'sec' AS sec, d.sym_id AS dst, d.p AS d_p, d.t AS d_t, d.q AS d_q, d.local AS d_local, s.p = d.p AS same,
         s.p = d.p OR d.exp IS NULL OR (CASE WHEN d.family = 'ts' THEN d.exp ELSE d.exp OR starts_with(s.p, regexp_extract(d.p, '^(.*)/[^/]*$', 1) || '/') END) AS seen
  FROM wanted w JOIN syms d ON d.n = w.name JOIN syms s ON s.sym_id = w.src
  WHERE d.t NOT IN ('field', 'prop', 'variant', 'impl') AND NOT d.vendor AND d.sym_id <> w.src AND (s.family = d.family OR s.family = 'other' OR d.family = 'other')
),
grp AS (
  SELECT src, tk, any_value(sec) AS sec, bool_or(via_alias) AS alias, count(*) AS k, min(dst) AS one, bool_or(same) AS one_same, sum(same::INT) AS sf, min(dst) FILTER (same) AS sf_id,
         bool_or(same AND d_q IS NULL AND d_t NOT IN ('var', 'const')) AS sf_plain, bool_and(d_t IN ('fn', 'method')) AS all_fm, count(DISTINCT d_p) AS np,
         sum(seen::INT) AS vn, min(dst) FILTER (seen) AS v_id, bool_or(seen AND NOT same AND NOT coalesce(d_local, FALSE)) AS v_far,
         bool_and(d_t IN ('var', 'const') AND coalesce(d_local, FALSE)) AS all_loc
  FROM cand GROUP BY src, tk
),
dec AS (
  SELECT *, CASE WHEN k = 1 THEN one WHEN prov IN ('scope-unique', 'lexical') THEN sf_id WHEN prov = 'visibility' THEN v_id END AS dst FROM (
    SELECT *, CASE WHEN k = 1 AND alias THEN 'alias' WHEN k = 1 AND sec THEN 'doc' WHEN k = 1 AND one_same THEN 'same-file' WHEN k = 1 THEN 'name'
      WHEN NOT sec AND all_fm AND np > 1 AND k <= 3 AND sf = 1 THEN 'scope-unique' WHEN NOT sec AND sf = 1 AND sf_plain THEN 'lexical'
      WHEN NOT sec AND vn = 1 AND v_far THEN 'visibility' WHEN all_loc THEN 'local-only' ELSE 'ambiguous' END AS prov FROM grp)
),
edges AS (SELECT DISTINCT src, dst, prov FROM dec WHERE dst IS NOT NULL),
calls AS (SELECT * FROM edges WHERE prov <> 'doc'),
amb_refs AS (SELECT tk AS name, count(*) AS refs FROM dec WHERE prov = 'ambiguous' GROUP BY tk),
tgrp AS (
  SELECT r.src, r.tk, count(*) AS k, min(d.sym_id) AS one, sum((s.p = d.p)::INT) AS sf, min(d.sym_id) FILTER (s.p = d.p) AS sf_id
  FROM refs r JOIN syms d ON d.n = r.tk JOIN syms s ON s.sym_id = r.src
  WHERE regexp_matches(r.tk, '^[A-Z]') AND d.t IN ('struct', 'enum', 'trait', 'type', 'iface', 'class') AND NOT d.vendor AND d.sym_id <> r.src AND (s.family = d.family OR d.family = 'other')
  GROUP BY r.src, r.tk
),
tdec AS (SELECT src, tk, CASE WHEN k = 1 THEN one WHEN sf = 1 THEN sf_id END AS dst FROM tgrp),
churn AS (SELECT 'lib/en/src' || (user_id % 20) || '.ts' AS path, count(*) AS churn FROM events GROUP BY 1),
nin AS (SELECT dst, count(*) AS n_in FROM calls GROUP BY dst),
hub AS (
  SELECT *, win / amb AS norm, win / amb * k * pw * nw * sw * bw AS score FROM (
    SELECT s.sym_id, s.n, s.t, s.p, s.l, i.win, i.callers, i.caller_files, a.amb,
      (CASE WHEN s.t IN ('fn','method','class','iface','struct','enum','trait') THEN 1.0 WHEN s.t IN ('impl','type') THEN 0.9 WHEN s.t = 'macro' THEN 0.85 WHEN s.t = 'const' THEN 0.8
            WHEN s.t = 'mod' THEN 0.7 WHEN s.t = 'var' THEN 0.4 ELSE 0.0 END)::DOUBLE AS k,
      (CASE WHEN s.test THEN 0.5 ELSE 1.0 END)::DOUBLE AS pw, (CASE WHEN s.n IN (GENERIC_LIST) THEN 0.15 ELSE 1.0 END)::DOUBLE AS nw,
      (CASE WHEN s.el - s.l + 1 < 3 THEN 0.7 ELSE 1.0 END)::DOUBLE AS sw, (CASE WHEN i.caller_files >= 3 THEN 1.15 WHEN i.caller_files = 2 THEN 1.0 ELSE 0.85 END)::DOUBLE AS bw
    FROM syms s JOIN (
      SELECT e.dst, CAST(sum((CASE WHEN a.p = b.p THEN 700000 ELSE 1000000 END) // (CASE WHEN a.test THEN 2 ELSE 1 END)) AS BIGINT)::DOUBLE / 1000000::DOUBLE AS win, count(*) AS callers, count(DISTINCT a.p) AS caller_files
      FROM calls e JOIN syms a ON a.sym_id = e.src JOIN syms b ON b.sym_id = e.dst GROUP BY e.dst) i ON i.dst = s.sym_id
    JOIN (SELECT n, count(*) AS amb FROM syms GROUP BY n) a ON a.n = s.n
    WHERE s.t NOT IN ('sec', 'doc') AND NOT coalesce(s.local, FALSE) AND NOT s.vendor)
),
norms AS (SELECT sym_id, CASE WHEN (SELECT max(score) FROM hub) > 0 THEN ln(1 + greatest(score, 0)) / ln(1 + (SELECT max(score) FROM hub)) ELSE 0 END AS hub_norm FROM hub),
seed AS (SELECT n AS name FROM syms JOIN nin ON nin.dst = sym_id ORDER BY n_in DESC, sym_id LIMIT 1)
"""
