"""URL filter: rules by host and path, and for all other pages trust and distrust that flow along links between hosts.

A rule is a host and the beginning of a path: it fits a page of that host or of one below it whose path begins so;
of the rules that fit, the one with the longest text wins. Every page is cut into the pairs of a host above it and
a path beginning that some rule might have, which meet the rules in one equi-join.

Pages without a rule are judged by their host. Hosts are seeds of trust by the number of their pages that a rule
allows, of distrust by the number that a rule blocks. Trust flows along the links from a host's pages to other
hosts, distrust against them (who links to a blocked host is not to be trusted): two personalised PageRanks,
in whole numbers, so that reruns and other engines agree. A host passes on 17/20 of what it holds in equal shares,
keeps it where no link leaves it, and gets back 3/20 of its seed. A host whose distrust is above ``ratio`` times its
trust is blocked.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; links
come from ``href`` of ``a`` tags with a host of their own (relative ones stay on the host); a null page has none;
of rules with the same host and path, block wins; rows that repeat a page count each; an empty table gives an
empty result; further columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyql.session import release, scratch, table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"<[aA][\x09-\x0D\x20](?:[^<>]*[\x09-\x0D\x20])?[hH][rR][eE][fF][\x09-\x0D\x20]*=[\x09-\x0D\x20]*[\"']?[\x09-\x0D\x20]*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\"'<>\x09-\x0D\x20]+)"
#: What a seed page gives, in whole units; passed on is 17/20 of what is held.
UNIT = 1_000_000
#: Rows (two strings and two numbers) up to which rules or judged hosts are broadcast.
BROADCAST_ROWS = 200_000
#: Links of a host, or rows of a key, beyond which they are dealt over several keys.
HUB = 10_000
#: Rounds after which the shares are written.
EVERY = 5


def lowered(host: Column) -> Column:
    return F.translate(host, UPPER, LOWER)


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    at = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lowered(at(1)), at(2)


def _beside(rows: DataFrame, few: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """rows joined with a written table of one row a key, which is broadcast if it is short.

    A longer one is shuffled, whatever the size of its files; keys of more than HUB rows are dealt over several.
    """
    same = F.col(left) == F.col(right)
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), same, how).drop(right)
    path = scratch(rows.sparkSession, "often")
    rows.groupBy(F.col(left).alias("_often")).agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("_parts")).where("_parts > 1").write.parquet(path)
    # one row for every HUB rows at most
    often, parts = F.broadcast(rows.sparkSession.read.parquet(path)), F.coalesce("_parts", F.lit(1))
    salted = rows.join(often, F.col(left) == F.col("_often"), "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_often", "_parts")
    many = few.join(often, F.col(right) == F.col("_often"), "left").withColumn("_at", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_often", "_parts")
    return salted.join(many.hint("merge"), same & (F.col("_salt") == F.col("_at")), how).drop("_salt", "_at", right)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses (host, path) once each, with rule and verdict, of those that a rule fits."""
    known = rules.groupBy(lowered(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("verdict"))
    lengths = [r[0] for r in known.select(F.char_length("r_path")).distinct().collect()]
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    long_enough = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    x = addresses.where("host <> ''").distinct().withColumn("_n", F.explode(long_enough)).withColumn("_above", F.explode(above))
    x = x.withColumn("_key", F.concat("_above", F.lit("\n"), F.substring(F.col("path"), F.lit(1), F.col("_n")))).drop("_above", "_n")
    known = known.select(F.concat("r_host", F.lit("\n"), "r_path").alias("r_key"), F.concat("r_host", "r_path").alias("rule"), F.char_length("r_host").alias("r_n"), "verdict")
    hit = _beside(x, known, "_key", "r_key", "inner")
    best = F.max(F.struct(F.char_length("rule").alias("n"), "r_n", "rule", "verdict")).alias("best")
    return hit.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b): once each, the pairs of different hosts of which a page of the first links to the second; from (host, html)."""
    to = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1)))
    return pages.where("host <> ''").select(F.col("host").alias("a"), to.alias("b")).select("a", lowered(F.col("b")).alias("b")).where("a <> b").distinct()


def flow(links: DataFrame, seeds: DataFrame, rounds: int = 20) -> DataFrame:
    """(host, trust, distrust) of every host of links (a, b) and seeds (host, allowed, blocked), in units.

    Trust and distrust go in one pass: each link stands twice, once for each kind, in the direction that the kind
    flows. Links of a hub are dealt over several keys, so no key holds more than about HUB of them.
    """
    spark, made = links.sparkSession, set()

    def kept(df: DataFrame, what: str) -> DataFrame:
        path = scratch(spark, what)
        df.write.parquet(path)
        made.add(path)
        return spark.read.schema(df.schema).parquet(path)

    links = kept(links, "links")
    both = links.select(F.lit(0).alias("kind"), "a", "b").unionAll(links.select(F.lit(1).alias("kind"), F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.select("kind", F.col("a").alias("host"), F.lit(1).alias("link")).unionAll(both.select("kind", F.col("b").alias("host"), F.lit(0).alias("link")))
    own = seeds.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(c) * UNIT).alias("seed")) for k, c in enumerate(("allowed", "blocked"))])).alias("s")).select("host", "s.kind", "s.seed")
    nodes = ends.groupBy("kind", "host").agg(F.sum("link").alias("links")).join(own, ["kind", "host"], "left").select("kind", "host", "links", F.coalesce("seed", F.lit(0).cast("long")).alias("seed"))
    held = nodes = kept(nodes, "hosts")
    held = held.withColumn("mass", F.col("seed"))
    # hosts without a link keep their seed, so rounds are for the others
    if not nodes.isEmpty():
        parts = F.ceil(F.col("links") / HUB).cast("int")
        hubs = nodes.where(F.col("links") > HUB).select("kind", F.col("host").alias("a"), parts.alias("parts"))
        salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int")
        dealt = kept(both.join(hubs, ["kind", "a"], "left").select("kind", "a", "b", salt.alias("salt")), "links")
        none = F.lit(None).cast("long")
        for r in range(rounds):
            held = held.withColumn("passed", F.expr("mass div 20 * 17"))
            share = held.where("links > 0 AND mass > 0").select("kind", F.col("host").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), F.expr("passed div links").alias("share"))
            got = dealt.join(share, ["kind", "a", "salt"]).select("kind", F.col("b").alias("host"), F.col("share").alias("got"), none.alias("seed"), none.alias("links"))
            back = held.select("kind", "host", (F.when(F.col("links") == 0, F.col("passed")).otherwise(0) + F.expr("seed div 20 * 3")).alias("got"), "seed", "links")
            held = back.unionByName(got).groupBy("kind", "host").agg(F.sum("got").alias("mass"), F.max("seed").alias("seed"), F.max("links").alias("links"))
            if r % EVERY == EVERY - 1 and r < rounds - 1:
                held = kept(held, "mass")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("mass")))
    flown = held.groupBy("host").agg(of(0).alias("t"), of(1).alias("d"))
    path = scratch(spark, "judged")
    total = lambda got, seed: F.coalesce(got, F.col(seed) * UNIT, F.lit(0).cast("long"))
    seeds.join(flown, "host", "full").select("host", total("t", "allowed").alias("trust"), total("d", "blocked").alias("distrust")).write.parquet(path)
    release(spark, made)
    return spark.read.parquet(path)


def verdicts(pages: DataFrame, rules: DataFrame, ratio: int = 1, rounds: int = 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page (page_id, url, html)."""
    spark = pages.sparkSession
    host, path = parsed(F.col("url"))
    at = pages.select("page_id", host.alias("host"), path.alias("path"))
    ways = [scratch(spark, w) for w in ("ruled", "counted")]
    ruled(at.select("host", "path"), rules).write.parquet(ways[0])
    fits = spark.read.parquet(ways[0])
    keyed = fits.select(F.concat("host", F.lit("\n"), "path").alias("f_key"), "rule", "verdict")
    met = _beside(at.withColumn("_key", F.concat("host", F.lit("\n"), "path")), keyed, "_key", "f_key", "left").drop("_key")
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    seeds = met.where("host <> ''").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    seeds.write.parquet(ways[1])
    hosts = flow(host_links(pages.select(host.alias("host"), "html")), spark.read.parquet(ways[1]), rounds)
    judged = _beside(met, hosts.withColumnRenamed("host", "j_host"), "host", "j_host", "left")
    own = F.when(F.col("distrust") > F.col("trust") * ratio, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("trust", "distrust")])


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_table(spark, RULES))


def _sql(rounds: int = 20) -> str:
    link = LINK.replace("'", "''")
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    steps = []
    for r in range(rounds):
        steps.append(f"""r{r + 1} AS MATERIALIZED (SELECT host, kind, CAST(sum(got) AS BIGINT) AS mass FROM (
    SELECT host, kind, seed // 20 * 3 + CASE WHEN links = 0 THEN mass // 20 * 17 ELSE 0 END AS got FROM nodes JOIN r{r} USING (host, kind)
    UNION ALL SELECT b, kind, mass // 20 * 17 // links FROM nodes JOIN r{r} USING (host, kind) JOIN ways w ON w.a = host AND w.k = kind) GROUP BY host, kind)""")
    return f"""WITH p AS MATERIALIZED (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(r_host, r_path, verdict) AS (VALUES {values}
), f AS MATERIALIZED (
  SELECT host, path, max({{'n': length(r_host || r_path), 'h': length(r_host), 'rule': r_host || r_path, 'verdict': verdict}}) AS best
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path
), m AS MATERIALIZED (SELECT page_id, host, path, best.rule AS rule, best.verdict AS verdict FROM p LEFT JOIN f USING (host, path)
), l AS MATERIALIZED (
  SELECT DISTINCT a, b FROM (SELECT host AS a, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS b FROM p WHERE host <> '') WHERE a <> b
), ways AS MATERIALIZED (SELECT 0 AS k, a, b FROM l UNION ALL SELECT 1, b, a FROM l
), seeds AS (
  SELECT 0 AS kind, host, {UNIT} * count(*) FILTER (WHERE verdict = 'allow') AS seed FROM m WHERE host <> '' GROUP BY host
  UNION ALL SELECT 1, host, {UNIT} * count(*) FILTER (WHERE verdict = 'block') FROM m WHERE host <> '' GROUP BY host
  UNION ALL SELECT k, a, 0 FROM ways UNION ALL SELECT k, b, 0 FROM ways
), nodes AS MATERIALIZED (
  SELECT kind, host, sum(seed)::BIGINT AS seed, (SELECT count(*) FROM ways w WHERE w.k = s.kind AND w.a = s.host) AS links FROM seeds s GROUP BY kind, host
), r0 AS MATERIALIZED (SELECT host, kind, seed AS mass FROM nodes
), {', '.join(steps)}, j AS (
  SELECT host, CAST(sum(mass) FILTER (WHERE kind = 0) AS BIGINT) AS trust, CAST(sum(mass) FILTER (WHERE kind = 1) AS BIGINT) AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM m LEFT JOIN j USING (host)"""


OP13_SQL = _sql()
