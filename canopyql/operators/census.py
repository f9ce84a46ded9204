"""Census of node types: what an extractor covers, what it leaves out, and whether its registry is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyql.operators.score import KINDS
from canopyql.sources import parsers

STATUSES = ("extracted", "covered", "planned", "skipped")


def classify(census: DataFrame, registry: DataFrame, declares: Column) -> DataFrame:
    """(lang, node, n, status): a registered status, ``unclassified`` for unregistered nodes that declare something, ``stale`` for registered ones not met; others null."""
    x = census.join(registry.select("lang", "node", "status"), ["lang", "node"], "full")
    status = F.when(F.col("n").isNull(), "stale").otherwise(F.coalesce("status", F.when(declares, "unclassified")))
    return x.select("lang", "node", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def self_check(declarations: DataFrame, registry: DataFrame) -> DataFrame:
    """(lang, node, problem): the declaration table (lang, node, kind) and the registry (lang, node, status, reason) must agree."""
    extracted = registry.where("status = 'extracted'").select("lang", "node")
    rows = lambda df, text: df.select("lang", "node", F.lit(text).alias("problem"))
    out = rows(declarations.join(extracted, ["lang", "node"], "left_anti"), "declared, not registered as extracted")
    out = out.union(rows(extracted.join(declarations, ["lang", "node"], "left_anti"), "registered as extracted, not declared"))
    out = out.union(rows(declarations.where(~F.col("kind").isin(*KINDS)), "unknown kind"))
    out = out.union(rows(registry.where(~F.col("status").isin(*STATUSES)), "unknown status"))
    return out.union(rows(registry.where(F.col("status").isin("planned", "skipped") & (F.coalesce("reason", F.lit("")) == "")), "no reason given"))


def counted(nodes: DataFrame) -> DataFrame:
    """(lang, node, n, sample) from (lang, node, path, l): how often a node type is met, and the first place where it is."""
    first = F.min(F.struct("path", "l"))
    return nodes.groupBy("lang", "node").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).select("lang", "node", "n", F.concat_ws(":", "f.path", F.col("f.l").cast("string")).alias("sample"))


def of_files(files: DataFrame, registry: DataFrame, declares: Column) -> DataFrame:
    """The classified census (see ``classify``) of all node types in files (path, lang, text)."""
    met = counted(parsers.table_function(files, "parsed_nodes")).select("lang", "node", "n")
    return classify(met, registry, declares)


def audit(classified: DataFrame, strict: bool = False) -> DataFrame:
    """One row a language and status: how many node types and nodes. strict: ValueError if any type is unclassified."""
    out = classified.where("status IS NOT NULL").groupBy("lang", "status").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("nodes"))
    if strict and (bad := classified.where("status = 'unclassified'").limit(20).collect()):
        raise ValueError("unclassified: " + ", ".join(f"{r['lang']}/{r['node']}" for r in bad))
    return out
