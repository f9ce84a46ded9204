"""The corpus pipeline: quality rules, toxicity, near-duplicates, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns to the
shared folder and reads it as the next stage's docs. All stages but the last return the columns of
documents, and each works on all rows that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyql.llm import bpe, dedup, mixing, quality, toxicity
from canopyql.session import held, release, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and lie near the centre of their language and source."""
    return quality.quality_filter(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity limit; the models learn from the labelled rows of the documents table."""
    trained = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.toxicity_filter(docs, trained)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id."""
    return dedup.deduplicate(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every emitted document, with the digests of the ids and of the text that they decode to."""
    out = bpe.with_digests(bpe.encode_decode(docs.select("doc_id", "lang", "source", "text")))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_dedup", near_duplicates),
    ("mixing", source_mixture),
    ("bpe", tokens),
]

#: The estimates of the first stages are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), set()
    for name, step in STAGES[:-1]:
        before = held(spark)
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        # what the step has written on its way, and what the stage before it returned, is read no more
        made = held(spark) - before
        kept = {p for p in made if f"/pipeline-{name}-" in p}
        release(spark, made - kept | last)
        last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
