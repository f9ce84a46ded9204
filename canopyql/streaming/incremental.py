"""Beyond batch indexing: new files re-indexed as they arrive (Structured Streaming, file source)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyql.functions import paths
from canopyql.sources.tree import decoded, relative_to


def stream_tree(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream (path, lang, bytes, text) of files below root; contents are read once a file appears."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    x = raw.where(F.col("length") <= paths.MAX_BYTES).withColumn("path", relative_to(root)).withColumn("lang", paths.language(F.col("path")))
    x = x.where(F.col("lang").isNotNull() & ~paths.skipped(F.col("path")))
    return x.select("path", "lang", F.col("length").alias("bytes"), *decoded(F.col("content")))


def reindex(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Starts the stream; each batch of files goes to ``each``, which appends its symbols and resolves again."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
