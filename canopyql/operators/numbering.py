"""Places of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyql.session import stage

#: Rows of one range of the order; one window over that many is sorted in one task.
RANGE = 200_000


def numbered(rows: DataFrame, order: list[Column], out: str = "number", size: str | None = None, each: int | None = None) -> DataFrame:
    """rows with out: how many rows come before (or the sum of their column size); rows that tie are numbered in any order.

    The rows are dealt by ranges of the order, written, and numbered inside each range; a table of one row a
    range says what lies before it.
    """
    each = each or RANGE
    one = F.col(size) if size else F.lit(1)
    inside = Window.partitionBy("_part").orderBy(*order)
    parts = -(-rows.count() // each)
    if parts <= 1:
        return rows.withColumn("_part", F.lit(0)).withColumn(out, (F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - one).cast("long")).drop("_part")
    dealt = stage(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum(one).alias("_sum"))
    # as many rows as ranges
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    own = F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - one
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")
