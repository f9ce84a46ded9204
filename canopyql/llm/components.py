"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyql.session import stage

#: Links of a node from which it counts as a hub; hubs are few, as all links together bound their number.
HUB = 10_000
#: Rows (two numbers each) up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def _looked_up(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with the column on replaced by the top that table (node, top, n) has for it; every key is in the table.

    A long table is joined by shuffling, but for its hubs (n rows of rows each), whose short table is broadcast.
    """
    others = [c for c in rows.columns if c != on]
    tops = table.select(F.col("node").alias(on), "top", "n")
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(tops), on).select(*others, F.col("top").alias(on))
    hot = stage(tops.where(F.col("n") >= HUB).drop("n"), "hubs")
    met = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, on, "left")
    rest = met.where("top IS NULL").drop("top").join(tops.where(F.col("n") < HUB), on)
    return met.where("top IS NOT NULL").select(*others, F.col("top").alias(on)).unionByName(rest.select(*others, F.col("top").alias(on)))


def _followed(rows: DataFrame, label: str, of: DataFrame) -> DataFrame:
    """rows with the column label replaced by what of (label, above) has for it, where it has any; of is broadcast if it is short."""
    others = [c for c in rows.columns if c != label]
    above = of.withColumnRenamed("label", label)
    met = rows.join(F.broadcast(above) if of.count() <= BROADCAST_ROWS else above, label, "left")
    return met.select(*others, F.coalesce("above", label).alias(label))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node of its component.

    Each round every node takes its least neighbour, if that is less than itself, as its top; tops are followed
    (top of the top) until each is its own. The nodes below a top then become one, and only links between different tops
    go on to the next round: at most half of the nodes that have links are left, and links inside a component are read no more.
    The tables of a round are written to the shared folder. Links to a hub get its top from a short table of hubs, and
    tops are followed through those alone that are not yet their own, so no key gathers a component.
    """
    open_links = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while labels is None or not open_links.isEmpty():
        near = open_links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("top"), F.count(F.lit(1)).alias("n"))
        tops = stage(near, "tops")
        while True:
            moved = tops.where("top <> node").select(F.col("node").alias("label"), F.col("top").alias("above"))
            used = stage(moved.join(tops.select(F.col("top").alias("label")).distinct(), "label"), "moved")
            if used.isEmpty():
                break
            tops = stage(_followed(tops, "top", used).select("node", "top", "n"), "tops")
        labels = tops.select("node", F.col("top").alias("label")) if labels is None else stage(_followed(labels, "label", moved).select("node", "label"), "labels")
        joined = _looked_up(_looked_up(open_links, tops, "a"), tops, "b")
        open_links = stage(joined.select("a", "b").where("a <> b").distinct(), "links")
    return labels
