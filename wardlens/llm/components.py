"""Connected components of an edge table by alternating large and small stars, with tables cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import cut

#: Links per task where the table is small; one task's worth needs no shuffle at all.
TASK_LINKS = 200_000


def _dealt(links: DataFrame, n: int) -> DataFrame:
    """A table that fits into one task is read by one, so that its aggregates and joins need no exchange."""
    return links.coalesce(1) if n <= TASK_LINKS else links


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with an edge ``a, b``; each round shortens paths.

    A node's neighbours are aggregated to the smallest, never collected, so a
    node may have any number of links.
    """
    links = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    print_of = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    last = links.agg(*print_of).first()
    while last["n"]:
        now = _dealt(links, last["n"])
        # Large star: the larger neighbours of a node link to the smallest of its neighbours and itself.
        ways = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ways = _dealt(ways, last["n"])
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()
        # Small star: a node and its smaller neighbours link to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        pairs = F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
        links = cut(small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct(), "links")
        after = links.agg(*print_of).first()
        if after == last:
            break
        last = after
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
