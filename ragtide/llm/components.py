"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragtide.llm.common import materialize

TASK_LINKS = 20_000  # links of one task: a round has several shuffles, and more tasks than that are only files


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): root is the smallest node it reaches.

    Each round keeps at most one row per link and node; the rounds grow with the logarithm of
    the longest path.  Hubs are joined by node, so their links may be split over tasks.
    """
    edges = materialize(_oriented(links.select("a", "b")))
    dealt = _dealt(edges)
    edges, before = dealt(edges), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = dealt(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = dealt(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        large = dealt(_oriented(large))
        low = dealt(large.groupBy("a").agg(F.min("b").alias("m")))
        small = dealt(large.join(low, "a"))
        edges = materialize(dealt(_oriented(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            small.select("a", F.col("m").alias("b"))))))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).union(edges.select("a", "b")).toDF("node", "root")
    return roots.groupBy("node").agg(F.min("root").alias("root"))


def _dealt(links: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What puts the rows of a round into as many tasks as ``links`` fill: a round has no more links than the first."""
    tasks = 1 + links.count() // TASK_LINKS
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lambda df: df.coalesce(tasks) if tasks < most else df


def _oriented(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
