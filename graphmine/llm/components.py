"""Connected components by alternating large-star and small-star steps, in DataFrame functions only.

Each step joins every node's neighbours with the least label seen there; labels shrink until the links form stars.
The number of rounds grows with the logarithm of the longest path, and no step gathers a node's neighbours in one
place: minima are aggregated before the shuffle, and joins on a hub can be split by the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmine.llm import runtime


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to the least of the node and its neighbours."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them (``a > b`` in all links)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    near = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return near.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of every node with a link to another.

    ``links`` has integer columns ``a`` and ``b``; nulls, loops and repeated links are ignored; an empty table
    gives an empty one.  Rounds are written to the shared folder, so a lost executor repeats one round at most.
    """
    now = runtime.materialize(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            break
        mark = seen
        last, now = now, runtime.materialize(_small_star(_large_star(now)), "links")
        runtime.drop_tables([last])
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
