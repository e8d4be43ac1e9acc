"""Connected components of an edge table by alternating star contraction.

Every round is two joins over the edges, written once; nothing is gathered on the
driver but one checksum row per round.  A node with a third of all edges is only the
stream side of a join (which adaptive execution splits) and a partial ``min``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs -> ``(node, root)`` for every node but the roots; root is the least node reachable.

    Loops are ignored; an empty table gives an empty one.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct())
    mark = _sum(now)
    while mark[0]:
        now = written(_small_star(_large_star(now)))
        after = _sum(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
