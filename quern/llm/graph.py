"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, persisted, work_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    Each round is written to the shared folder, so a lost executor costs one
    round at most; a round's tables go when the next has its own. The number of
    rounds grows with the square of the logarithm of the nodes at most. No
    node's neighbours are gathered in one place. Self-loops, repeated edges
    and an empty table are fine.
    """
    spark = edges.sparkSession
    own: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        own.append(work_dir(spark))
        return persisted(df, own[-1])

    def with_least(sym: DataFrame) -> DataFrame:
        """(u, v, m): each directed edge with the least of u and its neighbours.

        The minima are partial sums first; written, so that the join meets
        exchanges on both sides and a node of many neighbours can be split.
        """
        least = written(sym.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        return sym.join(least, sym.u == least.c).select("u", "v", "m")

    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        before = own[:]
        large = with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small)
        discard(spark, *before, *own[len(before) : -1])
        own[:] = own[-1:]
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
