"""Connected components of an edge table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the smallest node that it reaches.

    Alternates large-star and small-star until nothing changes; each round is a written table. Hubs meet
    only partial aggregates and one-row-a-node joins.
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        # large-star: each node's larger neighbours move to its smallest neighbour or itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # small-star: each node and its smaller neighbours move to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(small, "a")
        nxt = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        now = stored(nxt.filter("a <> b").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
