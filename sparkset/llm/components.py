"""Connected components by alternating large and small stars; every round's edges are a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkset.llm.shared import keep, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reached) of every node with an edge to a smaller one in its component; a table made by ``keep``.

    ``edges`` has two columns of one type, in any order and direction, with repeats or loops; null ends don't count. Nodes with many edges are met
    by aggregates of partial sums and by joins of two tables, which adaptive execution splits where one key is frequent. Each round's tables go
    once the next one is written.
    """
    a, b = edges.columns[:2]
    down = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct())
    seen = None
    while True:
        # large star: each node's larger neighbours go to the smallest in its neighbourhood
        both = down.unionAll(down.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        large = keep(down.select(F.col("root").alias("node"), F.col("node").alias("w")).join(least, "node").select(F.col("w").alias("node"), F.col("m").alias("root")).distinct())
        release(down)
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        joined = large.join(least, "node").select(F.explode(F.array(F.struct("node", "m"), F.struct(F.col("root").alias("node"), "m"))).alias("e"))
        down = keep(joined.select("e.node", F.col("e.m").alias("root")).where("node != root").distinct())
        release(large)
        now = down.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == seen:
            return down
        seen = now
