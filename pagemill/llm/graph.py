"""Connected components of a graph as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.session import saved

#: Edges of a task that sends edges to a shuffle; there are at least as many such tasks as cores.
EDGES = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it is connected to.

    Large-star and small-star rounds: every node points its greater neighbours, then all its smaller ones, to the least of
    them. The rounds end when every node points to one node at most and those pointed to point nowhere; they are few, as
    paths shrink by half. Loops and nulls are dropped.

    A round has five shuffles. The least neighbours are found with partial aggregation and joined back, so that a node of
    very many neighbours is left to the join's skew handling.
    """
    a, b = F.col(a).alias("a"), F.col(b).alias("b")
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while True:
        now = now.coalesce(max(cores, -(-now.count() // EDGES)))
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
        degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if degrees.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        both = now.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").select(F.when(F.col("v") > F.col("u"), F.col("v")).when(F.col("v") == F.col("m"), F.col("u")).alias("u"), F.col("m").alias("v")).where("u is not null")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = saved(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
