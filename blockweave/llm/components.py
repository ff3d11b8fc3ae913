"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockweave.llm.common import cut


#: Edges of a task: a table of fewer goes through fewer tasks than there are shuffle partitions.
TASK = 250


def _shape(now: DataFrame) -> tuple[int, int]:
    """(edges, nodes that hang under two others or under one and have some themselves)."""
    ends = now.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
        now.select(F.col("v").alias("n"), F.lit(None).cast("long").alias("x"))
    )
    nodes = ends.groupBy("n").agg(F.count("*").alias("all"), F.count("x").alias("up"), F.min("x").alias("low"), F.max("x").alias("high"))
    loose = (F.col("up") > 0) & ((F.col("all") > F.col("up")) | (F.col("low") != F.col("high")))
    r = nodes.agg(F.sum("up").alias("edges"), F.count_if(loose).alias("loose")).first()
    return r.edges or 0, r.loose


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, label: the least node of its component, for each node of an edge between unlike nodes.

    Each round hangs every node's larger neighbours, then its smaller ones, under its least neighbour; rounds go on until all
    components are stars, in a number of the order of the logarithm of the nodes. Nothing but two numbers a round comes to the
    driver. No edges give no rows; nulls and self-loops are left out.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while (shape := _shape(now))[1]:
        tasks = 1 + shape[0] // TASK
        now = now.coalesce(tasks)
        both = now.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(
            now.select(F.col("v").alias("n"), F.col("u").alias("x"))
        )
        least = both.groupBy(F.col("n").alias("n2")).agg(F.min("x").alias("m")).withColumn("m", F.least("n2", "m"))
        least = cut(least.coalesce(tasks))  # so that both sides of the join are dealt anew and a hub's edges can be split
        large = both.where(F.col("x") > F.col("n")).join(least, F.col("n") == F.col("n2")).select(
            F.col("x").alias("u"), F.col("m").alias("v")
        ).distinct()
        low = large.groupBy(F.col("u").alias("u2")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("u2")).where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")
        )
        now = cut(small.unionByName(low.select(F.col("u2").alias("u"), F.col("m").alias("v"))).distinct().coalesce(tasks))
    under = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return under.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
