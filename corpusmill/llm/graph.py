"""Connected components by alternating large-star and small-star steps.

Only aggregates and equi-joins, O(log n) rounds in practice; each round's edges
are a written table, so lineage stays short. Nothing but two numbers a round
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import dropped, written


def _step(edges: DataFrame) -> DataFrame:
    """edges (hi, lo), hi > lo, each once -> the same components, nearer to stars."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    root = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "w")
    small = large.join(root, F.col("hi") == F.col("w")).select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return small.select("e.hi", "e.lo").where("hi > lo").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return row["n"], row["s"] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node, root): every node that has an edge, with its component's least node.

    Loops, repeated edges and no edges are fine; null ends are ignored.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        last, before = now, mark
        now = written(_step(last), "edges")
        mark = _mark(now)
        dropped(last)
        if mark == before:
            break
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
