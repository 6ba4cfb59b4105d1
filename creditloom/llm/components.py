"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouping and a join; edges and minima are written to the shared folder between steps, so a
lost executor re-reads files, nothing is gathered on the driver and a node with very many edges is combined
before the shuffle and split in the join.  The number of rounds grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creditloom.llm.scratch import materialize


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _minima(edges: DataFrame, name: str) -> DataFrame:
    return materialize(edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).drop("least"), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_minima(both, "large"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down, "small")
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is named by its least node.

    ``edges`` has columns u and v of one ordered type; loops, repeats and nulls don't matter.  An empty table
    gives no rows.
    """
    edges = materialize(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialize(_small_star(materialize(_large_star(edges), "edges")), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
