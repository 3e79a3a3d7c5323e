"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.sources.durable import discard, durable


def _neighbourhood_least(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _hang(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.selectExpr("count(*)", "bit_xor(xxhash64(a, b))").first())


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root of all nodes with an edge to another node. ``edges``: a, b (bigint). Rounds run while the plan is built; each is a written table, as the one before is deleted."""
    now = durable(edges.select("a", "b").filter("a <> b").distinct(), "stars")
    mark = _mark(now)
    for _ in range(rounds):
        new = durable(_hang(_neighbourhood_least(now)), "stars", mark[0])  # a round never makes more edges
        discard(now)
        now, before, mark = new, mark, _mark(new)
        if before == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")
