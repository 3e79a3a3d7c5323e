"""Connected components by alternating stars, with every round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm.storage import durable


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of its neighbourhood."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return near.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select("b", "m").unionAll(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) for nodes with an edge. ``edges`` has long columns a, b."""
    now = durable(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = durable(_small(_large(now)).filter(F.col("a") != F.col("b")).distinct(), "edges")
        was, mark = mark, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if was == mark:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
