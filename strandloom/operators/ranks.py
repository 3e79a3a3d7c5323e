"""Lexicographic ranks of sequences and intervals of ranks that share a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.sources.durable import durable

#: Bits of a row's number within its partition in Spark's increasing ids.
LOCAL = 33


def ranked(reads: DataFrame) -> DataFrame:
    """idx, seq, rank (from 0) by sequence, then index. Rows are dealt by ranges and numbered within them; a range's first rank is the sum of the sizes before it, so the only ordered window has a row a range."""
    rows = reads.select("idx", "seq").repartitionByRange("seq", "idx").sortWithinPartitions("seq", "idx")
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()), "ranges")
    rows = rows.select("idx", "seq", F.shiftright("at", LOCAL).alias("range"), F.col("at").bitwiseAND(F.lit((1 << LOCAL) - 1)).alias("local"))
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("range", before.alias("before"))), "range").select("idx", "seq", (F.col("before") + F.col("local")).alias("rank"))


def prefix_intervals(ranks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """q, first, last, n: ranks of the sequences that begin with each prefix (q), an equi-join on prefixes of the asked lengths."""
    asked = prefixes.select("q").distinct()
    sizes = asked.select(F.length("q").alias("size")).distinct()
    heads = ranks.join(F.broadcast(sizes), F.length("seq") >= F.col("size")).select("rank", F.left("seq", F.col("size")).alias("q"))
    found = heads.groupBy("q").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n"))
    return found.join(asked, "q", "left_semi")


def extracted(ranks: DataFrame, wanted: DataFrame, start: int, size: int) -> DataFrame:
    """rank, piece: a substring of the sequences of the wanted ranks (rank)."""
    return ranks.join(wanted.select("rank"), "rank").select("rank", F.substring("seq", start + 1, size).alias("piece"))
