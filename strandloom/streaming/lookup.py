"""Streams of query sequences against static k-mer and read tables, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions import dna


def kmer_lookup(queries: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """q, pos, kmer, same, revc of each k-mer of each query; a stream of queries joins the static table of counts without state. Queries below k have no rows."""
    n = F.length("q")
    rows = queries.filter(n >= k).select("q", F.posexplode(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: dna.substr("q", i, k))).alias("pos", "kmer"))
    rows = rows.withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left")
    first = F.col("kmer") == F.col("canon")
    value = lambda a, b: F.coalesce(F.when(first, F.col(a)).otherwise(F.col(b)), F.lit(0))
    return rows.select("q", "pos", "kmer", value("fw", "rv").alias("same"), value("rv", "fw").alias("revc"))


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total by tumbling windows of event time; on a stream rows later than ``late`` are dropped. An addition to the sequence operators."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
