"""Redundancy and quality filters over reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import dna
from strandloom.operators import bins, kmers
from strandloom.sources.durable import durable

CONTEXT, LEAST_RUN, MOST_COUNT, LEAST_RATIO, LEAST_SIDE = 51, 6, 10, 0.1, 5


def duplicates(reads: DataFrame) -> DataFrame:
    """id, idx, seq, copies, kept: the read of least idx of each canonical sequence stays. Aggregated before the shuffle, so that a sequence of many copies isn't one task's."""
    rows = reads.select("id", "idx", dna.canonical("seq").alias("canon"), (F.col("seq") == dna.canonical("seq")).alias("same"))
    groups = rows.groupBy("canon").agg(F.min("idx").alias("keeper"), F.count("*").alias("copies"))
    seq = F.when(F.col("same"), F.col("canon")).otherwise(dna.revcomp("canon"))  # sent once
    return rows.join(groups, "canon").select("id", "idx", seq.alias("seq"), "copies", (F.col("idx") == F.col("keeper")).alias("kept"))


def unique_reads(reads: DataFrame) -> DataFrame:
    """idx, id, seq: one read a canonical sequence."""
    rows = reads.select("idx", "id", dna.canonical("seq").alias("canon"), (F.col("seq") == dna.canonical("seq")).alias("same"))
    best = rows.groupBy("canon").agg(F.min_by(F.struct("idx", "id", "same"), "idx").alias("r"))
    return best.select("r.idx", "r.id", F.when(F.col("r.same"), F.col("canon")).otherwise(dna.revcomp("canon")).alias("seq"))


def contained(reads: DataFrame, anchor: int = 31, plain: bool = False) -> DataFrame:
    """id of reads that are part of a longer read on either strand, by an anchored equi-join on the first bases. ``plain``: all hold A, C, G and T only and ``anchor`` is at most 31; then only places that a bit table of the probes lets through are made rows."""
    short = reads.filter(F.length("seq") >= anchor).select("id", "seq")
    longest = short.agg(F.max(F.length("seq"))).first()[0] or 0
    parts = short.filter(F.length("seq") < longest)  # the longest reads are part of none
    probes = parts.unionAll(parts.select("id", dna.revcomp("seq").alias("seq"))).select("id", F.col("seq").alias("part"), F.left("seq", F.lit(anchor)).alias("kmer"))
    if plain:
        probes = durable(probes.select("id", "part", bins.code("kmer", F.lit(anchor)).alias("kmer")), "probes")
        hosts = bins.places(short.select("seq"), anchor, probes.select(F.col("kmer").alias("code"))).withColumnRenamed("code", "kmer").distinct()
    else:
        hosts = kmers.explode(short.select("seq").distinct(), anchor, "seq")
    met = probes.join(hosts, "kmer").filter((F.length("seq") > F.length("part")) & (dna.substr("seq", F.col("pos") + 1, F.length("part")) == F.col("part")))
    return met.select("id").distinct()


def _variants(reads: DataFrame) -> DataFrame:
    """Reads with a run of LEAST_RUN to CONTEXT / 2: the covering window and those with the run longer or shorter by up to two."""
    runs = [F.regexp_extract_all("seq", F.lit("(A+|C+|G+|T+)"), F.lit(1))]
    rows = reads.select("id", "seq", runs[0].alias("runs"))
    size = F.array_max(F.transform("runs", F.length))
    rows = rows.withColumn("size", size).filter((F.col("size") >= LEAST_RUN) & (F.col("size") < CONTEXT // 2))
    rows = rows.withColumn("run", F.element_at(F.filter("runs", lambda r: F.length(r) == F.col("size")), 1)).withColumn("at", F.instr(F.col("seq"), F.col("run")))
    left = F.greatest(F.lit(1), F.least(F.col("at") - F.floor((F.lit(CONTEXT) - F.col("size")) / 2).cast("int"), F.length("seq") - CONTEXT + 1))
    rows = rows.withColumn("left", left).filter((F.length("seq") >= CONTEXT) & (F.col("at") - F.col("left") >= LEAST_SIDE) & (F.col("left") + CONTEXT - F.col("at") - F.col("size") >= LEAST_SIDE))
    before = dna.substr("seq", F.col("left"), F.col("at") - F.col("left"))
    after = dna.substr("seq", F.col("at") + F.col("size"), F.col("left") + CONTEXT - F.col("at") - F.col("size"))
    change = F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("change")
    rows = rows.select("id", "size", before.alias("before"), F.left("run", F.lit(1)).alias("base"), after.alias("after"), change)
    return rows.select("id", "size", "change", F.concat("before", F.repeat(F.col("base"), (F.col("size") + F.col("change")).cast("int")), "after").alias("kmer"))


def homopolymer_check(reads: DataFrame) -> DataFrame:
    """id, size, own, best, passed: the run's own length must be the most frequent of its variants, or frequent enough."""
    rows = _variants(reads)
    rows = durable(rows, "variants")
    wanted = rows.select(dna.canonical("kmer").alias("canon")).distinct()
    found = None
    for k in range(CONTEXT - 2, CONTEXT + 3):
        part = kmers.both_strands(reads, k).select("kmer", "rc")
        found = part if found is None else found.unionAll(part)
    found = found.select(F.least("kmer", "rc").alias("canon"), (1 + (F.col("kmer") == F.col("rc")).cast("long")).alias("n"))
    counts = found.join(wanted, "canon", "left_semi").groupBy("canon").agg(F.sum("n").alias("n"))  # few k-mers are asked for
    rows = rows.withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = rows.groupBy("id", "size").agg(F.max(F.when(F.col("change") == 0, F.col("n"))).alias("own"), F.max("n").alias("best"))
    return found.withColumn("passed", (F.col("own") == F.col("best")) | (F.col("own") >= MOST_COUNT) | (F.col("own") >= LEAST_RATIO * F.col("best")))


def degenerate(seq: Column | str, share: float = 0.9) -> Column:
    return dna.max_share(seq) > share


def reasons(reads: DataFrame, k: int = 31, threshold: int = 3, with_kmers: bool = True, with_runs: bool = True) -> DataFrame:
    """id, reason: the first failing test of duplicate, kmer, homopolymer, degenerate; 'pass' for others."""
    rows = duplicates(reads).select("id", "seq", F.col("kept").alias("first"))
    rows = rows.join(contained(reads).withColumn("inside", F.lit(True)), "id", "left")
    tests = [(F.coalesce("inside", F.lit(False)), "substring"), (~F.col("first"), "duplicate")]
    if with_kmers:
        rows = rows.join(kmers.solid_reads(reads, k, threshold).select("id", F.lit(True).alias("solid")), "id", "left")
        tests.append((F.col("solid").isNull(), "kmer"))
    if with_runs:
        rows = rows.join(homopolymer_check(reads).filter(~F.col("passed")).select("id", F.lit(True).alias("run")), "id", "left")
        tests.append((F.coalesce("run", F.lit(False)), "homopolymer"))
    tests.append((F.coalesce(degenerate("seq"), F.lit(False)), "degenerate"))
    found = F.lit("pass")
    for bad, name in reversed(tests):
        found = F.when(bad, name).otherwise(found)
    return rows.select("id", found.alias("reason"))
