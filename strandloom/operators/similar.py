"""Reads alike by k-mer seeds and banded alignment.

A read meets those that share a k-mer with it on either strand; of the reads of
a k-mer and strand only the first ``most`` by index are met, which bounds what a
repeat brings. A pair is aligned once, along the diagonal of its first shared
k-mer: where both reads lie on it, edit distance within a band. Gaps, mismatches
and the band are our own rule: a pair counts if the differences are at most
1 - ``identity`` of the overlap, and the band is as wide as that allows, so no
pair that counts is misjudged by it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions import dna
from strandloom.operators import kmers


def seeds(reads: DataFrame, k: int, least: int, most: int) -> DataFrame:
    """Pairs (a, b, strand) of reads (idx, seq) that share a k-mer of count ``least`` or more, with the places pa and pb of the first: b is seen on its other strand if strand is 1."""
    own = kmers.explode(reads, k, "idx")
    turned = reads.select("idx", dna.revcomp("seq").alias("seq"))
    hits = own.withColumn("strand", F.lit(0)).unionByName(kmers.explode(turned, k, "idx").withColumn("strand", F.lit(1)))
    first = hits.groupBy("kmer", "strand", F.col("idx").alias("b")).agg(F.min("pos").alias("pb"))
    place = F.row_number().over(Window.partitionBy("kmer", "strand").orderBy("b"))
    first = first.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    counts = kmers.strand_counts(reads, k).filter(F.col("fw") + F.col("rv") >= least).select("canon")
    asks = own.withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left_semi").select("kmer", F.col("idx").alias("a"), F.col("pos").alias("pa"))
    met = asks.join(first, "kmer").filter(F.col("a") != F.col("b"))
    best = met.groupBy("a", "b", "strand").agg(F.min(F.struct("pa", "pb")).alias("p"))
    return best.select("a", "b", "strand", "p.pa", "p.pb")


def banded(one: list[str], two: list[str], band: int) -> np.ndarray:
    """Edit distances of pairs of equally long strings, all pairs at once, right up to ``band`` and over it beyond."""
    size = np.array(list(map(len, one)))
    n, most = len(one), int(size.max(initial=0))
    letters = lambda rows, fill: np.array([list(s.encode()) + [fill] * (most - len(s)) for s in rows], np.int16).reshape(n, most)
    x, y = letters(one, 1), np.pad(letters(two, 2), ((0, 0), (band, band + 1)), constant_values=3)
    width = 2 * band + 1
    offsets = np.arange(width) - band  # column of y less row of x
    far = 4 * (band + 1)
    now = np.broadcast_to(np.where(offsets >= 0, offsets, far), (n, width)).copy()
    out = np.where(size == 0, 0, far)
    for i in range(most):
        change = (y[:, i : i + width] != x[:, i : i + 1]).astype(np.int64)
        change[:, offsets + i < 0] = far
        best = np.minimum(now + change, np.pad(now[:, 1:], ((0, 0), (0, 1)), constant_values=far) + 1)
        if 0 <= band - i - 1:
            best[:, band - i - 1] = np.minimum(best[:, band - i - 1], i + 1)  # x's beginning against nothing
        now = np.minimum.accumulate(best - np.arange(width), axis=1) + np.arange(width)
        out = np.where(size == i + 1, now[:, band], out)
    return out


def _aligned(identity: float):
    def run(frames):
        for frame in frames:
            shift = frame["pa"] - frame["pb"]
            begin_a, begin_b = shift.clip(lower=0), (-shift).clip(lower=0)
            size = np.minimum(frame["sa"].str.len() - begin_a, frame["sb"].str.len() - begin_b) if len(frame) else begin_a
            one = [s[i : i + n] for s, i, n in zip(frame["sa"], begin_a, size)]
            two = [s[i : i + n] for s, i, n in zip(frame["sb"], begin_b, size)]
            band = max(1, math.floor((1 - identity) * max(map(len, one), default=0) + 1e-9))
            yield frame.drop(columns=["sa", "sb", "pa", "pb"]).assign(shift=shift.astype("int32"), size=size.astype("int32"), differences=banded(one, two, band).astype("int32") if len(frame) else size.astype("int32"))

    return run


def similar(reads: DataFrame, k: int = 31, least: int = 2, most: int = 50, identity: float = 0.95) -> DataFrame:
    """a, b, strand, shift, size, differences: reads that overlap by half of a at least, and by ``identity`` of the overlap; b begins ``shift`` bases after a. ``most`` hits a read, the best first."""
    pairs = seeds(reads, k, least, most)
    first, second = reads.select(F.col("idx").alias("a"), F.col("seq").alias("sa")), reads.select(F.col("idx").alias("b"), F.col("seq").alias("sb"))
    rows = pairs.join(first, "a").join(second, "b").withColumn("sb", F.when(F.col("strand") == 1, dna.revcomp("sb")).otherwise(F.col("sb")))
    span = F.least(F.length("sa") - F.greatest(F.col("pa") - F.col("pb"), F.lit(0)), F.length("sb") - F.greatest(F.col("pb") - F.col("pa"), F.lit(0)))
    rows = rows.filter(span * 2 >= F.length("sa")).select("a", "b", "strand", "pa", "pb", "sa", "sb")
    found = rows.mapInPandas(_aligned(identity), "a bigint, b bigint, strand int, shift int, size int, differences int")
    good = found.filter(F.col("differences") <= F.floor((1 - identity) * F.col("size") + 1e-9))
    place = F.row_number().over(Window.partitionBy("a").orderBy("differences", F.desc("size"), "b", "strand"))
    return good.withColumn("place", place).filter(F.col("place") <= most).drop("place")
