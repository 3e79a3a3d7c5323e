"""K-mer correction, correction metrics and consensus over pileups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions import dna
from strandloom.operators import kmers
from strandloom.operators.similar import similar
from strandloom.sources.durable import durable


def weak_spots(reads: DataFrame, counts: DataFrame, k: int, least: int) -> DataFrame:
    """id, at, base_at: the leftmost k-mer of a read whose both-strand count is below ``least`` beside one that isn't, and the base (from 0) that sets them apart."""
    rows = kmers.explode(reads, k, "id").withColumn("canon", dna.canonical("kmer")).join(counts, "canon").select("id", "pos", (F.col("fw") + F.col("rv") >= least).alias("strong"))
    order = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("before", F.lag("strong").over(order)).withColumn("after", F.lead("strong").over(order))
    enters = ~F.col("strong") & F.coalesce("before", F.lit(False))
    leaves = ~F.col("strong") & F.coalesce("after", F.lit(False)) & ~enters
    rows = rows.filter(enters | leaves).select("id", "pos", F.when(enters, F.col("pos") + k - 1).otherwise(F.col("pos")).alias("base_at"))
    return rows.groupBy("id").agg(F.min(F.struct("pos", "base_at")).alias("x")).select("id", F.col("x.pos").alias("at"), "x.base_at")


def correct_once(reads: DataFrame, k: int = 31, least: int = 6) -> DataFrame:
    """id, seq, changed_at: one base a read is replaced if another makes the weak k-mer frequent. Of several such bases the last in ACGT order is taken, as is the read's own."""
    counts = durable(kmers.strand_counts(reads, k), "counts")
    spots = weak_spots(reads, counts, k, least)
    rows = reads.select("id", "seq").join(spots, "id")
    place = F.col("base_at") - F.col("at")
    window = dna.substr("seq", F.col("at") + 1, k)
    rows = rows.select("id", "base_at", F.explode(F.array(*map(F.lit, "ACGT"))).alias("base"), window.alias("w"), place.alias("p"))
    rows = rows.select("id", "base_at", "base", dna.canonical(F.concat(F.left("w", F.col("p")), "base", dna.substr("w", F.col("p") + 2, k))).alias("canon"))
    best = rows.join(counts, "canon").filter(F.col("fw") + F.col("rv") >= least).groupBy("id", "base_at").agg(F.max("base").alias("base"))
    out = reads.select("id", "seq").join(best, "id", "left")
    changes = F.col("base").isNotNull() & (dna.substr("seq", F.col("base_at") + 1, 1) != F.col("base"))
    fixed = F.concat(F.left("seq", F.col("base_at")), "base", dna.substr("seq", F.col("base_at") + 2, F.length("seq")))
    return out.select("id", F.when(changes, fixed).otherwise(F.col("seq")).alias("seq"), F.when(changes, F.col("base_at")).alias("changed_at"))


def correct(reads: DataFrame, k: int = 31, least: int = 6, rounds: int = 2) -> DataFrame:
    """id, seq after at most ``rounds`` single-base corrections of each read."""
    now = reads.select("id", "seq")
    for _ in range(rounds):
        fixed = durable(correct_once(now, k, least), "corrected")
        now = fixed.select("id", "seq")
        if not fixed.filter(F.col("changed_at").isNotNull()).limit(1).count():
            break
    return now


def correct_learned(reads: DataFrame, k: int = 31, rounds: int = 2) -> DataFrame:
    """``correct`` with twice the threshold that the reads' own k-mer histogram tells; reads whose histogram has no error boundary are an error."""
    row = kmers.learned_threshold(kmers.histogram(reads, k)).first()
    if row is None or row["threshold"] < 0:
        raise ValueError("the k-mer histogram has no error boundary; give a threshold")
    return correct(reads, k, 2 * row["threshold"], rounds)


ALPHABET = "ACGT"


def conflict_consensus(root: str, rows: list[tuple[int, str]], least: int, cutoff: int) -> str:
    """A read's consensus with rows (shift, seq) placed on it without gaps.

    A column is in conflict if its second most frequent base and the read's own
    occur more than ``cutoff`` times, the read counted. Rows that differ from
    the read in such a column are another copy's and are set aside. A base that
    ``least`` rows left confirm stays; else the most frequent base of the rows
    left is taken, or, outside of conflicts, that of all rows, if it is more
    frequent than the read's own there; the first of ACGT on a tie.
    """
    n = len(root)
    codes = np.full((len(rows) + 1, n), -1, np.int8)
    for r, (shift, seq) in enumerate([(0, root), *rows]):
        begin, end = max(0, shift), min(n, shift + len(seq))
        if begin < end:
            codes[r, begin:end] = _CODE[np.frombuffer(seq[begin - shift : end - shift].encode(), np.uint8)]
    count = lambda part: np.stack([(part == b).sum(0) for b in range(4)])
    every, own = count(codes), codes[0].astype(int)
    known, places = own >= 0, np.arange(n)
    second = np.sort(every, 0)[-2]
    conflict = (second > cutoff) & known & (every[own, places] > cutoff)
    foreign = ((codes != codes[0]) & (codes >= 0) & conflict).any(1)
    left = count(codes[~foreign])
    mine = np.where(known, left[own, places], 0)
    called = np.where(left.max(0) > mine, left.argmax(0), np.where((second <= cutoff) & (every.max(0) > mine), every.argmax(0), own))
    called = np.where(mine >= least, own, called)
    return "".join(ALPHABET[c] if c >= 0 else root[i] for i, c in enumerate(called))


_CODE = np.full(256, -1, np.int8)
_CODE[list(ALPHABET.encode())] = range(4)


def _consensus(least: int, cutoff: int):
    def run(frames):
        for frame in frames:
            found = [conflict_consensus(s, [(int(r["shift"]), r["seq"]) for r in rows], least, cutoff) for s, rows in zip(frame["seq"].tolist(), frame["rows"].tolist())]
            yield pd.DataFrame({"idx": frame["idx"], "seq": found})

    return run


def overlap_correct(reads: DataFrame, k: int = 31, identity: float = 0.95, least: int = 3, cutoff: int = 5, most: int = 50) -> DataFrame:
    """idx, seq: each read of idx, seq after a consensus with those that are like it (``similar``, at most ``most`` of them); reads without any stay."""
    reads = durable(reads.select("idx", "seq"), "before-consensus")
    hits = similar(reads, k, 2, most, identity).select(F.col("a").alias("idx"), "b", "strand", "shift")
    other = reads.select(F.col("idx").alias("b"), F.col("seq").alias("other"))
    rows = hits.join(other, "b").select("idx", F.struct("shift", F.when(F.col("strand") == 1, dna.revcomp("other")).otherwise(F.col("other")).alias("seq")).alias("row"))
    piles = reads.join(rows.groupBy("idx").agg(F.collect_list("row").alias("rows")), "idx")  # a read has at most ``most`` rows
    fixed = durable(piles.mapInPandas(_consensus(least, cutoff), "idx bigint, seq string"), "consensus")
    return fixed.unionByName(reads.join(fixed, "idx", "left_anti"))


def metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, key, samples, errors of corrected bases by position, base, preceding two bases (from the fourth base on) and quality. ``before``: id, seq, scores; ``after``: id, seq."""
    rows = before.select("id", "seq", "scores").join(after.select("id", F.col("seq").alias("fixed")), "id").filter(F.length("seq") == F.length("fixed"))
    rows = rows.select("seq", "fixed", F.posexplode("scores").alias("i", "q"))
    base = dna.substr("seq", F.col("i") + 1, 1)
    rows = rows.select(F.col("i"), "q", base.alias("base"), F.when(F.col("i") > 2, dna.substr("seq", F.col("i") - 1, 2)).alias("two"), (base != dna.substr("fixed", F.col("i") + 1, 1)).cast("long").alias("bad"))
    keyed = rows.select("bad", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key")) for kind, c in (("position", F.col("i")), ("base", F.col("base")), ("previous", F.col("two")), ("quality", F.col("q")))])).alias("x"))
    return keyed.filter(F.col("x.key").isNotNull()).groupBy("x.kind", "x.key").agg(F.count("*").alias("samples"), F.sum("bad").alias("errors"))


def pileup(rows: DataFrame) -> DataFrame:
    """root, pos, a, c, g, t of aligned bases: root, offset, seq (own definition: ungapped placements)."""
    each = rows.select("root", "offset", "seq", F.posexplode(F.split("seq", "")).alias("i", "base")).filter(F.col("base") != "")
    return each.groupBy("root", (F.col("offset") + F.col("i")).alias("pos")).agg(*[F.count_if(F.col("base") == b).alias(b.lower()) for b in "ACGT"])


def consensus(piles: DataFrame, roots: DataFrame) -> DataFrame:
    """root, pos, base, called, depth: the majority base; the root's own on a tie. ``roots``: root, seq."""
    own = roots.select("root", F.posexplode(F.split("seq", "")).alias("pos", "base")).filter(F.col("base") != "")
    top = F.greatest("a", "c", "g", "t")
    mine = F.when(F.col("base") == "A", F.col("a")).when(F.col("base") == "C", F.col("c")).when(F.col("base") == "G", F.col("g")).otherwise(F.col("t"))
    called = F.when(mine == top, F.col("base")).when(F.col("a") == top, "A").when(F.col("c") == top, "C").when(F.col("g") == top, "G").otherwise("T")
    return own.join(piles, ["root", "pos"]).select("root", "pos", "base", called.alias("called"), (F.col("a") + F.col("c") + F.col("g") + F.col("t")).alias("depth"))
