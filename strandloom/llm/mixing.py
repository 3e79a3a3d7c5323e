"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target number of words. Whole passes over a source use up as
much of it as they can; for the rest, documents are counted by exact length, an
even share of every length is taken, and a bounded knapsack fills what remains,
so that the words taken meet the target to a word wherever lengths allow it.
Documents of a length are then taken in the order of a seeded hash.

The plan of a source works on its histogram of lengths, never on its documents.
Null texts have size 0; null sources are one source, the last; repeated ids are
rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.storage import durable
from strandloom.llm.text import WORD

#: Fixed values of the contract.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BUCKETS = 256


def sizes(docs: DataFrame) -> DataFrame:
    count = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    return docs.select("doc_id", "source", "text").select("doc_id", "source", key.alias("skey"), count.alias("size"))


def targets(by_source: DataFrame) -> DataFrame:
    """skey, source_size, target. Water filling: caps in the order in which a rising level meets them.

    Windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    rows = by_source.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", SHARE * F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("before", F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    rows = rows.withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("budget") - F.col("before")) / F.col("open")
    rows = rows.withColumn("level", F.max(F.when(level * F.col("weight") <= F.col("cap"), level)).over(everything))
    return rows.select("skey", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def fit_counts(size: np.ndarray, count: np.ndarray, budget: int, seed: int, room: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their sum is next to ``budget``."""
    size, count = size.astype(np.int64), count.astype(np.int64)
    total = int((size * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(size), np.int64)
    if budget >= total:
        return count.copy()
    taken = np.floor(count * (budget / total)).astype(np.int64)
    left = budget - int((size * taken).sum())
    turn = np.random.default_rng(seed).permutation(len(size))
    for i in turn:  # one more of each length in a seeded order, until the knapsack can hold what is left
        if left <= room // 2:
            break
        if size[i] and taken[i] < count[i] and size[i] <= left:
            taken[i] += 1
            left -= int(size[i])
    for i in turn[np.argsort(-size[turn], kind="stable")]:
        if left <= room // 2:
            break
        if size[i]:
            more = int(min(count[i] - taken[i], (left - room // 2) // size[i] + 1, left // size[i]))
            taken[i] += max(0, more)
            left -= max(0, more) * int(size[i])
    top = min(left + int(size.max()), left + room)
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    by, times = np.full(top + 1, -1, np.int64), np.zeros(top + 1, np.int64)
    for i in turn:
        if reached[left]:
            break
        spare = int(min(count[i] - taken[i], top // size[i])) if size[i] else 0
        part = 1
        while spare > 0 and not reached[left]:  # a bounded count as powers of two
            k = min(part, spare)
            step = k * int(size[i])
            new = np.flatnonzero(reached[: top + 1 - step] & ~reached[step:]) + step if step <= top else np.zeros(0, np.int64)
            by[new], times[new] = i, k
            reached[new] = True
            spare -= k
            part *= 2
    found = np.flatnonzero(reached)
    at = int(found[np.argmin(np.abs(found - left))])
    while at:
        i, k = by[at], times[at]
        taken[i] += k
        at -= int(k * size[i])
    return taken


def _plan(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        target, whole = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
        full = min(MOST, int(target // whole)) if whole else 0
        rest = 0 if full >= MOST else int(round(target - full * whole))
        rows = rows.sort_values("size")
        extra = fit_counts(rows["size"].to_numpy(), rows["n"].to_numpy(), rest, seed)
        return pd.DataFrame({"skey": rows["skey"], "size": rows["size"], "full": full, "extra": extra})

    return run


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row."""
    rows = durable(sizes(docs), "sizes").withColumn("turn", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.col("turn"), F.lit(BUCKETS)).cast("int"))
    counts = durable(rows.groupBy("source", "skey", "size", "bucket").agg(F.count("*").alias("m")), "counts")
    goal = targets(counts.groupBy("source", "skey").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")))
    histogram = counts.groupBy("skey", "size").agg(F.sum("m").alias("n")).join(goal, "skey")
    plan = histogram.groupBy("skey").applyInPandas(_plan(seed), "skey string, size long, full int, extra long")
    before = F.sum("m").over(Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    cells = counts.select("skey", "size", "bucket", "m").withColumn("before", before).drop("m").join(plan, ["skey", "size"])
    place = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("turn", "doc_id"))
    out = rows.join(cells, ["skey", "size", "bucket"]).withColumn("place", F.col("before") + place)
    out = out.join(goal, "skey")
    taken = F.col("size") * (F.col("full") + (F.col("place") <= F.col("extra")).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")
