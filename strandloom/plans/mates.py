"""Driver queries: base-by-base walks between mates and the merging of pairs by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import matewalk as MW, reads as R
from strandloom.plans.base import query, tiles

#: Reads begin every 20 bases here, so that each 21-mer inside a text is in four of them, and one in more is a repeat.
STEP = 20
LIMITS = MW.Limits(seed=21, support=2, leaves=32, most_length=300)


def merger(spark, sf_dir):
    reads = tiles(spark, sf_dir, STEP)
    name = lambda mate: F.concat(F.lit("p"), F.col("pair_id").cast("string"), F.lit(f"/{mate}")).alias(f"name{mate}")
    pairs = R.paired(reads).select("pair_id", name(1), "first", name(2), "second")
    return MW.Merger(pairs, reads, LIMITS, 31, 2)


@query()
def base_walk(spark, sf_dir):
    """Both walks of every pair, with the reason why those that didn't arrive stopped."""
    return merger(spark, sf_dir).walks()


@query()
def hybrid_merge(spark, sf_dir):
    """Merged pairs and the parts of the others, one union."""
    merged, parts, _ = merger(spark, sf_dir).hybrid()
    return merged.withColumn("kind", F.lit("merged")).unionByName(parts.withColumn("kind", F.lit("part")))


@query()
def merge_only(spark, sf_dir):
    return merger(spark, sf_dir).merge_only()[0]


@query()
def merge_counters(spark, sf_dir):
    m = merger(spark, sf_dir)
    _, _, hybrid = m.hybrid()
    return hybrid.withColumn("way", F.lit("hybrid")).unionByName(m.merge_only()[1].withColumn("way", F.lit("merge_only")))
