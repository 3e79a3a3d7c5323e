"""What mate pairs say about a graph: which arcs they support, and which dead ends they tie and walks join.

Pairs (pair_id, first, second) face each other: the second mate is read on the
other strand. Mates stand where a k-mer of theirs does, so no read is aligned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions import dna
from strandloom.operators import kmers, matewalk, search
from strandloom.operators.graph import drop_arcs, twin, vertex
from strandloom.operators.overlap import oriented
from strandloom.sources.durable import durable


def mates_of(pairs: DataFrame) -> DataFrame:
    """pair_id, mate (1, 2), seq."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mate"), F.col(c).alias("seq")) for i, c in ((1, "first"), (2, "second"))])).alias("x")
    return pairs.select("pair_id", each).select("pair_id", "x.mate", "x.seq").filter(F.col("seq").isNotNull())


def _sequences(vertices: DataFrame) -> DataFrame:
    return oriented(vertices.select(F.col("v").alias("idx"), "seq"))


def _places(at: Column, half: int) -> Column:
    return F.array(*[F.greatest(at - i * half, F.lit(0)) for i in range(3)])


def edge_support(vertices: DataFrame, arcs: DataFrame, pairs: DataFrame, k: int = 51, insert: int = 200, leaves: int = 128, hits: int = 600) -> DataFrame:
    """a, b, size, state, pairs (long) of each arc, one row an arc.

    An arc's mates are those with one of three k-mers of a that end left of the
    overlap, at half a k-mer's distance. Their other mates must have a k-mer
    that ends an ``insert``, give or take half a k-mer and a base, beyond the
    middle one on a path over the arc. ``pairs`` counts such pairs; where no
    path is long enough there are none. state: 'wide' for overlaps of 0.8
    inserts and more, and 'open' for arcs from a node with more than ``leaves``
    paths within 1.5 inserts, which aren't judged (pairs is null); else
    'judged'. K-mers with more than ``hits`` places on either strand are
    repeats and tell nothing.
    """
    half = k // 2
    arcs = durable(arcs.select("a", "b", "size"), "supported-arcs")
    narrow = arcs.filter(F.col("size") < 0.8 * insert)
    found, given = search.paths(vertices, arcs, narrow.select(F.col("a").alias("start")), int(1.5 * insert), leaves)
    strings = search.path_strings(vertices, arcs, durable(found.filter(F.size("nodes") > 1), "support-paths"))
    seqs = _sequences(vertices).select(F.col("node").alias("a"), F.col("seq").alias("from"))
    ends = narrow.join(given.select(F.col("start").alias("a")), "a", "left_anti").join(seqs, "a").withColumn("at", F.length("from") - F.col("size") - 1)
    ends = durable(ends.select("a", "b", "from", "at"), "support-ends")
    seeds = ends.select("a", "b", "from", F.explode(_places(F.col("at"), half)).alias("p")).select("a", "b", dna.substr("from", F.col("p") + 1, k).alias("kmer"))
    middle = F.greatest(F.col("at") - half, F.lit(0))
    targets = F.array(*[middle + insert + d for d in (-half - 1, 0, half + 1)])
    walks = strings.select(F.col("start").alias("a"), F.get("nodes", F.lit(1)).alias("b"), "seq").join(ends.drop("from"), ["a", "b"])
    goals = walks.select("a", "b", "seq", F.explode(targets).alias("t")).filter((F.col("t") >= k) & (F.length("seq") >= F.col("t")))
    goals = goals.select("a", "b", dna.substr("seq", F.col("t") - k + 1, k).alias("kmer"))
    asked = seeds.withColumn("side", F.lit(0)).unionByName(goals.withColumn("side", F.lit(1))).filter(F.length("kmer") == k)
    asked = durable(asked.select("a", "b", "side", dna.canonical("kmer").alias("canon")).distinct(), "support-kmers")
    spots = kmers.both_strands(mates_of(pairs), k, "pair_id", "mate").select("pair_id", "mate", F.least("kmer", "rc").alias("canon"))
    spots = durable(spots.join(asked.select("canon").distinct(), "canon", "left_semi"), "support-places")
    rare = spots.groupBy("canon").agg(F.count("*").alias("n")).filter(F.col("n") <= hits).select("canon")
    spots = spots.join(rare, "canon", "left_semi").distinct()
    met = asked.join(spots, "canon")
    near = met.filter(F.col("side") == 0).select("a", "b", "pair_id", "mate").distinct()
    far = met.filter(F.col("side") == 1).select("a", "b", "pair_id", (3 - F.col("mate")).alias("mate")).distinct()
    counts = near.join(far, ["a", "b", "pair_id", "mate"]).groupBy("a", "b").agg(F.count_distinct("pair_id").alias("n"))
    judged = ends.select("a", "b", F.lit(True).alias("judged"))
    rows = arcs.join(judged, ["a", "b"], "left").join(counts, ["a", "b"], "left")
    state = F.when(F.col("judged"), "judged").when(F.col("size") < 0.8 * insert, "open").otherwise("wide")
    return rows.select("a", "b", "size", state.alias("state"), F.when(F.col("judged"), F.coalesce("n", F.lit(0))).alias("pairs"))


def drop_unsupported(arcs: DataFrame, support: DataFrame, least: int = 1) -> DataFrame:
    """The arcs without those that fewer than ``least`` pairs support from either of their ends."""
    return drop_arcs(arcs, support.filter(F.col("pairs") < least).select("a", "b", "size"))


def dead_ends(vertices: DataFrame, arcs: DataFrame, least: int) -> DataFrame:
    """node, seq of oriented vertices of ``least`` bases or more that no arc leaves."""
    return _sequences(vertices).filter(F.length("seq") >= least).join(arcs.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", "seq")


def end_reads(ends: DataFrame, mates: DataFrame, counts: DataFrame, k: int, insert: int, cutoff: int, step: int = 20) -> DataFrame:
    """node, pair_id, mate: mates that point out of a dead end (node, seq), by k-mers every ``step`` bases within ``insert`` of it.

    K-mers that occur ``cutoff`` times or more on both strands are repeats and
    aren't asked, which also bounds how many mates a k-mer brings. ``counts``:
    canon, fw, rv.
    """
    room = F.least(F.lit(insert - 1), F.length("seq") - k)
    seeds = ends.filter(F.length("seq") >= k).select("node", "seq", F.explode(F.sequence(F.lit(0), room, F.lit(step))).alias("i"))
    seeds = seeds.select("node", dna.substr("seq", F.length("seq") - F.col("i") - k + 1, k).alias("kmer")).distinct()
    rare = counts.filter(F.col("fw") + F.col("rv") < cutoff).select("canon")
    seeds = seeds.withColumn("canon", dna.canonical("kmer")).join(rare, "canon", "left_semi").select("node", "kmer")
    return kmers.explode(mates, k, "pair_id", "mate").drop("pos").join(seeds, "kmer").select("node", "pair_id", "mate").distinct()


def end_links(placed: DataFrame, least: int) -> DataFrame:
    """a, b, pairs: dead ends (a < b) of different vertices that more than ``least`` pairs tie, mate to mate, each the other's best: most pairs, then the least node."""
    one = placed.filter(F.col("mate") == 1).select(F.col("node").alias("x"), "pair_id")
    two = placed.filter(F.col("mate") == 2).select(F.col("node").alias("y"), "pair_id")
    rows = one.join(two, "pair_id").filter(vertex("x") != vertex("y"))
    links = durable(rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count_distinct("pair_id").alias("pairs")).filter(F.col("pairs") > least), "end-links")
    sides = links.select("a", "b", "pairs").unionAll(links.select("b", "a", "pairs"))
    best = sides.groupBy("a").agg(F.min(F.struct(-F.col("pairs"), "b"))["b"].alias("best"))
    rows = links.join(best.withColumnRenamed("best", "to"), "a").filter(F.col("to") == F.col("b"))
    back = best.select(F.col("a").alias("b"), F.col("best").alias("back"))
    return rows.join(back, "b").filter(F.col("back") == F.col("a")).select("a", "b", "pairs")


def walk_links(links: DataFrame, ends: DataFrame, places: matewalk.Places, counts: DataFrame, limits: matewalk.Limits) -> DataFrame:
    """a, b, pairs, status, added: the bases that lead from dead end a to the first m bases of what b ends, these included; null where no walk arrives (status tells why)."""
    m, reach = places.m, max(limits.most_overlap, places.m + 1)
    seqs = ends.select("node", "seq")
    rows = links.join(seqs.select(F.col("node").alias("a"), F.right("seq", F.lit(reach)).alias("source")), "a")
    rows = rows.join(seqs.select(F.col("node").alias("b"), dna.revcomp(F.right("seq", F.lit(m))).alias("target")), "b")
    rows = durable(rows.withColumn("pair_id", F.col("a")), "links-to-walk")  # a dead end is in one link
    asked = rows.select("pair_id", F.lit("link").alias("way"), "source", "target", F.lit(reach).alias("most_overlap"))
    told = matewalk.walk(asked, places, counts, limits, antisense=False).select("pair_id", "status", "merged")
    return rows.join(told, "pair_id").select("a", "b", "pairs", "status", F.expr("substring(merged, length(source) + 1)").alias("added"))


def join_islands(vertices: DataFrame, arcs: DataFrame, walked: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The graph with an arc of overlap ``size`` for each walk that arrived; a's vertex grows by the walked bases, on the side of its dead end. Other columns of the vertices stay."""
    there = durable(walked.filter(F.col("added").isNotNull()).select("a", "b", "added"), "joined")
    grown = there.groupBy(vertex("a").alias("v")).agg(
        F.max(F.when(F.col("a") % 2 == 0, F.col("added"))).alias("_right"), F.max(F.when(F.col("a") % 2 == 1, dna.revcomp("added"))).alias("_left")
    )
    seq = F.concat(F.coalesce("_left", F.lit("")), "seq", F.coalesce("_right", F.lit("")))
    rows = vertices.join(grown, "v", "left").withColumn("seq", seq).select(*vertices.columns)
    new = there.select("a", twin("b").alias("b"), F.lit(size).cast(arcs.schema["size"].dataType).alias("size"))
    new = new.unionAll(new.select(twin("b").alias("a"), twin("a").alias("b"), "size"))
    return rows, arcs.select("a", "b", "size").unionAll(new)
