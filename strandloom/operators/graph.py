"""Overlap graphs: vertices (v, seq, cov) and arcs (a, b, size) between oriented vertices ``2 * v + strand``.

Arcs come with their twins. Visitors of a graph are functions that find what to
remove on a snapshot; removal closes the set under twins. Order-dependent
protection is decided on the snapshot, so results don't depend on scheduling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import dna
from strandloom.operators import kmers
from strandloom.operators.components import components
from strandloom.sources.durable import durable


def twin(node: Column | str) -> Column:
    return dna.col(node).bitwiseXOR(F.lit(1).cast("bigint"))


def vertex(node: Column | str) -> Column:
    return F.shiftright(dna.col(node), 1)


def twinned(arcs: DataFrame) -> DataFrame:
    """Arcs and their twins, those that have theirs twice."""
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(twin("b").alias("a"), twin("a").alias("b")))).alias("e")  # arcs are made once
    return arcs.select(ends, "size").select("e.a", "e.b", "size")


def with_twins(arcs: DataFrame) -> DataFrame:
    return twinned(arcs).distinct()


def degrees(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    """v, len, sense, anti: edges that leave through each end."""
    out = arcs.groupBy(vertex("a").alias("v")).agg(F.count_if(F.col("a") % 2 == 0).alias("sense"), F.count_if(F.col("a") % 2 == 1).alias("anti"))
    return vertices.select("v", F.length("seq").alias("len")).join(out, "v", "left").select("v", "len", F.coalesce("sense", F.lit(0)).alias("sense"), F.coalesce("anti", F.lit(0)).alias("anti"))


def stats(vertices: DataFrame, arcs: DataFrame) -> DataFrame:
    s, a = F.col("sense"), F.col("anti")
    return degrees(vertices, arcs).agg(
        F.count("*").alias("vertices"),
        F.coalesce(F.sum(s + a), F.lit(0)).alias("edges"),
        F.count_if((s == 0) & (a == 0)).alias("islands"),
        F.count_if((s == 0) != (a == 0)).alias("tips"),
        F.count_if((s > 1) != (a > 1)).alias("monobranch"),
        F.count_if((s > 1) & (a > 1)).alias("dibranch"),
        F.count_if((s == 1) | (a == 1)).alias("simple"),
        F.count_if((s == 1) & (a == 1)).alias("straight"),
    )


def drop_vertices(vertices: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``gone``: v."""
    left = vertices.join(gone, "v", "left_anti")
    kept = arcs.withColumn("v", vertex("a")).join(gone, "v", "left_anti").withColumn("v", vertex("b")).join(gone, "v", "left_anti")
    return left, kept.select("a", "b", "size")


def drop_arcs(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    return arcs.join(with_twins(gone).select("a", "b", "size"), ["a", "b", "size"], "left_anti")


def short_ends(vertices: DataFrame, arcs: DataFrame, least: int) -> DataFrame:
    """v of islands and tips shorter than ``least``."""
    return degrees(vertices, arcs).filter(((F.col("sense") == 0) | (F.col("anti") == 0)) & (F.col("len") < least)).select("v")


def trim(vertices: DataFrame, arcs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    return drop_vertices(vertices, arcs, short_ends(vertices, arcs, least))


def single_edges(arcs: DataFrame) -> DataFrame:
    """Of parallel arcs between two oriented vertices the one of longest overlap."""
    return arcs.groupBy("a", "b").agg(F.max("size").alias("size"))


def short_both_sides(vertices: DataFrame, arcs: DataFrame, vertex_length: int, overlap: int, k: int = 31, counts: DataFrame | None = None, threshold: float = 0) -> DataFrame:
    """v of short vertices whose best overlaps of both ends are short, and whose mean k-mer count is low if ``counts`` (canon, fw, rv) is given."""
    best = arcs.groupBy(vertex("a").alias("v")).agg(F.max(F.when(F.col("a") % 2 == 0, F.col("size"))).alias("s"), F.max(F.when(F.col("a") % 2 == 1, F.col("size"))).alias("t"))
    rows = vertices.filter(F.length("seq").between(k, vertex_length)).join(best, "v").filter((F.col("s") <= overlap) & (F.col("t") <= overlap))
    if counts is None:
        return rows.select("v")
    means = kmers.explode(rows, k, "v").withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left").groupBy("v").agg(F.avg(F.coalesce(F.col("fw") + F.col("rv"), F.lit(0))).alias("mean"))
    return means.filter(F.col("mean") <= threshold).select("v")


def length_differences(vertices: DataFrame, arcs: DataFrame, least_vertex: int, least_overlap: int, difference: int, protect: bool = True) -> DataFrame:
    """Arcs of long vertices that fall short of their direction's best overlap; a direction that would lose all keeps them."""
    best = Window.partitionBy("a")
    rows = arcs.join(vertices.select("v", F.length("seq").alias("len")), vertex("a") == F.col("v")).filter(F.col("len") >= least_vertex)
    rows = rows.select("a", "b", "size", F.max("size").over(best).alias("top"), F.count("*").over(best).alias("n"))
    bad = (F.lit(least_overlap) > 0) & (F.col("top") > least_overlap) & (F.col("size") < least_overlap) | (F.lit(difference) > 0) & (F.col("top") - F.col("size") >= difference)
    rows = rows.filter(F.col("n") > 1).withColumn("bad", bad)
    if protect:
        rows = rows.withColumn("all_bad", F.bool_and("bad").over(best)).filter(~F.col("all_bad"))
    return rows.filter("bad").select("a", "b", "size")


def low_ratio(vertices: DataFrame, arcs: DataFrame, ratio: float, below: int, most_match: int = 0) -> DataFrame:
    """Arcs of vertices shorter than ``below`` whose overlap is a small part of the shorter original read. Needs vertices.origin, the length of the read at either end."""
    near = vertices.select(F.col("v").alias("va"), F.length("seq").alias("len"), F.col("origin").alias("oa"))
    far = vertices.select(F.col("v").alias("vb"), F.col("origin").alias("ob"))
    rows = arcs.join(near, vertex("a") == F.col("va")).join(far, vertex("b") == F.col("vb")).filter(F.col("len") < below)
    if most_match:
        rows = rows.filter(F.col("size") <= most_match)
    return rows.filter(F.col("size").cast("double") / F.least("oa", "ob") < ratio).select("a", "b", "size")


def illegal_kmers(vertices: DataFrame, arcs: DataFrame, counts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Arcs over k - 1 bases whose joining k-mers are strong on both strands at both vertices although the vertices go on differently."""
    both = vertices.select((F.col("v") * 2).alias("node"), "seq").unionAll(vertices.select((F.col("v") * 2 + 1).alias("node"), dna.revcomp("seq").alias("seq")))
    rows = arcs.filter(F.col("size") == k - 1).join(both.withColumnRenamed("node", "a").withColumnRenamed("seq", "sa"), "a").join(both.withColumnRenamed("node", "b").withColumnRenamed("seq", "sb"), "b")
    rows = rows.select("a", "b", "size", dna.canonical(F.right("sa", F.lit(k))).alias("ka"), dna.canonical(F.left("sb", F.lit(k))).alias("kb"))
    strong = counts.filter((F.col("fw") >= threshold) & (F.col("rv") >= threshold)).select("canon")
    return rows.join(strong.withColumnRenamed("canon", "ka"), "ka", "left_semi").join(strong.withColumnRenamed("canon", "kb"), "kb", "left_semi").select("a", "b", "size")


def simple_arcs(arcs: DataFrame) -> DataFrame:
    """Arcs that are the only way out of a and the only way into b, between different vertices."""
    out = arcs.groupBy("a").agg(F.count("*").alias("n")).filter("n = 1").select("a")
    into = arcs.groupBy("b").agg(F.count("*").alias("n")).filter("n = 1").select("b")
    return arcs.filter(vertex("a") != vertex("b")).join(out, "a", "left_semi").join(into, "b", "left_semi").select("a", "b", "size")


def chains(arcs: DataFrame) -> DataFrame:
    """node, chain, rank, size: places of oriented vertices along unbranched paths; size is the overlap with the one before. A circle begins at its least node. Pointer jumping: rounds grow with the logarithm of the longest path."""
    steps = durable(simple_arcs(arcs), "steps")
    label = components(steps)
    into = steps.select(F.col("b").alias("node"), F.col("a").alias("before"), "size")
    rows = label.join(into, "node", "left")
    circles = rows.groupBy("root").agg(F.count("*").alias("n"), F.count("before").alias("m")).filter("n = m").select("root", F.lit(True).alias("circle"))
    rows = rows.join(circles, "root", "left")
    opened = F.col("circle").isNotNull() & (F.col("node") == F.col("root"))
    rows = rows.select("node", F.col("root").alias("chain"), F.when(~opened, F.col("before")).alias("before"), F.when(~opened, F.col("size")).alias("size"))
    base = durable(rows.select("node", "chain", "size", F.coalesce("before", "node").alias("to"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("rank")), "chains")
    now = base
    while True:
        far = now.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rank").alias("rank2"))
        new = durable(now.join(far, "to").select("node", "chain", "size", F.col("to2").alias("to"), (F.col("rank") + F.col("rank2")).alias("rank")), "chains")
        if not new.join(now.select("node", F.col("to").alias("was")), "node").filter("`to` <> was").limit(1).count():
            return new.select("node", "chain", "rank", "size")
        now = new


def compact(vertices: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with each unbranched path as one vertex (v: its least oriented vertex, halved; members, cov summed)."""
    places = durable(chains(arcs), "places")
    other = places.select(twin("node").alias("node"), F.col("chain").alias("mirror"))
    kept = places.join(other, "node").filter(F.col("chain") <= F.col("mirror")).select("node", "chain", "rank", "size")
    seqs = vertices.select((F.col("v") * 2).alias("node"), "seq", "cov").unionAll(vertices.select((F.col("v") * 2 + 1).alias("node"), dna.revcomp("seq").alias("seq"), "cov"))
    parts = kept.join(seqs, "node").select("chain", "rank", "node", "cov", F.when(F.col("rank") == 0, F.col("seq")).otherwise(dna.substr("seq", F.col("size") + 1, F.length("seq"))).alias("label"))
    joined = parts.groupBy("chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "").alias("seq"), F.sum("cov").alias("cov"), F.count("*").alias("members"), F.min_by("node", "rank").alias("first"), F.max_by("node", "rank").alias("last"))
    joined = durable(joined.withColumn("v", vertex("chain")), "joined")
    inside = kept.select(vertex("node").alias("v")).distinct()
    alone = vertices.join(inside, "v", "left_anti").select("v", "seq", "cov", F.lit(1).cast("bigint").alias("members"), (F.col("v") * 2).alias("first"), (F.col("v") * 2).alias("last"))
    every = joined.select("v", "seq", "cov", "members", "first", "last").unionAll(alone)
    ins = every.select(F.col("first").alias("b"), (F.col("v") * 2).alias("nb")).unionAll(every.select(twin("last").alias("b"), (F.col("v") * 2 + 1).alias("nb")))
    outs = ins.select(twin("b").alias("a"), twin("nb").alias("na"))
    moved = arcs.join(outs, "a").join(ins, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "size")
    moved = moved.filter(vertex("a") != vertex("b"))
    return every.select("v", "seq", "cov", "members"), moved


def contiguity(lengths: DataFrame, least: int = 500) -> DataFrame:
    """Sum, number, extremes and N20/N50/N80 of lengths (column len) of at least ``least``; sums by distinct length come first, so the ordered window is small."""
    groups = lengths.filter(F.col("len") >= least).groupBy("len").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    rows = groups.withColumn("upto", F.sum(F.col("len") * F.col("n")).over(down)).withColumn("total", F.sum(F.col("len") * F.col("n")).over(Window.partitionBy()))
    n = lambda share: F.max(F.when(F.col("upto") >= F.col("total") * F.lit(share), F.col("len")))
    return rows.agg(F.max("total").alias("total"), F.sum("n").alias("contigs"), F.max("len").alias("longest"), F.min("len").alias("shortest"), n(0.2).alias("n20"), n(0.5).alias("n50"), n(0.8).alias("n80"))


def neighbourhood(arcs: DataFrame, start: DataFrame, span: int = 5) -> DataFrame:
    """v, depth of vertices within ``span`` edges of the start vertices (v), breadth first."""
    links = arcs.select(vertex("a").alias("v"), vertex("b").alias("w")).filter("v <> w").distinct()
    seen = start.select("v", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, span + 1):
        front = front.join(links, "v").select(F.col("w").alias("v")).distinct().join(seen, "v", "left_anti").select("v", F.lit(depth).alias("depth"))
        front = durable(front, "front")
        if not front.limit(1).count():
            break
        seen = seen.unionAll(front)
    return seen


def erode(vertices: DataFrame, arcs: DataFrame, counts: DataFrame, k: int, threshold: int, erosion: int, least: int) -> DataFrame:
    """v, seq: weak ends of islands and tips cut back to the first and last strong k-mer, if ``least`` bases remain."""
    ends = degrees(vertices, arcs).filter((F.col("sense") == 0) | (F.col("anti") == 0))
    rows = kmers.explode(vertices.join(ends.select("v"), "v"), k, "v").withColumn("canon", dna.canonical("kmer")).join(counts, "canon")
    one, two = F.greatest("fw", "rv"), F.least("fw", "rv")
    strong = ((one >= threshold) & (two >= erosion)) | ((one >= erosion) & (two >= threshold))
    spots = rows.filter(strong).groupBy("v").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    found = vertices.join(ends, "v", "left").join(spots, "v", "left")
    begin = F.when((F.col("anti") == 0) & F.col("lo").isNotNull(), F.col("lo")).otherwise(0)
    stop = F.when((F.col("sense") == 0) & F.col("hi").isNotNull(), F.col("hi") + k).otherwise(F.length("seq"))
    cut = F.col("sense").isNotNull() & (stop - begin >= least)
    return found.select("v", F.when(cut, dna.substr("seq", begin + 1, stop - begin)).otherwise(F.col("seq")).alias("seq"))


def bubbles(vertices: DataFrame, arcs: DataFrame, most_gap: int = 9) -> DataFrame:
    """v of the weaker vertices of simple bubbles: paths of one vertex between the same two oriented vertices, all of like length; of each bubble the vertex of highest coverage stays (ties: least v)."""
    inner = vertices.select("v", F.length("seq").alias("len"), "cov")
    into = arcs.select(F.col("a").alias("s"), F.col("b").alias("m"), F.col("size").alias("s1"))
    outof = arcs.select(F.col("a").alias("m"), F.col("b").alias("t"), F.col("size").alias("s2"))
    lone = degrees(vertices, arcs).filter((F.col("sense") == 1) & (F.col("anti") == 1)).select("v")
    paths = into.join(outof, "m").withColumn("v", vertex("m")).join(lone, "v", "left_semi").join(inner, "v").filter((vertex("s") != F.col("v")) & (vertex("t") != F.col("v")))
    paths = paths.filter(F.col("s") <= twin("t")).withColumn("gap", F.col("len") - F.col("s1") - F.col("s2"))
    groups = paths.groupBy("s", "t").agg(F.count("*").alias("n"), (F.max("gap") - F.min("gap")).alias("spread"), F.max_by("v", F.struct("cov", -F.col("v"))).alias("best"))
    return paths.join(groups.filter((F.col("n") > 1) & (F.col("spread") <= most_gap)), ["s", "t"]).filter(F.col("v") != F.col("best")).select("v").distinct()


def overlap_ranks(arcs: DataFrame) -> DataFrame:
    """a, longest, second: the longest overlap of each end and the next one, null where there is one arc only. Sizes are counted first, so a hub brings a row a size."""
    sizes = arcs.groupBy("a", "size").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("size")))
    rows = sizes.withColumn("place", place).filter(F.col("place") <= 2)
    first = F.max(F.when(F.col("place") == 1, F.struct("size", "n")))
    rows = rows.groupBy("a").agg(first.alias("top"), F.max(F.when(F.col("place") == 2, F.col("size"))).alias("next"))
    return rows.select("a", F.col("top.size").alias("longest"), F.when(F.col("top.n") > 1, F.col("top.size")).otherwise(F.col("next")).alias("second"))


def ratio_stats(vertices: DataFrame, arcs: DataFrame, bins: int = 10) -> DataFrame:
    """bin, arcs, least, most: arcs by the share of the shorter vertex that they overlap, in tenths."""
    size = vertices.select("v", F.length("seq").alias("len"))
    rows = arcs.join(size.select(F.col("v").alias("va"), F.col("len").alias("la")), vertex("a") == F.col("va")).join(size.select(F.col("v").alias("vb"), F.col("len").alias("lb")), vertex("b") == F.col("vb"))
    ratio = F.col("size").cast("double") / F.least("la", "lb")
    rows = rows.select(ratio.alias("ratio"), F.floor(F.col("size") * bins / F.least("la", "lb")).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("arcs"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))


def kmer_coverage(contigs: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """v, kmers, total, mean: the larger of both strands' counts over a contig's k-mers; contigs below k have none."""
    rows = kmers.explode(contigs, k, "v").withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left")
    total = F.sum(F.coalesce(F.greatest("fw", "rv"), F.lit(0)))
    return rows.groupBy("v").agg(F.count("*").alias("kmers"), total.alias("total")).withColumn("mean", F.col("total").cast("double") / F.col("kmers"))
