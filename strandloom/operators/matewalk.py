"""Base-by-base walks from one mate to the other, and merging of pairs by them.

A walk begins with the source's last ``m`` bases and adds a base at a time: a
base goes on if the last k bases and it occur at least ``support`` times on both
strands of the reads. k grows by one each base, from m up to ``most_overlap``,
where it falls back to m; it also does where no path can go on, once. All open
paths of a pair step together. A walk ends where a path ends in the target's
first m bases, where more than ``leaves`` paths are open, where no path goes on
and where ``most_length`` is passed.

While k grows without falling back, a path's suffix only gains bases, so what
can follow is told by what follows the m-mer at the path's end in the reads that
have it. Such a leg is one join of the open paths' ends with places of m-mers,
not a join a base, and then a pair's paths, at most ``leaves``, are stepped
together. Of what follows an m-mer nothing beyond the first length at which more
than ``leaves`` ways are open is needed, as any walk is over there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions import dna
from strandloom.operators import kmers
from strandloom.operators.overlap import oriented
from strandloom.sources.durable import durable

KEY = ["pair_id", "way"]


@dataclass(frozen=True)
class Limits:
    """``most_overlap`` 0 means a share of the mates' mean length, by the caller."""

    seed: int = 31
    most_overlap: int = 0
    support: int = 3
    leaves: int = 32
    most_length: int = 400


class Places:
    """Where m-mers stand on both strands of the reads (idx, seq)."""

    def __init__(self, reads: DataFrame, m: int):
        self.m = m
        self.reads = durable(oriented(reads.filter(F.length("seq") >= m)), "oriented")
        starts = F.explode(F.sequence(F.lit(1), F.length("seq") - m + 1)).alias("at")
        spots = self.reads.select("node", "seq", starts)
        self.spots = durable(spots.select("node", "at", F.xxhash64(dna.substr("seq", F.col("at"), m)).alias("h")), "places")

    def occurrences(self, seqs: DataFrame) -> DataFrame:
        """seq, n: how often whole sequences of m bases or more occur. Windows of the asked lengths are counted where an asked m-mer stands, so a frequent m-mer meets a length once, not each sequence."""
        asked = seqs.filter(F.length("seq") >= self.m).select("seq").distinct()
        sizes = asked.select(F.xxhash64(F.left("seq", F.lit(self.m))).alias("h"), F.length("seq").alias("size")).distinct()
        met = self.spots.join(sizes, "h").join(self.reads, "node").select(dna.substr("seq", F.col("at"), F.col("size")).alias("seq"), "size").filter(F.length("seq") == F.col("size"))
        return asked.join(met.groupBy("seq").agg(F.count("*").alias("n")), "seq")

    def extensions(self, asked: DataFrame, support: int, leaves: int) -> DataFrame:
        """kmer, exts: what follows the asked m-mers (kmer, reach) over at most reach bases, at least ``support`` times; of extensions only those that no other goes on from.

        An m-mer's tails are counted apart and meet in one row, unless there are more than TAILS different ones: then their beginnings are counted by a group-by.
        """
        most = asked.groupBy("kmer").agg(F.max("reach").alias("most"))
        met = self.spots.join(most.withColumn("h", F.xxhash64("kmer")), "h").join(self.reads, "node")
        met = met.filter(dna.substr("seq", F.col("at"), self.m) == F.col("kmer"))
        tails = met.select("kmer", F.substring(F.col("seq"), F.col("at") + self.m, F.col("most")).alias("tail")).filter(F.length("tail") > 0)
        tails = durable(tails.groupBy("kmer", "tail").agg(F.count("*").alias("n")), "tails")
        many = durable(tails.groupBy("kmer").agg(F.count("*").alias("tails")).filter(F.col("tails") > TAILS).select("kmer"), "many-tails")
        few = tails.join(many, "kmer", "left_anti").groupBy("kmer").agg(F.collect_list(F.struct("tail", "n")).alias("tails"))
        rest = tails.join(many, "kmer", "left_semi").select("kmer", "n", "tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("j"))
        rest = rest.groupBy("kmer", "j", F.left("tail", F.col("j")).alias("ext")).agg(F.sum("n").alias("n")).filter(F.col("n") >= support)
        last = rest.groupBy("kmer", "j").agg(F.count("*").alias("width")).filter(F.col("width") > leaves).groupBy("kmer").agg(F.min("j").alias("last"))
        rest = rest.join(last, "kmer", "left").filter(F.col("last").isNull() | (F.col("j") <= F.col("last")))
        # few enough now; a beginning that goes on has its longer ones beside it, so one occurrence of each tells the same
        rest = rest.groupBy("kmer").agg(F.collect_list(F.struct(F.col("ext").alias("tail"), F.col("n"))).alias("tails"))
        kind = "kmer string, exts array<string>"
        return few.mapInPandas(_extended(support, leaves), kind).unionByName(rest.mapInPandas(_extended(1, leaves), kind))


#: Different tails of an m-mer that one row has at most.
TAILS = 4096


def maximal(tails: list[tuple[str, int]], support: int, leaves: int) -> list[str]:
    """Beginnings of the tails that occur ``support`` times and go no further, up to the first length with more than ``leaves`` of them."""
    out, now, j = [], {"": tails}, 0
    while now and len(now) <= leaves:
        longer: dict[str, list[tuple[str, int]]] = {}
        for begin, own in now.items():
            by: dict[str, list[tuple[str, int]]] = {}
            for t in own:
                if len(t[0]) > j:
                    by.setdefault(t[0][j], []).append(t)
            good = {begin + b: part for b, part in by.items() if sum(n for _, n in part) >= support}
            if begin and not good:
                out.append(begin)
            longer.update(good)
        now, j = longer, j + 1
    return out + list(now) if j else out


def _extended(support: int, leaves: int):
    def run(frames):
        for frame in frames:
            found = [maximal([(t["tail"], t["n"]) for t in tails], support, leaves) for tails in frame["tails"].tolist()]
            yield pd.DataFrame({"kmer": frame["kmer"], "exts": found})

    return run


def _leg(m: int, limits: Limits):
    """Steps all open paths of a pair as far as one leg goes."""

    def step(target: str, reach: int, used: int, open_: list[tuple[str, list[str]]]) -> tuple[str | None, int, list[str]]:
        size, end = len(open_[0][0]), target[:m]
        if size > limits.most_length:
            return "too_long", used, []
        exts = [(path, e[: limits.most_length - size + 1]) for path, own in open_ for e in own]
        exts = [(path, e[:reach]) for path, e in exts]
        j = 0
        now = [path for path, _ in open_]
        while True:
            new = sorted({path + e[: j + 1] for path, e in exts if len(e) > j})
            if not new:
                return (None if j else "dead_end"), used, now if j else []
            now, j, used = new, j + 1, max(used, len(new))
            there = [p for p in now if p.endswith(end)]
            if there:
                return "merged", used, [p + target[m:] for p in there]
            if len(now) > limits.leaves:
                return "too_many", used, []

    def run(frames):
        for frame in frames:
            told = [step(t, r, u, [(o["path"], [] if o["exts"] is None else list(o["exts"])) for o in open_]) for t, r, u, open_ in zip(frame["target"].tolist(), frame["reach"].tolist(), frame["used"].tolist(), frame["open"].tolist())]
            yield frame.drop(columns="open").assign(status=[x for x, _, _ in told], used=[x for _, x, _ in told], paths=[x for _, _, x in told])

    return run


def touching(pairs: DataFrame, m: int, antisense: bool = True) -> DataFrame:
    """pair_id, way, merged of pairs (source, target) that overlap as they are.

    Either the source's last m bases are the target's first; or the target's
    first m bases stand in the source's last 200 and the rest of the source
    agrees with the target; or (``antisense``) the source's first m bases stand
    in the target's first 50 and what follows agrees: then that is the merged part.
    """
    long_enough = (F.length("source") >= m) & (F.length("target") >= m)
    rows = pairs.filter(long_enough).select(*KEY, "source", "target", F.left("target", F.lit(m)).alias("head"), F.left("source", F.lit(m)).alias("start"))
    since = F.greatest(F.lit(1), F.length("source") - 199)
    rows = rows.withColumns({"p": F.call_function("locate", F.col("head"), F.col("source"), since), "q": F.call_function("locate", F.col("start"), F.col("target"))})
    one = F.right("source", F.lit(m)) == F.col("head")
    two = (F.col("p") > 0) & F.startswith(F.col("target"), F.expr("substring(source, p)"))
    three = F.lit(antisense) & F.col("q").between(1, 51) & F.startswith(F.col("source"), F.expr("substring(target, q)"))
    merged = F.when(one, F.concat("source", dna.substr("target", m + 1, F.length("target")))).when(two, F.concat(F.left("source", F.col("p") - 1), "target")).when(three, F.expr("substring(target, q)"))
    return rows.select(*KEY, merged.alias("merged")).filter(F.col("merged").isNotNull())


def coverage(paths: DataFrame, counts: DataFrame, m: int) -> DataFrame:
    """Adds ``coverage`` to paths (pair_id, way, path): counts on both strands of the m-mers at every m / 2 bases, summed."""
    places = F.sequence(F.lit(1), F.length("path") - m + 1, F.lit(max(1, m // 2)))
    rows = paths.select(*KEY, "path", F.explode(places).alias("at")).withColumn("canon", dna.canonical(dna.substr("path", F.col("at"), m)))
    rows = rows.join(counts.select("canon", (F.col("fw") + F.col("rv")).alias("n")), "canon", "left")
    return rows.groupBy(*KEY, "path").agg(F.sum(F.coalesce("n", F.lit(0))).alias("coverage"))


def walk(ends: DataFrame, places: Places, counts: DataFrame, limits: Limits, antisense: bool = True) -> DataFrame:
    """pair_id, way, status, merged, coverage, used, paths for ends (pair_id, way, source, target, most_overlap).

    status: overlap (no walk needed), merged, dead_end, too_long, too_many, short (an end has less than m bases).
    merged: of the paths that arrive the one of most coverage, then the least; null if none does. ``used``: most paths
    open at a time. ``counts``: canon, fw, rv of m-mers.
    """
    m = places.m
    ends = durable(ends.select(*KEY, "source", "target", "most_overlap"), "ends")
    near = durable(touching(ends, m, antisense), "touching")
    short = ends.filter((F.length("source") < m) | (F.length("target") < m))
    reach = F.greatest(F.lit(1), F.col("most_overlap") - m).cast("int").alias("reach")
    front = ends.join(near, KEY, "left_anti").filter((F.length("source") >= m) & (F.length("target") >= m))
    front = durable(front.select(*KEY, "target", reach, F.lit(0).cast("bigint").alias("used"), F.array("source").alias("paths")), "front")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in front.schema if f.name != "paths") + ", status string, paths array<string>"
    over = []
    while front.limit(1).count():
        each = front.select(*KEY, "target", "reach", "used", F.explode("paths").alias("path")).withColumn("kmer", F.right("path", F.lit(m)))
        exts = places.extensions(each.select("kmer", "reach"), limits.support, limits.leaves)
        # at most ``leaves`` paths a pair
        pairs = each.join(exts, "kmer", "left").groupBy(*KEY, "target", "reach", "used").agg(F.collect_list(F.struct("path", "exts")).alias("open"))
        stepped = durable(pairs.mapInPandas(_leg(m, limits), kind), "stepped")
        over.append(stepped.filter(F.col("status").isNotNull()).select(*KEY, "status", "used", "paths"))
        front = stepped.filter(F.col("status").isNull()).drop("status")
    nothing = [F.lit(None).cast("string").alias("merged"), F.lit(0).cast("bigint").alias("coverage")]
    rows = [near.select(*KEY, F.lit("overlap").alias("status"), "merged", F.lit(0).cast("bigint").alias("coverage"), F.lit(0).cast("bigint").alias("used"), F.lit(1).cast("bigint").alias("paths"))]
    rows.append(short.select(*KEY, F.lit("short").alias("status"), *nothing, F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("paths")))
    if over:
        ended = reduce(DataFrame.unionAll, over)
        paths = durable(ended.filter(F.col("status") == "merged").select(*KEY, "used", F.explode("paths").alias("path")), "arrived")
        best = paths.join(coverage(paths, counts, m), [*KEY, "path"]).groupBy(*KEY).agg(F.min_by(F.struct("path", "coverage"), F.struct(-F.col("coverage"), "path")).alias("b"), F.max("used").alias("used"), F.count("*").alias("paths"))
        rows.append(best.select(*KEY, F.lit("merged").alias("status"), F.col("b.path").alias("merged"), "b.coverage", "used", "paths"))
        rows.append(ended.filter(F.col("status") != "merged").select(*KEY, "status", *nothing, "used", F.lit(0).cast("bigint").alias("paths")))
    return reduce(DataFrame.unionByName, rows)


# -- pairs ----------------------------------------------------------------------


def repeat_cutoff(reads: DataFrame, m: int) -> DataFrame:
    """cutoff: one row, 1.3 times the median count of the reads' m-mers, each as often as it occurs, rounded down."""
    seen = kmers.histogram(reads, m).withColumn("times", F.col("count") * F.col("kmers"))
    return kmers.median_cutoff(seen, "count", "times").select(F.col("repeat_cutoff").alias("cutoff"))


def trimmed(pairs: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """pair_id, mate (1, 2), seq of both mates (pair_id, first, second) without dead ends; ``near``: kmer, out_degree, in_degree."""
    mates = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.col("first").alias("seq")), F.struct(F.lit(2).alias("mate"), F.col("second").alias("seq")))).alias("x"))
    mates = mates.select(F.struct("pair_id", "x.mate").alias("id"), "x.seq")
    return kmers.trim_by(mates, near, k).select("id.pair_id", "id.mate", "seq")


def both(mates: DataFrame) -> DataFrame:
    """pair_id, first, second of mates (pair_id, mate, seq)."""
    return mates.groupBy("pair_id").agg(F.max(F.when(F.col("mate") == 1, F.col("seq"))).alias("first"), F.max(F.when(F.col("mate") == 2, F.col("seq"))).alias("second"))


def unique_ends(pairs: DataFrame, places: Places, cutoff: DataFrame, whole: bool) -> DataFrame:
    """Pairs (first, second) of mates with at least m bases whose first m bases, or ``whole`` sequences, occur less often than ``cutoff``."""
    m = places.m
    rows = pairs.filter((F.length("first") >= m) & (F.length("second") >= m))
    cut = (lambda name: F.col(name)) if whole else (lambda name: F.left(name, F.lit(m)))
    n = durable(places.occurrences(rows.select(cut("first").alias("seq")).unionAll(rows.select(cut("second").alias("seq")))), "occurrences")
    for name in ("first", "second"):
        rows = rows.withColumn("seq", cut(name)).join(n.withColumnRenamed("n", f"n_{name}"), "seq", "left").drop("seq")
    few = lambda name: F.coalesce(f"n_{name}", F.lit(0)) < F.col("cutoff")
    return rows.crossJoin(F.broadcast(cutoff)).filter(few("first") & few("second")).drop("n_first", "n_second", "cutoff")


def ways(pairs: DataFrame, m: int, share: float, most_overlap: int) -> DataFrame:
    """Both walks of a pair: from the first m bases of either mate to those of the other, reverse complemented. Needs size, the mates' mean length before trimming."""
    most = F.lit(most_overlap) if most_overlap else F.floor(F.col("size") * share)
    one, two = F.left("first", F.lit(m)), F.left("second", F.lit(m))
    way = lambda n, a, b: F.struct(F.lit(n).alias("way"), a.alias("source"), dna.revcomp(b).alias("target"))
    return pairs.select("pair_id", most.cast("int").alias("most_overlap"), F.explode(F.array(way(1, one, two), way(2, two, one))).alias("x")).select("pair_id", "x.*", "most_overlap")


def arbitrated(walks: DataFrame, hybrid: bool) -> DataFrame:
    """pair_id, merged of pairs on which both walks agree.

    A single success counts if neither walk ever had more than one path open.
    Two successes count if one is the other's reverse complement (``hybrid``) or
    as long as the other; that of more coverage is taken, the second on a tie.
    Without ``hybrid`` the result must be longer than most_overlap.
    """
    one, two = (F.max(F.when(F.col("way") == w, F.struct("merged", "coverage", "used", "most_overlap"))).alias(f"w{w}") for w in (1, 2))
    rows = walks.groupBy("pair_id").agg(one, two, F.max("used").alias("used"))
    a, b = F.col("w1.merged"), F.col("w2.merged")
    single = F.when(a.isNotNull() & b.isNull(), a).when(a.isNull() & b.isNotNull(), b)
    better = F.when(F.col("w1.coverage") > F.col("w2.coverage"), a).otherwise(b)
    agree = a == dna.revcomp(b) if hybrid else F.length(a) == F.length(b)
    merged = F.when(single.isNotNull() & (F.col("used") <= 1), single).when(agree, better)
    rows = rows.select("pair_id", merged.alias("merged"), F.col("w1.most_overlap").alias("most_overlap")).filter(F.col("merged").isNotNull())
    return (rows if hybrid else rows.filter(F.length("merged") > F.col("most_overlap"))).select("pair_id", "merged")


def pieces(mates: DataFrame, reads: DataFrame, near: DataFrame, k: int, strong: int) -> DataFrame:
    """pair_id, mate, part, seq, main, kept: mates cut where the path through their k-mers isn't simple.

    Two neighbouring k-mers that both strands have ``strong`` times are never
    parted. main: the longest part with such a k-mer, of two k-mers at least.
    kept: neither of low complexity nor a third of it one base.
    """
    rows = mates.select(F.struct("pair_id", "mate").alias("id"), "seq")
    counts = kmers.strand_counts(reads, k).filter((F.col("fw") >= strong) & (F.col("rv") >= strong)).select("canon", F.lit(True).alias("strong"))
    spots = kmers.explode(rows, k, "id").withColumn("canon", dna.canonical("kmer")).join(counts, "canon", "left").join(near, "kmer")
    spots = spots.select("id", "pos", "in_degree", "out_degree", F.coalesce("strong", F.lit(False)).alias("strong"))
    order = Window.partitionBy("id").orderBy("pos")
    joined = (F.col("strong") & F.lag("strong").over(order)) | ((F.lag("out_degree").over(order) == 1) & (F.col("in_degree") == 1))
    spots = spots.withColumn("cut", F.when(joined, 0).otherwise(1)).withColumn("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = spots.groupBy("id", "part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.bool_or("strong").alias("strong"))
    span = F.col("last") - F.col("first")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.when(F.col("strong"), span).otherwise(0)), "part"))
    parts = parts.withColumn("main", (best == 1) & F.col("strong") & (span > 0))
    found = parts.join(rows, "id").withColumn("seq", dna.substr("seq", F.col("first") + 1, span + k))
    kept = ~dna.low_complexity("seq") & (dna.longest_run("seq") * 3 <= F.length("seq"))
    return found.select("id.pair_id", "id.mate", F.col("part").cast("bigint").alias("part"), "seq", "main", kept.alias("kept"))


class Merger:
    """What the ways of merging pairs (pair_id, name1, first, name2, second) share: tables of the reads (idx, id, seq), among which the mates' k-mers are."""

    def __init__(self, pairs: DataFrame, reads: DataFrame, limits: Limits = Limits(), k: int = 31, strong: int = 3):
        self.limits, self.k, self.strong = limits, k, strong
        self.pairs, self.reads = durable(pairs, "pairs"), durable(reads.select("idx", "id", "seq"), "reads")
        self.near = durable(kmers.neighbours(self.reads, k), "near")
        self.mates = durable(trimmed(self.pairs, self.near, k), "mates")
        self.places = Places(self.reads, limits.seed)
        self.counts = durable(kmers.strand_counts(self.reads, limits.seed), "counts")

    def _merged(self, hybrid: bool) -> DataFrame:
        m = self.limits.seed
        sizes = self.pairs.select("pair_id", ((F.length("first") + F.length("second")) / 2).cast("int").alias("size"))
        fit = unique_ends(both(self.mates), self.places, repeat_cutoff(self.reads, m), not hybrid).join(sizes, "pair_id")
        ends = durable(ways(fit, m, 0.95 if hybrid else 0.9, self.limits.most_overlap), "ways")
        walks = walk(ends, self.places, self.counts, self.limits).join(ends.select(*KEY, "most_overlap"), KEY)
        return durable(arbitrated(walks, hybrid), "merged")

    def walks(self) -> DataFrame:
        """Both walks of all pairs whose mates are long enough, repeats or not."""
        sizes = self.pairs.select("pair_id", ((F.length("first") + F.length("second")) / 2).cast("int").alias("size"))
        return walk(ways(both(self.mates).join(sizes, "pair_id"), self.limits.seed, 0.95, self.limits.most_overlap), self.places, self.counts, self.limits)

    def merge_only(self) -> tuple[DataFrame, DataFrame]:
        """Merged pairs (id, seq) and counters."""
        merged = self._merged(False)
        return self._named(merged), self._counted(merged, None)

    def hybrid(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Merged pairs (id, seq), the parts of the mates of other pairs (id, seq), and counters."""
        merged = self._merged(True)
        left = self.mates.join(merged, "pair_id", "left_anti").filter(F.length("seq") >= self.k)
        cut = durable(pieces(left, self.reads, self.near, self.k, self.strong), "pieces")
        turn = F.row_number().over(Window.partitionBy("pair_id", "mate", "main").orderBy("part")) - 1
        names = self.pairs.select("pair_id", F.explode(F.create_map(F.lit(1), "name1", F.lit(2), "name2")).alias("mate", "name"))
        kept = cut.filter("kept").withColumn("turn", turn).join(names, ["pair_id", "mate"])
        named = F.when(F.col("main"), F.col("name")).otherwise(F.concat_ws(":", "name", F.col("turn").cast("string")))
        return self._named(merged), kept.select(named.alias("id"), "seq"), self._counted(merged, cut)

    def _named(self, merged: DataFrame) -> DataFrame:
        """A merged pair has the first mate's name up to its first slash."""
        return merged.join(self.pairs, "pair_id").select(F.substring_index("name1", "/", 1).alias("id"), F.col("merged").alias("seq"))

    def _counted(self, merged: DataFrame, cut: DataFrame | None) -> DataFrame:
        """merged (pairs), kmerized and failed (mates): one row."""
        rows = self.mates.join(merged.withColumn("merged", F.lit(True)), "pair_id", "left")
        if cut is None:
            rows = rows.withColumn("parts", F.lit(None).cast("boolean"))
        else:
            rows = rows.join(cut.select("pair_id", "mate", F.lit(True).alias("parts")).distinct(), ["pair_id", "mate"], "left")
        alone = F.col("merged").isNull()
        return rows.agg(F.count_if(~alone & (F.col("mate") == 1)).alias("merged"), F.count_if(alone & F.col("parts").isNotNull()).alias("kmerized"), F.count_if(alone & F.col("parts").isNull()).alias("failed"))
