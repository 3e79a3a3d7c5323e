"""Read cleaning: one chain of projections, in a fixed order, that gives each read its fate."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions import dna, flat, kernels


@dataclass(frozen=True)
class Options:
    adapter: tuple[str, str] | None = None
    ambiguous: bool = False
    hard_clip: int = 0
    trim: int = 0
    most_low_quality: int = -1
    dust: float | None = None
    gc: tuple[float, float] | None = None
    primer: bool = True
    least_length: int = 31
    sample: float = 1.0
    seed: int = 0


def process(reads: DataFrame, o: Options = Options()) -> DataFrame:
    """Adds ``fate`` ('kept' or the first filter that a read fails) to clipped ``seq`` and ``scores``.

    Order: adapter, ambiguity codes, alphabet, hard clip, soft clip, low
    quality, dust, GC, primer, length, sample.
    """
    rows = reads
    if o.adapter:
        at, size = dna.cut_adapter("seq", *o.adapter)
        rows = rows.withColumns({"at": at, "cut": size})
        rows = rows.withColumns({"seq": dna.erase("seq", F.col("at"), F.col("cut")), "scores": F.when(F.col("at") > 0, F.concat(F.slice("scores", F.lit(1), F.col("at") - 1), F.slice("scores", F.col("at") + F.col("cut"), F.size("scores") + 1))).otherwise(F.col("scores"))}).drop("at", "cut")
    if o.ambiguous:
        rows = rows.withColumn("seq", dna.resolve_ambiguous("seq", "id", o.seed))
    if o.hard_clip:
        rows = rows.withColumns({"seq": F.left("seq", F.lit(o.hard_clip)), "scores": F.slice("scores", 1, o.hard_clip)})
    if o.trim:
        rows = rows.withColumn("keep", dna.soft_clip("scores", o.trim))
        rows = rows.withColumns({"seq": F.left("seq", F.col("keep")), "scores": F.slice("scores", F.lit(1), F.col("keep"))}).drop("keep")
    fate: list[tuple[Column, str]] = [(~dna.only_acgt("seq"), "alphabet")]
    if o.most_low_quality >= 0:
        fate.append((dna.low_quality_bases("scores") > o.most_low_quality, "quality"))
    if o.dust is not None:
        fate.append((dna.dust("seq") >= o.dust, "dust"))
    if o.gc:
        fate.append((~F.coalesce(dna.gc("seq").between(*o.gc), F.lit(False)), "gc"))
    if o.primer:
        fate.append((dna.has_primer("seq"), "primer"))
    fate.append((F.length("seq") < o.least_length, "length"))
    if o.sample < 1:
        fate.append((F.pmod(F.xxhash64("id", F.lit(o.seed)), F.lit(1 << 20)) >= int(o.sample * (1 << 20)), "sample"))
    found = F.lit("kept")
    for bad, name in reversed(fate):
        found = F.when(bad, name).otherwise(found)
    return rows.withColumn("fate", found)


def _shortened(codes: np.ndarray, values: np.ndarray, bounds: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return codes[kept], values[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def fates(seq: pa.Array, scores: pa.Array, o: Options) -> tuple[pa.Array, pa.Array]:
    """Clipped seq and fate of ``process`` for a batch of reads in ASCII without nulls. Ambiguity codes, soft clip and sampling aren't told here."""
    if o.ambiguous or o.trim or o.sample < 1:
        raise ValueError("options that need process")
    codes, bounds = flat.text(seq)
    values = flat.numbers(scores)[0]
    if o.adapter:
        one, two = (pc.find_substring(seq, a).to_numpy(zero_copy_only=False) for a in o.adapter)
        hit = np.flatnonzero((one >= 0) | (two >= 0))
        at = bounds[hit] + np.where(one[hit] >= 0, one[hit], two[hit])
        n = np.where(one[hit] >= 0, len(o.adapter[0]), len(o.adapter[1]))
        kept = np.ones(len(codes), bool)
        for j in range(int(n.max(initial=0))):
            kept[at[n > j] + j] = False
        codes, values, bounds = _shortened(codes, values, bounds, kept)
    if o.hard_clip:
        codes, values, bounds = _shortened(codes, values, bounds, flat.rows(bounds)[1] < o.hard_clip)
    seq, n = flat.strings(codes, bounds), np.diff(bounds)
    count = lambda which: np.diff(np.concatenate([[0], np.cumsum(which)])[bounds])
    fate = [(count(flat.TWO_BITS[codes] > 3) > 0, "alphabet")]
    if o.most_low_quality >= 0:
        fate.append((count(values <= 3) > o.most_low_quality, "quality"))
    if o.dust is not None:
        fate.append((kernels._dust(seq).to_numpy(zero_copy_only=False) >= o.dust, "dust"))
    if o.gc:
        share = count((codes == ord("G")) | (codes == ord("C"))) / np.maximum(n, 1)
        fate.append(((n == 0) | (share < o.gc[0]) | (share > o.gc[1]), "gc"))
    if o.primer:
        heads = {p[i:j] for p in dna.PRIMERS for i in range(len(p)) for j in range(i, min(len(p), i + 14) + 1)}
        fate.append((pc.is_in(pc.utf8_slice_codeunits(seq, 0, 14), pa.array(sorted(heads))).to_numpy(zero_copy_only=False), "primer"))
    fate.append((n < o.least_length, "length"))
    which = np.select([bad for bad, _ in fate], range(len(fate)), len(fate))
    return seq, pa.array([name for _, name in fate] + ["kept"]).take(pa.array(which))


def pair_counts(doc_pair: pa.Array, fate: pa.Array) -> list[pa.Array]:
    """pair_id, mates, kept of reads in a row that are of one pair; parts of what ``summed_pairs`` adds up."""
    key, valid = pc.fill_null(doc_pair, 0).to_numpy(zero_copy_only=False), doc_pair.is_valid().to_numpy(zero_copy_only=False)
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])]))
    kept = pc.equal(fate, "kept").to_numpy(zero_copy_only=False).astype(np.int64)
    return [pa.array(key[edge], mask=~valid[edge]), pa.array(np.diff(np.append(edge, len(key)))), pa.array(np.add.reduceat(kept, edge))]


def counters(processed: DataFrame) -> DataFrame:
    """fate, reads, bases."""
    return processed.groupBy("fate").agg(F.count("*").alias("reads"), F.sum(F.length("seq")).alias("bases"))


def pairs(processed: DataFrame) -> DataFrame:
    """pair_id, mates, kept: what becomes of pairs. Both kept: paired; one: orphan; none: dropped. Needs pair_id."""
    return _with_outcome(processed.groupBy("pair_id").agg(F.count("*").alias("mates"), F.count_if(F.col("fate") == "kept").alias("kept")))


def summed_pairs(counts: DataFrame) -> DataFrame:
    """``pairs`` of counts (pair_id, mates, kept) of some reads of a pair each."""
    return _with_outcome(counts.groupBy("pair_id").agg(F.sum("mates").alias("mates"), F.sum("kept").alias("kept")))


def _with_outcome(found: DataFrame) -> DataFrame:
    return found.withColumn("outcome", F.when((F.col("mates") == 2) & (F.col("kept") == 2), "paired").when(F.col("kept") >= 1, "orphan").otherwise("dropped"))


def named_pairs(pairs: DataFrame, suffix: str = "") -> DataFrame:
    """Mates (pair_id, mate, id, seq, scores) of pairs whose ids are name1 and name2. Mates of one name get ``suffix`` and /1 or /2; others keep theirs."""
    mate = lambda n: F.struct(F.lit(n).alias("mate"), F.when(F.col("name1") == F.col("name2"), F.concat(f"name{n}", F.lit(f"{suffix}/{n}"))).otherwise(F.col(f"name{n}")).alias("id"), F.col(f"seq{n}").alias("seq"), F.col(f"scores{n}").alias("scores"))
    return pairs.select("pair_id", F.explode(F.array(mate(1), mate(2))).alias("x")).select("pair_id", "x.*")


def pair_sinks(mates: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Mates (pair_id, mate, id, seq, scores) of pairs of which both are kept, and the kept ones whose mate isn't. A pair is sampled as one, by its id; an orphan whose pair isn't drawn goes too."""
    drawn = F.lit(True) if o.sample >= 1 else F.pmod(F.xxhash64("pair_id", F.lit(o.seed)), F.lit(1 << 20)) < int(o.sample * (1 << 20))
    rows = process(mates.filter(drawn), replace(o, sample=1.0)).filter(F.col("fate") == "kept").drop("fate")
    whole = rows.groupBy("pair_id").agg(F.count("*").alias("kept")).filter(F.col("kept") == 2).select("pair_id")
    return rows.join(whole, "pair_id", "left_semi"), rows.join(whole, "pair_id", "left_anti")


def sorted_pairs(pairs: DataFrame, suffix: str = "", o: Options = Options()) -> DataFrame:
    """``pair_sinks`` of ``named_pairs`` as one table with ``sink`` (paired, orphan). As a pair is one row, nothing is shuffled."""
    rows = pairs if o.sample >= 1 else pairs.filter(F.pmod(F.xxhash64("pair_id", F.lit(o.seed)), F.lit(1 << 20)) < int(o.sample * (1 << 20)))
    same = F.col("name1") == F.col("name2")
    for n in (1, 2):
        read_id = F.when(same, F.concat(f"name{n}", F.lit(f"{suffix}/{n}"))).otherwise(F.col(f"name{n}"))
        done = process(rows.withColumns({"id": read_id, "seq": F.col(f"seq{n}"), "scores": F.col(f"scores{n}")}), replace(o, sample=1.0))
        rows = done.withColumn(f"mate{n}", F.struct(F.lit(n).alias("mate"), "id", "seq", "scores", (F.col("fate") == "kept").alias("kept"))).drop("id", "seq", "scores", "fate")
    sink = F.when(F.col("mate1.kept") & F.col("mate2.kept"), "paired").otherwise("orphan").alias("sink")
    each = F.explode(F.filter(F.array("mate1", "mate2"), lambda m: m["kept"])).alias("x")
    return rows.select("pair_id", sink, each).select("sink", "pair_id", "x.mate", "x.id", "x.seq", "x.scores")
