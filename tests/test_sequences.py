"""Hand-checked values, brute force and properties of the sequence operators."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import correct, graph as G, kmers as K, overlap as O, preprocess as P, qc, walk
from strandloom.operators.components import components
from strandloom.plans import assembly
from strandloom.sources import records
from strandloom.streaming import lookup

GENOME = "ACGTTGCAAGTCCGATAGGCTTAC"
READS = {"r0": "ACGTTGCAAG", "r1": "TTGCAAGTCC", "r2": "CAAGTCCGAT", "r3": "GTCCGATAGG", "r4": "CGATAGGCTT", "r5": "ATAGGCTTAC", "r6": "ATCGGACTTG", "r7": "TGCAAGT"}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def reads(spark, seqs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(seqs.items())], "idx long, id string, seq string")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<int>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("s, dust, gc, run", [("AAAAAAAAAA", 2.625, 0.0, 10), ("ACACACACAC", 1.125, 0.5, 1), ("AATTTTTTTTTTTCCC", 2.571428, 0.1875, 11), ("ACGTTGCAAGTC", 0.0, 0.5, 2), ("AC", 0.0, 0.5, 1), ("", 0.0, None, 0)])
def test_scores(spark, s, dust, gc, run):
    assert one(spark, dna.dust("s"), s=s) == pytest.approx(dust, abs=1e-6)
    assert one(spark, dna.gc("s"), s=s) == gc
    assert one(spark, dna.longest_run("s"), s=s) == run
    assert one(spark, dna.revcomp("s"), s=s) == rc(s)


@pytest.mark.parametrize("q, kept", [([30, 30, 10, 25, 5, 2], 2), ([30, 30, 30, 30], 4), ([2, 2, 2, 2], 0), ([30, 10, 30, 19], 3), ([], 0)])
def test_soft_clip(spark, q, kept):
    assert one(spark, dna.soft_clip("q", 20), q=q) == kept


def test_small_functions(spark):
    assert one(spark, dna.iupac_revcomp("s"), s="ACGTRYkmN") == "NkmRYACGT"
    assert one(spark, dna.expand_cigar("s"), s="3M1I2D") == "MMMIDD" and one(spark, dna.compact_cigar("s"), s="MMMIDD") == "3M1I2D"
    assert one(spark, dna.phred64_to_33("s"), s="@h") == "!I"
    assert one(spark, dna.has_primer("s"), s="") and one(spark, dna.has_primer("s"), s="AATGATACGGCGACCTTT") and not one(spark, dna.has_primer("s"), s="ACACACACACACACAC")
    assert one(spark, dna.mate_id("s"), s="x/1") == "x/2" and one(spark, dna.base_name("s"), s="a/b/1") == "a/b" and one(spark, dna.mate_id("s"), s="x") == ""
    made = one(spark, dna.resolve_ambiguous("s", F.lit("k")), s="ANR.C")
    assert len(made) == 5 and set(made) <= set("ACGT") and made[0] == "A" and made[2] in "AG" and made == one(spark, dna.resolve_ambiguous("s", F.lit("k")), s="ANR.C")
    assert one(spark, dna.max_dust("s"), s="A" * 70) > one(spark, dna.max_dust("s"), s="ACGT" * 20)
    assert dna.file_stem("a/b.fq.gz") == "b"
    with pytest.raises(Exception, match="quality outside"):
        one(spark, dna.phred64_to_33("s"), s="!")


def test_redundancy(spark):
    frame = reads(spark, READS)
    kept = {r.id: r.kept for r in qc.duplicates(frame).collect()}
    assert kept == {k: k != "r6" for k in READS}
    assert [r.id for r in qc.contained(frame, 7).collect()] == ["r7"]
    again = qc.unique_reads(qc.unique_reads(frame))
    assert {r.id for r in again.collect()} == set(READS) - {"r6"}


def test_counts(spark):
    got = {r.kmer: (r.same, r.revc) for r in K.located(reads(spark, READS), 5, "id").collect()}
    assert got["ACGTT"] == (1, 0) and got["TTGCA"] == (2, 3) and got["TGCAA"] == (3, 2) and got["GCAAG"] == (3, 0)
    row = spark.createDataFrame([(c, 1) for c in (1, 2, 3, 4, 5, 6, 9)] + [(1, 1)], "count long, kmers long").groupBy("count").agg(F.sum("kmers").alias("kmers"))
    m = K.median_cutoff(row).first()
    assert (m.median, m.repeat_cutoff) == (4, 5) and m.std == pytest.approx(2.75162, abs=1e-5)
    palindrome = K.strand_counts(reads(spark, {"a": "ACGT"}), 4).first()
    assert (palindrome.fw, palindrome.rv) == (1, 1)


def base_graph(spark, names="r0 r1 r2 r3 r4 r5"):
    frame = reads(spark, {k: READS[k] for k in names.split()})
    sizes = O.lengths(frame)
    return frame, O.exact(frame, 5), sizes


def test_overlaps_and_unitig(spark):
    frame, found, sizes = base_graph(spark)
    pairs = {(r.a, r.b, 10 - r.size) for r in found.collect()}
    forward = {(0, 1, 3), (1, 2, 3), (2, 3, 3), (3, 4, 3), (3, 5, 5), (4, 5, 2)}
    assert {p for p in pairs if not p[0] % 2 and not p[1] % 2} == {(2 * a, 2 * b, o) for a, b, o in forward}
    assert pairs == {(b ^ 1, a ^ 1, o) for a, b, o in pairs}
    kept = O.irreducible(found, sizes)
    assert {(r.a, r.b) for r in kept.collect() if not (r.a | r.b) % 2} == {(2 * a, 2 * b) for a, b, _ in forward if (a, b) != (3, 5)}
    merged, arcs = G.compact(frame.select(F.col("idx").alias("v"), "seq", F.lit(1).cast("long").alias("cov")), kept)
    [u] = merged.collect()
    assert u.seq in (GENOME, rc(GENOME)) and u.members == 6 and u.cov == 6 and arcs.count() == 0


def test_circle_becomes_one_unitig(spark):
    ring = "ACGTTGCAAGTCCGATAGGCTTAGGATCCA"
    twice = ring + ring
    frame = reads(spark, {f"c{i}": twice[i : i + 16] for i in range(0, 30, 6)})
    found = O.irreducible(O.exact(frame, 9), O.lengths(frame))
    merged, _ = G.compact(frame.select(F.col("idx").alias("v"), "seq", F.lit(1).cast("long").alias("cov")), found)
    [u] = merged.collect()
    assert u.members == 5 and (u.seq[:30] in twice or rc(u.seq)[:30] in twice)


def test_fanout_cap(spark):
    arcs = spark.createDataFrame([(0, i, 90) for i in range(10, 40)] + [(0, i, 80) for i in range(40, 90)] + [(0, 99, 70), (2, 10, 95), (2, 12, 40), (4, 10, 60), (4, 12, 8)], "a long, b long, size int")
    left = O.fanout_cap(arcs, spark.createDataFrame([(0, 100), (2, 100), (4, 100)], "node long, len int")).collect()
    assert {(r.a, r.size) for r in left} == {(0, 90), (2, 95), (2, 40), (4, 60), (4, 8)}


def test_inexact_finds_mismatches(spark):
    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(100))
    b = a[40:] + "".join(rng.choice("ACGT") for _ in range(40))
    b = b[:20] + ("A" if b[20] != "A" else "C") + b[21:]
    found = {(r.a, r.b): (r["size"], r.differences) for r in O.inexact(reads(spark, {"a": a, "b": b}), 45, 0.04).collect()}
    assert found[0, 2] == (60, 1)


def test_graph_visitors(spark):
    vertices = spark.createDataFrame([(0, "A" * 300, 5, 300), (1, "C" * 40, 2, 40), (2, "G" * 300, 9, 300), (3, "T" * 41, 7, 41), (4, "A" * 20, 1, 20)], "v long, seq string, cov long, origin int")
    arcs = G.with_twins(spark.createDataFrame([(0, 2, 15), (2, 4, 15), (0, 6, 15), (6, 4, 15)], "a long, b long, size int"))
    s = G.stats(vertices, arcs).first()
    assert (s.vertices, s.edges, s.islands, s.tips, s.monobranch, s.straight) == (5, 8, 1, 2, 2, 2)
    assert {r.v for r in G.short_ends(vertices, arcs, 100).collect()} == {4}
    assert {r.v for r in G.bubbles(vertices, arcs).collect()} == {1}
    left, kept = G.drop_vertices(vertices, arcs, G.bubbles(vertices, arcs))
    assert left.count() == 4 and kept.count() == 4
    assert {r.v for r in G.neighbourhood(arcs, spark.createDataFrame([(0,)], "v long"), 1).collect()} == {0, 1, 3}
    assert {r.root for r in components(arcs.select(G.vertex("a").alias("a"), G.vertex("b").alias("b"))).collect()} == {0}
    n = G.contiguity(spark.createDataFrame([(x,) for x in (1000, 900, 800, 700, 600, 500, 10)], "len int")).first()
    assert (n.total, n.n20, n.n50, n.n80, n.contigs) == (4500, 1000, 800, 600, 6)


def test_preprocess_order(spark):
    rows = [("ok", "ACGTTGCAAGTCCGATAGGCTTACACGATTAGC", 33), ("short", "ACGT", 4), ("n", "ACGTNACGTACGTAGCATCGACTAGCATCAGCT", 33), ("gc", "A" * 20 + "T" * 20, 40), ("cut", "ACGTTGCAAGTCCGATAGGCTTACACGATTAGC" + "GATTACA" + "CC", 42)]
    frame = spark.createDataFrame([(i, n, s, [30] * k) for i, (n, s, k) in enumerate(rows)], "idx long, id string, seq string, scores array<int>")
    got = {r.id: (r.fate, r.seq, len(r.scores)) for r in P.process(frame, P.Options(adapter=("GATTACA", "TTTTTTTTTTTTT"), gc=(0.2, 0.8))).collect()}
    assert got["ok"][0] == "kept" and got["short"][0] == "length" and got["n"][0] == "alphabet" and got["gc"][0] == "gc"
    assert got["cut"] == ("kept", rows[0][1] + "CC", 35)


def test_correction(spark):
    rng = random.Random(1)
    truth = "".join(rng.choice("ACGT") for _ in range(60))
    wrong = truth[:30] + ("A" if truth[30] != "A" else "C") + truth[31:]
    frame = reads(spark, {**{f"t{i}": truth for i in range(6)}, "w": wrong})
    got = {r.id: r.seq for r in correct.correct(frame, 15, 4).collect()}
    assert set(got.values()) == {truth}
    roots = spark.createDataFrame([(1, wrong)], "root long, seq string")
    piles = correct.pileup(spark.createDataFrame([(1, 0, truth), (1, 0, truth), (1, 0, wrong)], "root long, offset int, seq string"))
    assert "".join(r.called for r in correct.consensus(piles, roots).orderBy("pos").collect()) == truth


def test_pairs(spark):
    pair = spark.createDataFrame([(1, GENOME[:16], rc(GENOME[8:])), (2, GENOME[:8], rc(GENOME[12:]))], "pair_id long, first string, second string")
    assert [(r.pair_id, r.merged) for r in walk.overlapped(pair, 6).collect()] == [(1, GENOME)]
    frame, found, sizes = base_graph(spark)
    got = walk.walks(spark.createDataFrame([(7, 0, 10)], "pair_id long, a long, b long"), O.irreducible(found, sizes), O.oriented(frame), 6, 100).first()
    assert got.merged == GENOME
    links = walk.support(spark.createDataFrame([(1, 10), (2, 20), (3, 10), (4, 20)], "r long, v long"), spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "r1 long, r2 long"))
    assert [tuple(r) for r in links.collect()] == [(10, 20, 2)]


@pytest.mark.parametrize("compressed", [True, False])
def test_records_round_trip(spark, tmp_path, compressed):
    rows = spark.createDataFrame([("a", "ACGT", "IIII"), ("b", "GG", None), ("c", "TTT", "###")], "id string, seq string, qual string")
    records.write(rows.filter("qual is not null"), str(tmp_path / "q"), compressed)
    got = records.read_files(spark, str(tmp_path / "q"))
    assert sorted((r.id, r.seq, r.qual) for r in got.collect()) == [("a", "ACGT", "IIII"), ("c", "TTT", "###")]
    assert sorted(r.idx for r in got.collect()) == [0, 1]


def test_fasta_quirks(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nacgt\nAC\n>two\nGG")  # no final newline
    assert [(r.idx, r.id, r.seq) for r in records.read_files(spark, str(tmp_path / "x.fa")).orderBy("idx").collect()] == [(0, "one", "ACGTAC"), (1, "two", "GG")]
    assert sorted((r.id, r.seq) for r in records.scan_fasta(spark, str(tmp_path / "x.fa"), False).collect()) == [("one", "acgtAC"), ("two", "GG")]
    (tmp_path / "e.fa").write_text("")
    assert records.read_files(spark, str(tmp_path / "e.fa")).count() == 0
    (tmp_path / "p.fq").write_text("@a/1\nAC\n+\nII\n@a/2\nGT\n+\nII\n@odd\nA\n+\nI\n")
    assert [(r.pair_id, r.first.id, r.second.id) for r in records.interleaved(records.read_files(spark, str(tmp_path / "p.fq"))).collect()] == [(0, "a/1", "a/2")]


def test_graph_file_round_trip(spark):
    frame, found, sizes = base_graph(spark)
    arcs = G.with_twins(O.irreducible(found, sizes))
    lines = records.graph_lines(frame.withColumnRenamed("idx", "v"), O.emitted(arcs), 5).select(F.col("line").alias("value"))
    head, vertices, edges = records.parse_graph(lines)
    assert head.first().ol == 5 and vertices.count() == 6 and edges.count() == 5
    for e in edges.collect():
        s, t = READS[e.id0][e.s0 : e.e0 + 1], READS[e.id1][e.s1 : e.e1 + 1]
        assert s == (rc(t) if e.is_rc else t) and e.l0 == 10


def test_streaming_lookup(spark, tmp_path):
    counts = K.strand_counts(reads(spark, READS), 5)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.txt").write_text("TTGCAA\nACG\n")
    stream = lookup.kmer_lookup(spark.readStream.text(str(tmp_path / "q")).withColumnRenamed("value", "q"), counts, 5)
    job = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    assert sorted((r.pos, r.kmer, r.same, r.revc) for r in spark.table("found").collect()) == [(0, "TTGCA", 2, 3), (1, "TGCAA", 3, 2)]


def test_assembly_rebuilds_a_genome(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(600))
    seqs = {f"x{i}": genome[i : i + 100] if i % 4 else rc(genome[i : i + 100]) for i in range(0, 501, 10)}
    frame = reads(spark, seqs).withColumn("scores", F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.lit(30)))
    found, _ = assembly.assemble(frame, assembly.Settings(support=1, least_overlap=60, insert=120))
    [c] = found.collect()
    assert c.seq in (genome, rc(genome))


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ACGT", max_size=40))
def test_reverse_complement_is_its_own_inverse(spark, s):
    assert one(spark, dna.revcomp(dna.revcomp("s")), s=s) == s
