"""What goes base by base in batches, against plain Python; overlaps by pieces against all pairs; pairs by documents."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import dna, flat, kernels
from strandloom.operators import overlap as O, preprocess as P, reads as R, sift, walk as W


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_pieces_are_few_and_find_every_overlap(spark):
    rnd = random.Random(5)
    genome = "".join(rnd.choice("ACGT") for _ in range(150)) + "AC" * 60
    seqs = list(dict.fromkeys(s if i % 2 else rc(s) for i, s in enumerate(genome[p : p + rnd.randint(44, 100)] for p in range(0, 200, 3))))
    frame = spark.createDataFrame(list(enumerate(seqs)), "idx long, seq string")
    got = sorted((r.a, r.b, r.size) for r in O.exact(frame, 45).collect())
    both = {2 * i + t: (rc(s) if t else s) for i, s in enumerate(seqs) if len(s) >= 45 for t in (0, 1)}
    assert got == sorted((a, b, n) for a, x in both.items() for b, y in both.items() if a // 2 != b // 2 for n in range(45, min(len(x), len(y))) if x[-n:] == y[:n])
    whole = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(100)),) for _ in range(50)], "seq string")
    assert whole.select(F.size(O._anchors("seq", F.lit(45))).alias("n")).agg(F.avg("n")).first()[0] < 14  # of 56 windows


def test_tails_that_no_head_meets_are_not_sent(spark):
    """F2, F7-F10, F19-F22"""
    rnd = random.Random(6)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(100)) for _ in range(60)]
    seqs += [s[50:] + "".join(rnd.choice("ACGT") for _ in range(50)) for s in seqs[:30]]
    both = O.oriented(spark.createDataFrame(list(enumerate(seqs)), "idx long, seq string"))
    heads = both.select(F.explode(O._anchors(F.left("seq", F.lit(45)), F.lit(45))).alias("x")).select("x.key")
    tails = both.select(F.explode(O._anchors("seq", F.lit(45))).alias("x")).filter("x.first > 0").select("x.key")
    kept = both.select(F.explode(O._tails(45, sift.table(heads, 180))).alias("x")).select("x.key")
    assert kept.count() * 4 < tails.count()
    assert sorted(kept.join(heads.distinct(), "key").collect()) == sorted(tails.join(heads.distinct(), "key").collect())


def test_paths_end_where_no_arc_reaches(spark):
    """F2, F7-F10: two arcs of 50 in a row imply nothing where no arc is farther than 55."""
    chain = [(2 * i, 2 * i + 2, 50) for i in range(50)] + [(0, 4, 100)]
    arcs = spark.createDataFrame(chain, "a long, b long, off int")
    assert [tuple(r) for r in O.paths(arcs).collect()] == [(0, 4, 100)]


def test_small_kernels(spark):
    odd = spark.createDataFrame([("AC", "AG", 0), ("ACG", "A", 3), (None, "A", 1), ("", "", 2), ("né", "nè", 2)], "a string, b string, n int")
    assert [tuple(r) for r in odd.select(dna.hamming("a", "b", F.col("n")), dna.diff_string("a", "b")).collect()] == [(0, ".G"), (2, "."), (None, ""), (0, ""), (1, ".è")]
    assert [tuple(r) for r in odd.select(dna.longest_run("a"), dna.dust("a"), kernels.scores("a")).collect()][2:4] == [(0, None, None), (0, 0.0, [])]
    assert odd.select(dna.expand_cigar(F.lit("3M12I0DxM")).alias("x")).first().x == "MMM" + "I" * 12
    assert odd.select(dna.compact_cigar(F.lit("MMxxI")).alias("x")).first().x == "2M1I"


def test_packed():
    import numpy as np

    text = np.frombuffer(b"ACGTTGCAAGTCCGATAGGCTTACACGTTGCAAGTCCGATAGGCTTAC", np.uint8)
    for k in (1, 2, 5, 12, 31, 32):
        codes = flat.packed(flat.TWO_BITS[text], k)[: len(text) - k + 1]
        words = [text[i : i + k].tobytes().decode() for i in range(len(codes))]
        assert flat.unpacked(codes, k).to_pylist() == words
        assert flat.unpacked(flat.turned(codes, k), k).to_pylist() == [rc(w) for w in words]


@pytest.mark.parametrize("step", [20, 50])
def test_pairs_of_documents(spark, step):
    rnd = random.Random(step)
    docs = [(i // 2, "".join(rnd.choice("acgt") for _ in range(n))) for i, n in enumerate((0, 40, 149, 150, 151, 260, 330, 100))]  # ids come twice
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(R.document_pairs(frame, step).collect()) == sorted(R.paired(R.tiled(frame, 100, step)).collect())


def test_longest_end(spark):
    rows = [(0, "AAAAACCCCCGGGGG", rc("GGGGGTTT")), (1, "ACACACAC", rc("ACACACACAC")), (2, "ACGT", rc("TTTT")), (3, "CCACGT", rc("ACG"))]
    frame = spark.createDataFrame(rows, "pair_id long, first string, second string")
    assert {r.pair_id: (r["size"], r.merged) for r in W.overlapped(frame, 4).collect()} == {0: (5, "AAAAACCCCCGGGGGTTT"), 1: (8, "ACACACACAC")}


def test_pairs_by_sink_without_shuffle(spark):
    rnd = random.Random(9)
    make = lambda: "".join(rnd.choice("ACGT") for _ in range(rnd.choice((80, 89, 90, 100))))
    pairs = spark.createDataFrame([(i, "p", make(), [], "p" if i % 2 else "q", make(), []) for i in range(60)], "pair_id long, name1 string, seq1 string, scores1 array<int>, name2 string, seq2 string, scores2 array<int>")
    o = P.Options(least_length=90)
    whole, alone = P.pair_sinks(P.named_pairs(pairs, "x"), o)
    want = sorted([("paired", *r) for r in whole.select("pair_id", "mate", "id", "seq").collect()] + [("orphan", *r) for r in alone.select("pair_id", "mate", "id", "seq").collect()])
    got = P.sorted_pairs(pairs, "x", o)
    assert sorted(tuple(r) for r in got.select("sink", "pair_id", "mate", "id", "seq").collect()) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
