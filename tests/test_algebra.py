"""Ranks, match algebra, excision, similar reads and pair sinks against brute force and laws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import match as M
from strandloom.operators import correct as C, excise as X, graph as G, kmers as K, preprocess as P, ranks, similar as S


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_ranks_and_prefixes(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("AC") for _ in range(rng.randint(0, 6)))) for i in range(500)]
    got = ranks.ranked(spark.createDataFrame(rows, "idx long, seq string").repartition(7))
    order = {i: r for r, (_, i) in enumerate(sorted((s, i) for i, s in rows))}
    assert {r.idx: r.rank for r in got.collect()} == order
    asked = ["A", "AC", "CCCCCC", "G", "A"]
    found = {r.q: (r.first, r.last, r.n) for r in ranks.prefix_intervals(got, spark.createDataFrame([(q,) for q in asked], "q string")).collect()}
    want = {q: [order[i] for i, s in rows if s.startswith(q)] for q in set(asked)}
    assert found == {q: (min(v), max(v), len(v)) for q, v in want.items() if v}
    piece = ranks.extracted(got, spark.createDataFrame([(499,)], "rank long"), 1, 2).first()
    assert piece.piece == sorted(s for _, s in rows)[-1][1:3]
    assert ranks.ranked(spark.createDataFrame([], "idx long, seq string")).count() == 0


def test_match_laws(spark):
    """Matches between windows of one sequence, some on the other strand."""
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        spans = [sorted(rng.sample(range(40), 2)) for _ in range(3)]
        spans = [(a, b, rng.random() < 0.5) for a, b in spans]
        place = lambda s, lo, hi: (hi, lo) if s[2] else (lo, hi)
        one = (max(spans[0][0], spans[1][0]), min(spans[0][1], spans[1][1]))
        two = (max(spans[1][0], spans[2][0]), min(spans[1][1], spans[2][1]))
        if one[0] > one[1] or two[0] > two[1]:
            continue
        seen = lambda s, c: ((s[1] - c[1], s[1] - c[0]) if s[2] else (c[0] - s[0], c[1] - s[0])) + (s[1] - s[0] + 1,)
        three = (max(one[0], two[0]), min(one[1], two[1]))
        rows.append((*seen(spans[0], one), *seen(spans[1], one), spans[0][2] != spans[1][2], *seen(spans[1], two), *seen(spans[2], two), spans[1][2] != spans[2][2], *(seen(spans[0], three) + seen(spans[2], three) if three[0] <= three[1] else (None,) * 6)))
    assert len(rows) > 60
    names = [f"{m}{s}{k}" for m in "xy" for s in "ab" for k in "sel"]
    fields = names[:6] + ["xr"] + names[6:] + ["yr"] + [f"w{s}{k}" for s in "ac" for k in "sel"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'boolean' if n in ('xr', 'yr') else 'int'}" for n in fields))
    side = lambda m, s: M.interval(*(F.col(f"{m}{s}{k}") for k in "sel"))
    x, y = (M.match(side(m, "a"), side(m, "b"), F.col(f"{m}r"), F.lit(1)) for m in "xy")
    whole = M.compose(x, y)
    df = df.select("*", x.alias("x"), y.alias("y"), whole.alias("z"), M.invert(M.compose(M.invert(y), M.invert(x))).alias("back"), M.expand(x).alias("grown"), M.expand(M.expand(x)).alias("twice"), M.over(M.invert(x), M.over(x, x["a"])).alias("home"), M.complement(x["a"]).alias("rest"))
    for r in df.collect():
        assert (r.z is None) == (r.was is None) and r.z == r.back
        if r.z is not None:
            assert (r.z.a.start, r.z.a.end, r.z.a.len, r.z.b.start, r.z.b.end, r.z.b.len) == (r.was, r.wae, r.wal, r.wcs, r.wce, r.wcl)
            assert r.z.rc == (r.xr != r.yr) and r.z.diffs == 2
        assert r.grown == r.twice and r.home == r.x.a
        g = r.grown
        assert g.a.end - g.a.start == g.b.end - g.b.start and g.a.start <= r.x.a.start and g.a.end >= r.x.a.end
        if r.rest is not None:
            assert r.rest.end - r.rest.start + 1 + r.x.a.end - r.x.a.start + 1 == r.x.a.len


def test_excision_keeps_paths(spark):
    genome = "".join(random.Random(3).choice("ACGT") for _ in range(160))
    at = list(range(0, 130, 5))
    seqs = {i: genome[p : p + 30] for i, p in enumerate(at)}
    arcs = [(2 * i, 2 * j, 30 - (at[j] - at[i])) for i in seqs for j in seqs if j == i + 1]
    vertices = spark.createDataFrame([(i, s, 1) for i, s in seqs.items()], "v long, seq string, cov long")
    both = G.with_twins(spark.createDataFrame(arcs, "a long, b long, size int"))
    gone = {1, 2, 5, 9, 10, 11, 12, 13, 14, 20}
    left, found = X.excise(vertices, both, spark.createDataFrame([(v,) for v in gone], "v long"), 8)
    kept = [v for v in seqs if v not in gone]
    want = {(2 * i, 2 * j, 30 - (at[j] - at[i])) for i, j in zip(kept, kept[1:]) if 30 - (at[j] - at[i]) >= 8}
    want |= {(2 * j + 1, 2 * i + 1, n) for i, j, n in [(a // 2, b // 2, n) for a, b, n in want]}
    assert {tuple(r) for r in found.collect()} == want and sorted(r.v for r in left.collect()) == kept


def distance(a, b):
    now = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, now[0] = now[0], i
        for j, y in enumerate(b, 1):
            before, now[j] = now[j], min(now[j] + 1, now[j - 1] + 1, before + (x != y))
    return now[-1]


@pytest.mark.parametrize("band", [1, 3, 6])
def test_banded_distances(band):
    rng = random.Random(band)
    pairs = [("", ""), ("A", "C"), ("ACGT", "CGTA"), ("A" * 9, "A" * 9)]
    for _ in range(300):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = [rng.choice("ACGT") for _ in range(rng.randint(0, 2))]
        b = ("".join(b) + "ACGT" * 10)[: len(a)]
        pairs.append((a, b))
    got = S.banded([a for a, _ in pairs], [b for _, b in pairs], band)
    want = np.array([distance(a, b) for a, b in pairs])
    assert ((got == want) | ((want > band) & (got >= want))).all() and (got[want <= band] == want[want <= band]).all()


def test_similar_reads(spark):
    rng = random.Random(8)
    genome = "".join(rng.choice("ACGT") for _ in range(200))
    seqs = []
    for p in range(0, 160, 6):
        s = genome[p : p + 40]
        if p % 4 == 0:
            s = s[:10] + rc(s[10]) + s[11:]
        seqs.append(rc(s) if p % 5 == 0 else s)
    got = {(r.a, r.b, r.strand): (r.size, r.differences) for r in S.similar(spark.createDataFrame(list(enumerate(seqs)), "idx long, seq string"), 9, 2, 50, 0.9).collect()}
    assert got
    for (a, b, strand), (size, differences) in got.items():
        one, two = seqs[a], rc(seqs[b]) if strand else seqs[b]
        fits = [distance(x, y) for d in range(-39, 40) for x, y in [(one[max(d, 0) :][: min(40 - max(d, 0), 40 - max(-d, 0))], two[max(-d, 0) :][: min(40 - max(d, 0), 40 - max(-d, 0))])] if len(x) == size]
        assert differences in fits and differences * 10 <= size and size * 2 >= 40
        assert (b, a, strand) in got  # reads are equally long, so likeness goes both ways
    starts = list(range(0, 160, 6))
    near = {(i, j) for i in range(len(seqs)) for j in range(len(seqs)) if i != j and abs(starts[i] - starts[j]) <= 12}
    assert near <= {(a, b) for a, b, _ in got}


def test_pair_sinks(spark):
    good, short = "ACGTTGCAAC" * 5, "ACG"
    rows = [(0, "a", good, [], "a", good, []), (1, "b/1", good, [], "b/2", short, []), (2, "c", short, [], "c", short, []), (3, None, good, [], "d", good, [])]
    df = spark.createDataFrame(rows, "pair_id long, name1 string, seq1 string, scores1 array<int>, name2 string, seq2 string, scores2 array<int>")
    paired, orphans = P.pair_sinks(P.named_pairs(df, "_s"), P.Options())
    assert sorted((r.pair_id, r.id) for r in paired.collect() if r.pair_id == 0) == [(0, "a_s/1"), (0, "a_s/2")] and {r.pair_id for r in paired.collect()} == {0, 3}
    assert [(r.pair_id, r.id) for r in orphans.collect()] == [(1, "b/1")]
    many = spark.range(400).select(F.col("id").alias("pair_id"), *[c for n in (1, 2) for c in (F.lit("x").alias(f"name{n}"), F.lit(good).alias(f"seq{n}"), F.array().cast("array<int>").alias(f"scores{n}"))])
    paired, orphans = P.pair_sinks(P.named_pairs(many), P.Options(sample=0.5))
    assert orphans.count() == 0 and 300 < paired.count() < 500


def test_learned_threshold_of_a_histogram(spark):
    rows = [(1, 1000), (2, 200), (3, 60), (4, 40), (5, 70), (6, 200), (7, 400), (8, 300)]
    got = K.learned_threshold(spark.createDataFrame(rows, "count long, kmers long")).first()
    edge = got.threshold
    assert edge > 0 and got.weak == sum(n for c, n in rows if c < edge) and got.solid == sum(n for c, n in rows if c >= edge)


def test_second_overlaps_and_ratios(spark):
    arcs = spark.createDataFrame([(0, 2, 9), (0, 4, 9), (0, 6, 5), (2, 4, 7), (4, 0, 3), (4, 2, 2)], "a long, b long, size int")
    assert {r.a: (r.longest, r.second) for r in G.overlap_ranks(arcs).collect()} == {0: (9, 9), 2: (7, None), 4: (3, 2)}
    vertices = spark.createDataFrame([(v, "A" * 10, 1) for v in range(4)], "v long, seq string, cov long")
    assert {r.bin: r.arcs for r in G.ratio_stats(vertices, arcs).collect()} == {9: 2, 5: 1, 7: 1, 3: 1, 2: 1}


def plain_consensus(root, rows, least, cutoff):
    """Column by column, with counters."""
    at = lambda row, i: row[1][i - row[0]] if 0 <= i - row[0] < len(row[1]) else None
    columns = [[root[i]] + [b for b in (at(r, i) for r in rows) if b] for i in range(len(root))]
    many = lambda column, b: column.count(b)
    second = [sorted(many(c, b) for b in "ACGT")[-2] for c in columns]
    conflict = [s > cutoff and many(c, root[i]) > cutoff for i, (c, s) in enumerate(zip(columns, second))]
    left = [r for r in rows if not any(conflict[i] and at(r, i) and at(r, i) != root[i] for i in range(len(root)))]
    out = []
    for i, b in enumerate(root):
        near = [b] + [x for x in (at(r, i) for r in left) if x]
        best = max("ACGT", key=lambda x: (many(near, x), -ord(x)))
        most = max("ACGT", key=lambda x: (many(columns[i], x), -ord(x)))
        if many(near, b) >= least:
            out.append(b)
        elif many(near, best) > many(near, b):
            out.append(best)
        elif second[i] <= cutoff and many(columns[i], most) > many(near, b):
            out.append(most)
        else:
            out.append(b)
    return "".join(out)


def test_conflict_consensus():
    rng = random.Random(9)
    changed = 0
    for _ in range(300):
        one = [rng.choice("ACGT") for _ in range(24)]
        two = list(one)
        two[11] = rc(two[11])
        pile = []
        for _ in range(rng.randint(0, 12)):
            row = list(rng.choice([one, two]))
            if rng.random() < 0.5:
                row[rng.randrange(24)] = rng.choice("ACGT")
            shift = rng.randint(-8, 8)
            pile.append((shift, "".join(row[max(0, shift) :] if shift > 0 else row[-shift:]) if shift else "".join(row)))
            pile[-1] = (max(0, shift), "".join(row[max(0, shift) : 24 + min(0, shift)]))
        root = list(one)
        root[rng.randrange(24)] = rng.choice("ACGT")
        root, least, cutoff = "".join(root), rng.randint(1, 4), rng.randint(0, 3)
        got = C.conflict_consensus(root, pile, least, cutoff)
        assert got == plain_consensus(root, pile, least, cutoff)
        changed += got != root
    assert changed > 30


def test_overlap_correction_mends_errors(spark):
    rng = random.Random(10)
    genome = "".join(rng.choice("ACGT") for _ in range(300))
    reads, wrong = [], {}
    for i, p in enumerate(range(0, 240, 6)):
        s = genome[p : p + 60]
        if i % 7 == 3:
            s = s[:30] + rc(s[30]) + s[31:]
            wrong[i] = genome[p : p + 60]
        reads.append((i, rc(s) if i % 4 == 1 else s))
        if i in wrong and i % 4 == 1:
            wrong[i] = rc(wrong[i])
    got = {r.idx: r.seq for r in C.overlap_correct(spark.createDataFrame(reads, "idx long, seq string"), 15, 0.9, 3, 3).collect()}
    assert all(got[i] == s for i, s in wrong.items()) and all(got[i] == s for i, s in reads if i not in wrong) and len(got) == len(reads)
