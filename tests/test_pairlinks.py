"""Pair support of arcs and the joining of dead ends, against counts made one by one on small genomes."""

import random

import pytest

from strandloom.operators import graph as G, kmers as K, matewalk as MW, pairlinks as L

K_, INSERT, READ = 11, 60, 25
turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def sides(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def pairs_of(genome, begin=0):
    return [(begin + i, genome[i : i + READ], turn(genome[i + INSERT - READ : i + INSERT])) for i in range(len(genome) - INSERT + 1)]


def frames(spark, strings, links, pairs):
    vertices = spark.createDataFrame([(v, s, 1) for v, s in strings.items()], "v long, seq string, cov long")
    arcs = G.with_twins(spark.createDataFrame(links, "a long, b long, size int"))
    return vertices, arcs, spark.createDataFrame(pairs, "pair_id long, first string, second string")


def counted(strings, arcs, pairs, most=10**9):
    """Pairs of each arc, by trying all k-mers and all paths."""
    seq = lambda n: strings[n // 2] if n % 2 == 0 else turn(strings[n // 2])
    out = {}

    def grow(nodes, text, far):
        onward = [(b, size) for a, b, size in arcs if a == nodes[-1]]
        if far > 1.5 * INSERT or not onward or nodes[-1] in nodes[:-1]:
            yield nodes, text
            return
        for b, size in onward:
            yield from grow([*nodes, b], text + seq(b)[size:], far + len(seq(b)) - size)

    held = lambda kmer: {(i, m) for i, x, y in pairs for m, s in ((1, x), (2, y)) if kmer in s or turn(kmer) in s}
    for a, b, size in arcs:
        at, half = len(seq(a)) - size - 1, K_ // 2
        near = set().union(*(held(seq(a)[max(0, at - i * half) :][:K_]) for i in range(3)))
        far = set()
        for nodes, text in grow([a], seq(a), 0):
            if len(nodes) > 1 and nodes[1] == b:
                for d in (-half - 1, 0, half + 1):
                    t = max(0, at - half) + INSERT + d
                    if len(text) >= t:
                        far |= {(i, 3 - m) for i, m in held(text[t - K_ : t])}
        out[a, b] = len({i for i, _ in near & far})
    return out


@pytest.fixture(scope="module")
def crossing(spark):
    """Two genomes over one repeat: arcs that go from one to the other have no pairs."""
    rng = random.Random(4)
    repeat = sides(rng, 14)
    one, two = sides(rng, 90) + repeat + sides(rng, 90), sides(rng, 90) + repeat + sides(rng, 90)
    strings = {0: one[:104], 1: one[90:], 2: two[:104], 3: turn(two[90:])}
    links = [(0, 2, 14), (4, 7, 14), (0, 7, 14), (4, 2, 14)]
    return strings, links, pairs_of(one) + pairs_of(two, 1000)


def test_arcs_without_pairs_go(spark, crossing):
    strings, links, pairs = crossing
    vertices, arcs, frame = frames(spark, strings, links, pairs)
    rows = L.edge_support(vertices, arcs, frame, K_, INSERT).collect()
    want = counted(strings, [(r.a, r.b, r.size) for r in rows], pairs)
    assert {(r.a, r.b): r.pairs for r in rows} == want and {r.state for r in rows} == {"judged"}
    left = {(r.a, r.b) for r in L.drop_unsupported(arcs, L.edge_support(vertices, arcs, frame, K_, INSERT)).collect()}
    assert left == {(0, 2), (3, 1), (4, 7), (6, 5)}


def test_wide_and_open_arcs_are_not_judged(spark, crossing):
    strings, links, pairs = crossing
    vertices, arcs, frame = frames(spark, strings, links, [])
    assert {(r.state, r.pairs) for r in L.edge_support(vertices, arcs, frame, K_, INSERT, leaves=1).collect()} == {("open", None)}
    assert {r.pairs for r in L.edge_support(vertices, arcs, frame, K_, INSERT).collect()} == {0}
    assert {(r.state, r.pairs) for r in L.edge_support(vertices, arcs, frame, K_, 17).collect()} == {("wide", None)}
    assert L.edge_support(vertices, arcs.limit(0), frame, K_, INSERT).count() == 0


def test_repeats_tell_nothing(spark, crossing):
    strings, links, pairs = crossing
    vertices, arcs, frame = frames(spark, strings, links, pairs)
    assert {r.pairs for r in L.edge_support(vertices, arcs, frame, K_, INSERT, hits=1).collect()} == {0}


def test_islands_are_joined_in_all_orientations(spark):
    """Both vertices on either strand: the four ways that two dead ends can face each other."""
    rng = random.Random(9)
    genomes = [sides(rng, 230) for _ in range(4)]
    strings = {8: sides(rng, 80)}
    for flip, genome in enumerate(genomes):
        strings[2 * flip] = turn(genome[:90]) if flip & 1 else genome[:90]
        strings[2 * flip + 1] = turn(genome[102:]) if flip & 2 else genome[102:]
    vertices, arcs, frame = frames(spark, strings, [(0, 0, 1)], [p for i, g in enumerate(genomes) for p in pairs_of(g, 1000 * i)])
    arcs, mates = arcs.limit(0), L.mates_of(frame)
    reads = mates.select((mates.pair_id * 2 + mates.mate).alias("idx"), "seq")
    counts = K.strand_counts(reads, K_)
    ends = L.dead_ends(vertices, arcs, 20)
    links = L.end_links(L.end_reads(ends, mates, counts, K_, INSERT, 1000, 5), 2)
    assert sorted(sorted((r.a // 2, r.b // 2)) for r in links.collect()) == [[0, 1], [2, 3], [4, 5], [6, 7]]
    walked = L.walk_links(links, ends, MW.Places(reads, K_), counts, MW.Limits(seed=K_, support=1, most_overlap=20, most_length=100))
    grown, joined = L.join_islands(vertices, arcs, walked, K_)
    merged, none = G.compact(grown, joined)
    found = {min(r.seq, turn(r.seq)) for r in merged.collect()}
    assert none.count() == 0 and found == {min(g, turn(g)) for g in [*genomes, strings[8]]}
    assert grown.columns == vertices.columns and joined.count() == 8


def test_ends_take_only_their_best_link(spark):
    rows = [(0, p, 1) for p in range(9)] + [(2, p, 2) for p in range(5)] + [(4, p, 2) for p in range(5, 9)] + [(7, p, 2) for p in (1, 2)]
    placed = spark.createDataFrame(rows, "node long, pair_id long, mate int")
    assert [tuple(r) for r in L.end_links(placed, 1).collect()] == [(0, 2, 5)]
    assert L.end_links(placed, 5).count() == 0


def test_walks_that_do_not_arrive_join_nothing(spark):
    rng = random.Random(3)
    strings = {0: sides(rng, 60), 1: sides(rng, 60)}
    vertices, arcs, frame = frames(spark, strings, [(0, 0, 1)], [(0, strings[0][-30:], strings[1][-30:])])
    arcs, mates = arcs.limit(0), L.mates_of(frame)
    reads = mates.select((mates.pair_id * 2 + mates.mate).alias("idx"), "seq")
    counts = K.strand_counts(reads, K_)
    ends = L.dead_ends(vertices, arcs, 20)
    links = L.end_links(L.end_reads(ends, mates, counts, K_, INSERT, 1000, 5), 0)
    walked = L.walk_links(links, ends, MW.Places(reads, K_), counts, MW.Limits(seed=K_, support=1, most_overlap=20, most_length=100))
    assert [(r.status, r.added) for r in walked.collect()] == [("dead_end", None)]
    grown, joined = L.join_islands(vertices, arcs, walked, K_)
    assert joined.count() == 0 and {r.seq for r in grown.collect()} == set(strings.values())
