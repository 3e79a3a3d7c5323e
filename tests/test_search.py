"""Paths with limits, their strings, and bubbles, on small graphs."""

import random

from strandloom.operators import graph as G, search as Q

STRING = "v long, seq string, cov long"


def graph(spark, strings, links, cov=None):
    """A graph of arcs between forward strands that overlap by as much as the strings agree."""
    vertices = spark.createDataFrame([(v, s, (cov or {}).get(v, 1)) for v, s in strings.items()], STRING)
    arcs = [(2 * a, 2 * b, max(n for n in range(1, 8) if strings[a][-n:] == strings[b][:n])) for a, b in links]
    return vertices, G.with_twins(spark.createDataFrame(arcs, "a long, b long, size int"))


def sides(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def bubble(spark, extra=(), longer="", cov=None):
    """0 to 5 over 1, 2 or over 3, 4, as two copies of a sequence that differ in one place."""
    rng = random.Random(1)
    one = sides(rng, 80)
    two = one[:38] + ("A" if one[38] != "A" else "C") + longer + one[39:]
    cut = lambda s, d=0: [s[0:26], s[20:46], s[40 : 66 + d]]
    a, b = cut(one), cut(two, len(longer))
    strings = {0: a[0], 1: a[1], 2: a[2], 3: b[1], 4: b[2], 5: one[60:80], 6: sides(rng, 20) + b[1][:6]}
    strings[2], strings[4] = one[40:66], two[40 : 66 + len(longer)]
    links = [(0, 1), (1, 2), (2, 5), (0, 3), (3, 4), (4, 5), *extra]
    return graph(spark, strings, links, cov), one, two


def test_bubbles_of_several_vertices(spark):
    (vertices, arcs), _, _ = bubble(spark, cov={1: 5, 2: 5})
    assert sorted(r.v for r in Q.bubbles(vertices, arcs).collect()) == [3, 4]
    (vertices, arcs), _, _ = bubble(spark, cov={3: 5, 4: 5})
    assert sorted(r.v for r in Q.bubbles(vertices, arcs).collect()) == [1, 2]
    assert Q.bubbles(vertices, arcs, most_length=10).count() == 0 and Q.bubbles(vertices, arcs, most=1).count() == 0


def test_open_and_uneven_bubbles_stay(spark):
    (vertices, arcs), _, _ = bubble(spark, extra=[(6, 3)])
    assert Q.bubbles(vertices, arcs).count() == 0
    (vertices, arcs), _, _ = bubble(spark, longer="ACGTACGTACGTAC")
    assert Q.bubbles(vertices, arcs).count() == 0 and Q.bubbles(vertices, arcs, most_gap=20).count() == 2


def test_paths_and_strings(spark):
    (vertices, arcs), one, two = bubble(spark)
    starts = spark.createDataFrame([(0,)], "start long")
    found, given = Q.paths(vertices, arcs, starts, 1000)
    rows = {tuple(r.nodes): (list(r.ends), r.state) for r in found.collect()}
    assert set(rows) == {(0, 2, 4, 10), (0, 6, 8, 10)} and given.count() == 0
    assert all(state == "end" and ends[-1] == 80 - 26 for ends, state in rows.values())
    assert {r.seq for r in Q.path_strings(vertices, arcs, found).collect()} == {one, two}
    found, _ = Q.paths(vertices, arcs, starts, 1000, goals=spark.createDataFrame([(0, 4)], "start long, goal long"))
    assert {(tuple(r.nodes), r.state) for r in found.collect()} == {((0, 2, 4), "goal"), ((0, 6, 8, 10), "end")}
    found, given = Q.paths(vertices, arcs, starts, 1000, most=1)
    assert found.count() == 0 and [r.start for r in given.collect()] == [0]
    found, _ = Q.paths(vertices, arcs, starts, 25)
    assert {r.state for r in found.collect()} == {"long"}


def test_circles_end(spark):
    s = "ACGTTGCAACGG"
    ring = {0: s[:8], 1: s[5:] + s[:2], 2: s[10:] + s[:3]}
    vertices = spark.createDataFrame([(v, q, 1) for v, q in ring.items()], STRING)
    arcs = G.with_twins(spark.createDataFrame([(0, 2, 3), (2, 4, 4), (4, 0, 3)], "a long, b long, size int"))
    found, _ = Q.paths(vertices, arcs, spark.createDataFrame([(0,)], "start long"), 1000)
    assert [(tuple(r.nodes), r.state) for r in found.collect()] == [((0, 2, 4, 0), "circle")]
