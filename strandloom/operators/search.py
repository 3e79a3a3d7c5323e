"""Bounded searches from many vertices at once: paths, their strings, and bubbles of several vertices.

All starts are searched together, an arc a round, so rounds grow with the
longest path and not with the number of starts. A start with more than ``most``
paths open is given up and told as such.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.functions import dna
from strandloom.operators.graph import twin, vertex
from strandloom.operators.overlap import oriented
from strandloom.sources.durable import durable


def paths(vertices: DataFrame, arcs: DataFrame, starts: DataFrame, most_length: int, most: int = 32, goals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Paths (start, nodes, ends, state) from oriented vertices (start), and starts given up (start).

    ``ends`` has the bases from the start's end to each node's end. A path is
    final if it is at a goal (start, goal: 'goal'), at a dead end ('end'), longer
    than ``most_length`` ('long') or back at a node it has ('circle').
    """
    sizes = vertices.select("v", F.length("seq").alias("len"))
    onward = durable(arcs.withColumn("v", vertex("b")).join(sizes, "v").select(F.col("a").alias("at"), F.col("b").alias("to"), (F.col("len") - F.col("size")).cast("bigint").alias("more")), "onward")
    front = durable(starts.select("start").distinct().select("start", F.array("start").alias("nodes"), F.array(F.lit(0).cast("bigint")).alias("ends")), "paths")
    done, busy = [], []
    while front.limit(1).count():
        last = F.element_at("ends", -1)
        grown = front.withColumn("at", F.element_at("nodes", -1)).join(onward, "at", "left")
        circle = F.array_contains("nodes", F.col("to"))
        grown = grown.select("start", F.when(F.col("to").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("to"))).alias("nodes"), F.when(F.col("to").isNull(), F.col("ends")).otherwise(F.concat("ends", F.array(last + F.col("more")))).alias("ends"), F.when(F.col("to").isNull(), "end").when(circle, "circle").when(last + F.col("more") > most_length, "long").alias("state"))
        if goals is not None:
            grown = grown.withColumn("goal", F.element_at("nodes", -1)).join(goals.select("start", "goal", F.lit(True).alias("there")), ["start", "goal"], "left")
            grown = grown.select("start", "nodes", "ends", F.when(F.col("there"), "goal").otherwise(F.col("state")).alias("state"))
        grown = durable(grown, "paths")
        done.append(grown.filter(F.col("state").isNotNull()))
        every = done[0]
        for part in done[1:]:
            every = every.unionByName(part)
        open_ = grown.filter(F.col("state").isNull())
        over = every.select("start").unionAll(open_.select("start")).groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("start")
        busy.append(durable(over, "given-up"))
        front = open_.join(busy[-1], "start", "left_anti").drop("state")
    if not done:
        return front.withColumn("state", F.lit("end")), front.select("start")
    given = busy[0]
    for part in busy[1:]:
        given = given.unionAll(part)
    given = given.distinct()
    return every.join(given, "start", "left_anti"), given


def path_strings(vertices: DataFrame, arcs: DataFrame, found: DataFrame) -> DataFrame:
    """start, nodes, seq: the string of each path (start, nodes): the first node's sequence and what each further one adds."""
    seqs = oriented(vertices.select(F.col("v").alias("idx"), "seq"))
    steps = found.select("start", "nodes").distinct().select("start", "nodes", F.posexplode("nodes").alias("i", "node"))
    steps = steps.withColumn("before", F.when(F.col("i") > 0, F.element_at("nodes", F.greatest(F.col("i"), F.lit(1)))))
    best = arcs.groupBy(F.col("a").alias("before"), F.col("b").alias("node")).agg(F.max("size").alias("size"))
    rows = steps.join(seqs, "node").join(best, ["before", "node"], "left")
    added = dna.substr("seq", F.coalesce("size", F.lit(0)) + 1, F.length("seq"))
    parts = rows.groupBy("start", "nodes").agg(F.sort_array(F.collect_list(F.struct("i", added.alias("s")))).alias("p"))
    return parts.select("start", "nodes", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


_BUBBLE = "start bigint, goal bigint, path int, node bigint, before bigint, gap bigint"


def _meetings(frames):
    """For each start the first node that all its paths pass, with the nodes of each different way there."""
    names = [x.split()[0] for x in _BUBBLE.split(", ")]
    for frame in frames:
        out = []
        for start, ways in zip(frame["start"].tolist(), frame["ways"].tolist()):
            ways = [([int(n) for n in w["nodes"]], [int(e) for e in w["ends"]]) for w in ways]
            shared = set(ways[0][0][1:]).intersection(*(w[1:] for w, _ in ways[1:]))
            if not shared:
                continue
            goal = min(shared, key=lambda n: (max(w.index(n) for w, _ in ways), n))
            inner = sorted({(tuple(w[: w.index(goal) + 1]), e[w.index(goal)]) for w, e in ways})
            if len(inner) < 2:
                continue
            for k, (nodes, gap) in enumerate(inner):
                out += [(start, goal, k, node, before, gap) for before, node in zip(nodes, nodes[1:])]
        yield pd.DataFrame(out, columns=names)


def bubbles(vertices: DataFrame, arcs: DataFrame, most_length: int = 2400, most: int = 32, most_gap: int = 9) -> DataFrame:
    """v of the weaker sides of bubbles: ways of any number of vertices from one node that all meet again.

    Nothing may enter a bubble from outside, no vertex may be in it on both
    strands, and the ways' lengths may differ by ``most_gap`` bases. The way of
    most coverage a base stays, the least nodes on a tie.
    """
    forks = arcs.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("a").alias("start"))
    found, _ = paths(vertices, arcs, forks, most_length, most)
    whole = found.groupBy("start").agg(F.collect_list(F.struct("nodes", "ends")).alias("ways"), F.bool_or(F.col("state") == "circle").alias("round")).filter("not round")
    steps = durable(whole.select("start", "ways").mapInPandas(_meetings, _BUBBLE), "meetings")
    steps = steps.filter(F.col("start") <= twin("goal"))  # once, not from either side
    into = arcs.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("into"))
    own = steps.groupBy("start", "goal", "node").agg(F.count_distinct("before").alias("own")).join(into, "node")
    sides = own.groupBy("start", "goal", vertex("node").alias("v")).agg(F.count("*").alias("strands"), F.bool_and(F.col("own") == F.col("into")).alias("closed"))
    closed = sides.groupBy("start", "goal").agg(F.bool_and("closed").alias("closed"), F.max("strands").alias("strands")).filter((F.col("strands") == 1) & F.col("closed")).select("start", "goal")
    inner = steps.filter(F.col("node") != F.col("goal")).withColumn("v", vertex("node")).join(vertices.select("v", "cov", F.length("seq").alias("len")), "v")
    score = F.sum(F.col("cov").cast("double")) / F.sum("len")
    ways = steps.select("start", "goal", "path", "gap").distinct().join(inner.groupBy("start", "goal", "path").agg(score.alias("score")), ["start", "goal", "path"], "left")
    spread = ways.groupBy("start", "goal").agg((F.max("gap") - F.min("gap")).alias("spread"), F.min_by("path", F.struct(-F.coalesce("score", F.lit(0.0)), "path")).alias("kept"))
    good = spread.filter(F.col("spread") <= most_gap).join(closed, ["start", "goal"], "left_semi")
    sides = inner.join(good, ["start", "goal"]).groupBy("start", "goal", "v").agg(F.bool_or(F.col("path") == F.col("kept")).alias("stays"))
    return sides.filter(~F.col("stays")).select("v").distinct()
