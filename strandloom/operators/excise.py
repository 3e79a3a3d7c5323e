"""Removing vertices without losing the overlaps that they carry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.graph import drop_vertices, single_edges, vertex
from strandloom.sources.durable import durable


def excise(vertices: DataFrame, arcs: DataFrame, gone: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The graph without vertices ``gone`` (v), with arcs for paths through them whose ends still overlap by ``least`` bases.

    a over v to b overlaps by size(a, v) + size(v, b) - len(v). Each round goes
    on through one more removed vertex; overlaps get shorter each time, so the
    rounds end. Of several arcs between two vertices that of longest overlap
    stays; no vertex gets an arc to itself.
    """
    inner = vertices.join(gone, "v", "left_semi").select("v", F.length("seq").alias("len"))
    tagged = arcs.select("a", "b", "size")
    out = tagged.withColumn("v", vertex("a")).join(inner, "v").select(F.col("a").alias("m"), F.col("b").alias("c"), F.col("size").alias("more"), "len")
    out = durable(out, "out-of-removed")
    kept_vertices, kept = drop_vertices(vertices, arcs, gone)
    found = [kept]
    front = tagged.join(gone.select(F.col("v").alias("va")), vertex("a") == F.col("va"), "left_anti").join(gone.select(F.col("v").alias("vb")), vertex("b") == F.col("vb"), "left_semi")
    front = durable(front, "into-removed")
    while front.limit(1).count():
        step = front.join(out, front["b"] == out["m"]).select("a", F.col("c").alias("b"), (F.col("size") + F.col("more") - F.col("len")).cast("int").alias("size"))
        step = durable(single_edges(step.filter((F.col("size") >= least) & (vertex("a") != vertex("b")))), "through-removed")
        inside = gone.select(F.col("v").alias("vb"))
        found.append(step.join(inside, vertex("b") == F.col("vb"), "left_anti"))
        front = step.join(inside, vertex("b") == F.col("vb"), "left_semi")
    return kept_vertices, single_edges(reduce(DataFrame.unionByName, found))
