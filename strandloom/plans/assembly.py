"""The whole run from records to contigs: one lazily composed plan, with a written table where later stages read twice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from strandloom.operators import correct, graph as G, overlap as O, preprocess as P, qc, search
from strandloom.sources.durable import durable


@dataclass(frozen=True)
class Settings:
    """Defaults follow the assembler's code, not its help."""

    k: int = 31
    support: int = 3
    read_length: int = 100
    insert: int = 200
    least_overlap: int = 0
    identity: float = 0.96
    conflict: int = 5
    cleaning: P.Options = field(default_factory=P.Options)

    @property
    def overlap(self) -> int:
        return self.least_overlap or self.read_length * 8 // 10


def clean(reads: DataFrame, s: Settings) -> DataFrame:
    return P.process(reads, s.cleaning).filter(F.col("fate") == "kept").drop("fate")


def reduce_reads(reads: DataFrame, s: Settings) -> DataFrame:
    """Corrected, distinct reads that aren't part of others."""
    fixed = durable(reads.drop("seq").join(correct.correct(reads, s.k, 2 * s.support, 1), "id"), "corrected")
    fixed = fixed.select("idx", "id").join(correct.overlap_correct(fixed, s.k, s.identity, s.support, s.conflict), "idx")
    unique = durable(qc.unique_reads(fixed), "unique")
    return durable(unique.join(qc.contained(unique, s.k), "id", "left_anti"), "reduced")


def string_graph(reads: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    sizes = O.lengths(reads)
    found = durable(O.exact(reads, s.overlap), "overlaps")
    arcs = durable(G.single_edges(G.with_twins(O.irreducible(O.fanout_cap(found, sizes), sizes))), "arcs")
    return reads.select(F.col("idx").alias("v"), "seq", F.lit(1).cast("bigint").alias("cov"), F.length("seq").alias("origin")), arcs


def trim_and_smooth(vertices: DataFrame, arcs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    vertices, arcs = (durable(x, "round") for x in G.trim(vertices, arcs, least))
    vertices, arcs = (durable(x, "round") for x in G.drop_vertices(vertices, arcs, G.bubbles(vertices, arcs)))
    vertices, arcs = G.compact(vertices, arcs)
    return durable(vertices.drop("members"), "round"), durable(arcs, "round")


def contigs(vertices: DataFrame, arcs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Simplify, then trim tips by rising lengths, smooth bubbles and drop weak overlaps of long vertices."""
    merged, arcs = G.compact(vertices.select("v", "seq", "cov"), arcs)
    vertices, arcs = durable(merged.drop("members"), "round"), durable(arcs, "round")
    step = max(1, s.insert // 5)
    for least in (s.k + 1, s.k + 1 + step, s.insert):
        vertices, arcs = trim_and_smooth(vertices, arcs, least)
    weak = G.length_differences(vertices, arcs, s.insert, s.overlap, max(1, s.read_length // 10))
    vertices, arcs = trim_and_smooth(vertices, durable(G.drop_arcs(arcs, weak), "round"), s.k + 1)
    wide = durable(search.bubbles(vertices, arcs, 2 * s.insert), "wide")  # sides of several vertices, once, as its rounds are many
    vertices, arcs = (durable(x, "round") for x in G.drop_vertices(vertices, arcs, wide))
    merged, arcs = G.compact(vertices, arcs)
    return merged.drop("members"), arcs


def assemble(reads: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Contigs (v, seq, cov) and their arcs of reads with idx, id, seq and scores."""
    reduced = reduce_reads(durable(clean(reads, s).select("idx", "id", "seq"), "clean"), s)
    return contigs(*string_graph(reduced, s), s)
