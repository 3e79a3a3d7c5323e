"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has the sign bit of each coordinate, in segments of 16 bits.
Within a block of codes each segment has a table from its value to the codes.
A query looks at values at segment distance 0, 1, 2, ...; after radius r every
code within ``segments * (r + 1) - 1`` bits has been met, so the search ends as
soon as the k-th verified distance is at most that.

Equal codes are kept once, with their k least ids: no further id of that code
can be among the k nearest under (distance, id). Blocks are of bounded size;
each block answers each block of queries and the best k of all blocks are kept.
Null and empty vectors have no code: they are no queries and are never found. A
query finds itself and repeated ids like any other row.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

SEGMENT = 16


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code: one integer a segment; coordinates >= 0 give 1, missing ones 0."""
    segment = lambda s: F.aggregate(F.slice("embedding", s * SEGMENT + 1, SEGMENT), F.lit(0), lambda a, x: a * 2 + F.when(x >= 0, 1).otherwise(0))
    spread = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / SEGMENT).cast("int")), segment)
    return vectors.select("vec_id", "embedding").filter(F.size("embedding") > 0).select("vec_id", spread.alias("code"))


@functools.lru_cache(SEGMENT + 1)
def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(SEGMENT), radius)], np.int64)


def search_block(index: np.ndarray, multiplicity: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of ``index`` (codes x segments) that can be among the k nearest, with distances."""
    segments = index.shape[1]
    tables = []
    for s in range(segments):
        order = np.argsort(index[:, s], kind="stable")
        tables.append((order, np.searchsorted(index[order, s], np.arange((1 << SEGMENT) + 1))))
    wanted = min(k, int(multiplicity.sum()))
    out = []
    for q in queries:
        met = np.zeros(len(index), bool)
        rows, dists = [], []
        for radius in range(SEGMENT + 1):
            new = []
            for s, (order, first) in enumerate(tables):
                value = q[s] ^ _masks(radius)
                a, b = first[value], first[value + 1]
                hit = np.flatnonzero(b > a)
                if len(hit):
                    size = b[hit] - a[hit]
                    new.append(order[np.repeat(a[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())])
            if new:
                found = np.unique(np.concatenate(new))
                found = found[~met[found]]
                met[found] = True
                rows.append(found)
                dists.append(np.bitwise_count(index[found] ^ q).sum(1))
            if rows:
                row, dist = np.concatenate(rows), np.concatenate(dists)
                covered = segments * (radius + 1) - 1
                if multiplicity[row[dist <= covered]].sum() >= wanted:
                    break
        order = np.argsort(dist, kind="stable")
        enough = int(np.searchsorted(np.cumsum(multiplicity[row[order]]), wanted))
        last = dist[order[min(enough, len(order) - 1)]]
        keep = dist <= last
        out.append((row[keep], dist[keep]))
    return out


def _answer(k: int):
    def run(key, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(index) and len(queries):
            wide = np.array([len(c) for c in index["code"]])
            for width, asked in queries.groupby(queries["code"].map(len)):
                own = index[wide == width]
                if not len(own):
                    continue
                matrix = np.array(own["code"].tolist(), np.int64)
                ids = own["ids"].tolist()
                mult = np.array(list(map(len, ids)))
                for q, (row, dist) in zip(asked["vec_id"], search_block(matrix, mult, np.array(asked["code"].tolist(), np.int64), k)):
                    best = sorted((int(d), i) for r, d in zip(row, dist) for i in ids[r])[:k]
                    parts += [(q, i, d) for d, i in best]
        return pd.DataFrame(parts, columns=["query_id", "vec_id", "distance"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, index_block: int = 1 << 17, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, distance: for every row whose id is divisible by ``every``, its k nearest rows."""
    coded = codes(vectors)
    n = coded.count()
    nearest = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    distinct = coded.filter(F.col("vec_id").isNotNull()).withColumn("turn", nearest).filter(F.col("turn") <= k).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    blocks, query_blocks = max(1, -(-n // index_block)), max(1, -(-(n // every) // query_block))
    index = distinct.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = coded.filter(F.col("vec_id") % every == 0).withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = index.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInPandas(_answer(k), "query_id long, vec_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS code FROM embeddings WHERE len(embedding) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(list_zip(q.code, c.code), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM c q JOIN c ON q.vec_id % 100 = 0 AND len(q.code) = len(c.code)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
