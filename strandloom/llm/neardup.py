"""Near duplicates among embeddings of one label: sign hashing, exact cosines, connected components.

Random hyperplanes give each vector a key of ``bits`` sign bits in each of
several tables. Two vectors at an angle t share a key with probability
(1 - t / pi) ** bits, so the number of tables follows from the angle of the
threshold and ``miss``, the share of pairs right at the threshold that may be
lost; closer pairs are lost less often. ``bits`` grows with the logarithm of the
number of vectors, which holds the expected number of unrelated vectors in a
bucket. Pairs that share a bucket are verified by their cosine in double
precision, in the first table only in which they meet.

A bucket of more than ``block`` vectors is cut into blocks that are compared two
at a time, so no task needs a whole bucket. A task gives each vector the number
of its links and one edge to the root of those it is tied to there; pairs are
never written. Equal vectors of a label are one class with a number of rows.

Rows whose label or vector is null, whose vector is empty or zero or has a null,
NaN or infinite component, have no links. Vectors of different length have none
with each other. Rows that share a vec_id are rows of their own, and a null
vec_id is no component's name unless nothing else is there.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from strandloom.llm.graph import components
from strandloom.llm.storage import durable

SEED = 11
#: Doubles of one side that a step of the verification gathers.
GATHER = 1 << 21


def usable(label: Column, vector: Column) -> Column:
    """Vectors that can have links."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def shape(n: int, least: float, miss: float) -> tuple[int, int]:
    """Bits and tables for ``n`` vectors and the least cosine."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, n)))))
    together = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-together)) if together < 1 else 1


@functools.lru_cache(8)
def _planes(width: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, count))


def sign_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Rows x tables of keys."""
    signs = vectors @ _planes(vectors.shape[1], bits * tables) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _keyed(bits: int, tables: int):
    def run(frames):
        for frame in frames:
            keys = [None] * len(frame)
            for _, part in frame.groupby(frame["embedding"].map(len)):
                found = sign_keys(np.array(part["embedding"].tolist(), float), bits, tables)
                for i, row in zip(frame.index.get_indexer(part.index), found):
                    keys[i] = row
            yield frame.assign(keys=keys)

    return run


def _partners(bucket: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of rows that each row is compared with, in rows sorted by bucket and side.

    Side 0 is a bucket, or a block of one, compared with itself. Sides 1 and 2
    are two blocks: rows of the first are compared with all of the second.
    """
    group = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    of = np.repeat(np.arange(len(group) - 1), np.diff(group))
    end = group[of + 1]
    second = np.minimum.reduceat(np.where(side == 2, np.arange(len(side)), len(side)), group[:-1])[of]
    here = np.arange(len(bucket))
    low = np.where(side == 0, here + 1, np.where(side == 1, np.minimum(second, end), end))
    return low, end


def _join(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The forest ``root`` (each place's root) with the trees of linked places joined."""
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, further := root[root]):
            root = further
    return root


def _links(frame: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one unit's vectors: node, links, root."""
    frame = frame.sort_values(["bucket", "side"], kind="stable", ignore_index=True)
    vectors = np.array(frame["embedding"].tolist(), float)
    vectors /= np.abs(vectors).max(1)[:, None]  # norms of very large or small components stay finite
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    keys, table, label = np.array(frame["keys"].tolist(), np.int64), frame["t"].to_numpy(), frame["label"].to_numpy()
    low, end = _partners(frame["bucket"].to_numpy(), frame["side"].to_numpy())
    many, node, rows = end - low, frame["node"].to_numpy(), frame["n"].to_numpy()
    links, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
    upto = np.cumsum(many)
    edges, step = [0], max(1, GATHER // vectors.shape[1])
    while edges[-1] < len(frame):
        done = upto[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(upto, done + step, "right"))))
    for a, b in zip(edges, edges[1:]):
        left = np.repeat(np.arange(a, b), many[a:b])
        right = np.arange(len(left)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b]) + np.repeat(low[a:b], many[a:b])
        t = table[left]
        first = (keys[left, t] == keys[right, t]) & (label[left] == label[right])
        for s in range(keys.shape[1] - 1):
            first &= (s >= t) | (keys[left, s] != keys[right, s])
        left, right = left[first], right[first]
        good = np.einsum("ij,ij->i", vectors[left], vectors[right]) >= least
        left, right = left[good], right[good]
        np.add.at(links, left, rows[right])
        np.add.at(links, right, rows[left])
        root = _join(root, left, right)
    found = pd.DataFrame({"node": node, "links": links, "root": node[root]})
    return found[links > 0]


def _verify(least: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_links(part, least) for _, part in frame.groupby(frame["embedding"].map(len))]
        return pd.concat(parts) if parts else pd.DataFrame({"node": [], "links": [], "root": []})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, miss: float = 1e-5, block: int = 1024, unit: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id, kept: links of cosine ``least`` and more within a label.

    ``unit`` is the number of rows that a task verifies at a time, about.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    good = usable(F.col("label"), F.col("embedding"))
    classes = rows.filter(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = shape(classes.count(), least, miss)
    keyed = durable(classes.mapInPandas(_keyed(bits, tables), T.StructType([*classes.schema, T.StructField("keys", T.ArrayType(T.LongType()))])), "sign-keys")
    bucket = F.xxhash64("label", F.size("embedding"), "t", "key")
    spread = keyed.select("label", "embedding", "node", "n", "keys", F.posexplode("keys").alias("t", "key")).withColumn("bucket", bucket)
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    crowded = durable(crowded, "buckets")
    total = crowded.agg(F.sum("size")).first()[0] or 0
    units = max(1, -(-total // unit))
    met = spread.join(crowded, "bucket").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    pairs = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("bucket", "t", "label", "embedding", "node", "n", "keys", "blocks", "mine", pairs)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    # two blocks of a bucket are a unit of their own; small buckets share units
    place = F.when(F.col("blocks") > 1, F.xxhash64("bucket", low, high)).otherwise(F.pmod("bucket", F.lit(units)))
    met = met.select("bucket", "t", "label", "embedding", "node", "n", "keys", side.alias("side"), place.alias("unit"))
    found = durable(met.groupBy("unit").applyInPandas(_verify(least), "node bigint, links bigint, root bigint"), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "label", "embedding", "least_id", "n").join(counted, "node", "left").join(rooted, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = named.join(names, "root").select("label", "embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id"))
    out = rows.filter(good).join(linked, ["label", "embedding"]).select("vec_id", "n_links", F.col("component_id").cast("bigint").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
c(node, root) AS (SELECT a, least(a, b) FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node WHERE c.root < e.b),
r AS (SELECT node, min(root) AS root FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM embeddings LEFT JOIN r ON r.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
