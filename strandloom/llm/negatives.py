"""Hard negatives by inverted lists: exact windows over integer inner products.

Rows are dealt to the nearest of at most ``CENTRES`` centroids, which k-means
fits on a bounded sample; every row is in a list. A list keeps its radius, the
largest distance of a row from the centroid, so by Cauchy and Schwarz a row's
score with an anchor a lies within |a| * radius of the centroid's. An anchor
visits lists by falling upper bound, a few more each round, and is done when the
bound of the next one falls strictly below its k-th score; lists that can't
reach the score window are skipped. Lists are cut into blocks by hash, and so
are the anchors that visit a list; a task scores one block against another.

The result doesn't depend on the centroids. Any result has at most ``k`` rows of
one vector and label, those of least vec_id, so of more than ``k`` + 1 equal rows
(an anchor may be one of them) only those are listed.

Rows with a null vec_id, label or vector, or a null, NaN or infinite component
take no part. Repeated rows count once. Vectors of another length than the
anchor's are never compared with it. A vector whose scores could leave a long is
an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.storage import durable

CENTRES = 1024
#: Numbers that the sample for k-means has at most.
SAMPLE = 1 << 21
SEED = 12


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: rows that take part, with changed labels and whole components."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", "label", "embedding").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 256)).alias("x"))


def fit(rows: DataFrame, n: int, steps: int = 8) -> dict[int, np.ndarray]:
    """Centroids by vector length, from a sample that ids' hashes choose; lengths without a sample have the origin alone."""
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    most = max(1, SAMPLE // max(1, width))
    chance = min(1.0, most / max(1, n))
    few = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 60)) <= F.lit(int(chance * (1 << 60)))).select("x").limit(2 * most)
    parts: dict[int, list] = {}
    for (x,) in few.collect():
        parts.setdefault(len(x), []).append(x)
    out = {}
    for d, part in parts.items():
        points = np.array(part, float).reshape(len(part), d)
        centres = points[np.random.default_rng(SEED).permutation(len(points))[: min(CENTRES, max(1, round(n**0.5)), len(points))]]
        for _ in range(steps):
            near = _nearest(points, centres)
            total = np.zeros_like(centres)
            np.add.at(total, near, points)
            many = np.bincount(near, minlength=len(centres))
            centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centres)
        out[d] = centres
    return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)


def _centres(model: dict[int, np.ndarray], d: int) -> np.ndarray:
    return model.get(d, np.zeros((1, d)))


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), d)


def _safe(x: np.ndarray) -> np.ndarray:
    if x.size and float(np.abs(x.astype(float)).max()) ** 2 * x.shape[1] >= 2.0**56:  # a hundredfold still fits
        raise OverflowError("inner products of these vectors leave a long")
    return x


def _listed(model: dict[int, np.ndarray]):
    """Adds a row's list and its distance from the centroid, rounded up."""

    def run(frames):
        for frame in frames:
            found, far = np.zeros(len(frame), np.int64), np.zeros(len(frame))
            sizes = frame["x"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                points, centres = _safe(_matrix(frame["x"].iloc[at], d)).astype(float), _centres(model, d)
                found[at] = near = _nearest(points, centres)
                far[at] = np.sqrt(((points - centres[near]) ** 2).sum(1)) * (1 + 1e-9) + 1e-6
            yield frame.assign(list=found, far=far)

    return run


def _bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores that anchors can have in each list; lists without rows have none."""
    middle = x @ centres.T
    reach = np.sqrt((x * x).sum(1))[:, None] * radius
    slack = 1 + 1e-9 * (np.abs(middle) + np.where(radius < 0, 0, reach))
    none = radius < 0
    return np.where(none, np.inf, middle - reach - slack), np.where(none, -np.inf, middle + reach + slack)


def _asked(model: dict[int, np.ndarray], radii: dict[int, np.ndarray]):
    """Lists that anchors visit next. An anchor has ``wants``: windows (low, high, kth), of which kth is null while rows are missing, and ``seen`` lists."""

    def run(frames):
        for frame in frames:
            out = []
            for d, part in frame.groupby(frame["x"].map(len)):
                low, high = _bounds(_matrix(part["x"], d).astype(float), _centres(model, d), radii[d])
                order = np.argsort(-high, axis=1, kind="stable")
                for row, least, most, by in zip(part.itertuples(), low, high, order):
                    windows = [(w["low"], w["high"], w["kth"]) for w in row.wants if w["low"] is None or w["low"] <= w["high"]]
                    for c in by[row.seen : row.seen + row.step]:
                        if most[c] == -np.inf:
                            break
                        if any((a is None or (most[c] >= a and least[c] <= b)) and (kth is None or most[c] >= kth) for a, b, kth in windows):
                            out.append((row.node, d, int(c)))
            yield pd.DataFrame(out, columns=["node", "d", "list"])

    return run


def _scored(k: int, positives: bool):
    """The k best rows of a block for each of an anchor's windows."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(anchors):
            rows = rows.sort_values("vec_id", ignore_index=True)
            d = len(rows["x"].iloc[0])
            x, ids, labels = _matrix(rows["x"], d), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            scores = _matrix(anchors["x"], d) @ x.T
            for a, row in zip(anchors.itertuples(), scores):
                fits = (labels == a.label) & (ids != a.vec_id) if positives else labels != a.label
                for w, want in enumerate(a.wants):
                    good = fits
                    if want["low"] is not None:
                        good = fits & (row >= want["low"]) & (row <= want["high"])
                    if want["kth"] is not None:
                        good = good & (row >= want["kth"])
                    at = np.flatnonzero(good)
                    if len(at) > k:  # ties with the k-th stay, and ids break them
                        at = at[row[at] >= -np.partition(-row[at], k - 1)[k - 1]]
                    at = at[np.argsort(-row[at], kind="stable")[:k]]
                    out += [(a.node, w, int(i), int(s)) for i, s in zip(ids[at], row[at])]
        return pd.DataFrame(out, columns=["node", "w", "id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("node", "w").orderBy(F.desc("score"), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k)


def _windows(kth) -> Column:
    """The windows of ``wants``, each with its k-th score so far."""
    return F.transform("wants", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), kth(i).cast("bigint").alias("kth")))


class Index:
    """Rows in lists (d: length, list) and blocks, with the radii of the lists."""

    def __init__(self, rows: DataFrame, k: int, block: int):
        self.k, self.block = k, block
        equal = F.row_number().over(Window.partitionBy("label", "x").orderBy("vec_id"))
        some = durable(rows.withColumn("turn", equal).filter(F.col("turn") <= k + 1).drop("turn"), "listed")
        self.model = fit(some, some.count())
        kind = "vec_id bigint, label bigint, x array<bigint>, list bigint, far double"
        lists = durable(some.mapInPandas(_listed(self.model), kind).withColumn("d", F.size("x")), "lists")
        # at most CENTRES rows a vector length
        self.sizes = durable(lists.groupBy("d", "list").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / block).cast("int").alias("blocks")), "list-sizes")
        self.radii: dict[int, np.ndarray] = {}
        for d, at, radius, _ in self.sizes.collect():
            self.radii.setdefault(d, np.full(len(_centres(self.model, d)), -1.0))[at] = radius
        self.lists = lists.join(F.broadcast(self.sizes.select("d", "list", "blocks")), ["d", "list"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.col("blocks")).cast("int")).drop("far", "blocks")

    def search(self, anchors: DataFrame, k: int, positives: bool) -> DataFrame:
        """node, w, id, score, place: the k best rows in each window of anchors (node, vec_id, label, x, wants of low and high)."""
        most = max(map(len, self.radii.values()), default=1)
        found, seen, step = None, 0, 8
        while found is None or seen < most:
            if found is None:
                now = anchors.withColumn("wants", _windows(lambda i: F.lit(None)))
            else:
                full = found.groupBy("node", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") >= k)
                full = full.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kths"))
                now = anchors.join(full, "node", "left").withColumn("wants", _windows(lambda i: F.col("kths")[i])).drop("kths")
            visits = now.withColumns({"seen": F.lit(seen), "step": F.lit(step)}).mapInPandas(_asked(self.model, self.radii), "node bigint, d int, list bigint")
            visits = durable(visits, "visits")
            met = self._met(now, visits, k, positives)
            found = durable(_best(met if found is None else met.unionByName(found.drop("place")), k), "best")
            seen, step = seen + step, step * 8
        return found

    def _met(self, anchors: DataFrame, visits: DataFrame, k: int, positives: bool) -> DataFrame:
        """Scores of the visited lists, a block of rows against a crowd of anchors at a time."""
        busy = visits.groupBy("d", "list").agg(F.ceil(F.count("*") / self.block).cast("int").alias("crowds"))
        lists = busy.join(F.broadcast(self.sizes.select("d", "list", "blocks")), ["d", "list"])
        key = ["d", "list", "block", "crowd"]
        each = visits.join(F.broadcast(lists), ["d", "list"]).withColumn("crowd", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("crowds")).cast("int"))
        each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = each.join(anchors, "node").select(*key, "node", "vec_id", "label", "x", "wants")
        rows = self.lists.join(F.broadcast(busy), ["d", "list"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
        rows = rows.select(*key, "vec_id", "label", "x")
        return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_scored(k, positives), "node bigint, w int, id bigint, score bigint")


def hard_negatives(vectors: DataFrame, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, every: int = 100, block: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by ``every``. ``low`` and ``high``
    are percentages of the positive's score between which negatives score.
    """
    rows = durable(prepared(vectors).dropDuplicates(["vec_id", "label", "x"]), "vectors")
    index = Index(rows, max(k, positives), block)
    anchors = durable(rows.filter(F.col("vec_id") % every == 0).withColumn("node", F.monotonically_increasing_id()), "anchors")
    any_score = F.array(F.struct(F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")))
    near = index.search(anchors.withColumn("wants", any_score), positives, True).select("node", (F.col("place") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # a positive of negative score has an empty window
    window = F.struct(F.expr(f"if(positive_score < 0, 1, (positive_score * {low} + 99) div 100)").alias("low"), F.expr(f"if(positive_score < 0, 0, (positive_score * {high}) div 100)").alias("high"))
    wants = near.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", window.alias("window")))), lambda v: v["window"]).alias("wants"))
    far = index.search(anchors.join(wants, "node"), k, False)
    found = far.join(near, ["node", "w"]).join(anchors.select("node", F.col("vec_id").alias("anchor_id")), "node")
    return found.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
