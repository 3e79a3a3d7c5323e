"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is compressed with each; the difference of the compressed sizes,
a byte of text, becomes a score by a logistic curve fitted on labelled rows
that the dictionaries haven't seen.

The fit uses all labelled rows outside the held-out fold, and the whole of their
texts: counts of grams over all segments weigh each segment, and of segments that
are alike the one nearest to their mean goes into its label's dictionary; the curve is fitted on
the differences of all rows that the dictionaries haven't seen. Every text is
scored whole. Null and empty texts have no
difference and get the curve's value there. Rows whose id is null are scored
too, with a null ``held_out``, and never learned from; of conflicting labels of
one id the larger counts. Repeated rows are scored each; an empty table gives no
rows. Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.storage import durable, fresh, split

FOLDS, THRESHOLD, PIECE = 5, 0.3, 1024
#: Bytes of a dictionary's segment and of a gram, bits of a gram's bucket, segments looked at together (with BITS, 32 bits at most), parts of one that differences are told in.
SEGMENT, GRAM, BITS, SOME, STEPS = 256, 8, 18, 4096, 1 << 16
#: Sums that go to one row of the shuffle.
SLICE = 1 << 12


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    level: int = 1


def _packers(good: bytes, bad: bytes, level: int) -> list[zstandard.ZstdCompressor]:
    found = []
    for content in (good, bad):
        learned = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        learned.precompute_compress(level=level)
        found.append(zstandard.ZstdCompressor(level=level, dict_data=learned, write_checksum=False, write_content_size=False, write_dict_id=False))
    return found


def _differences(texts: list[str | None], good: bytes, bad: bytes, level: int) -> np.ndarray:
    """Bytes saved by the good dictionary against the bad one, a byte of text. Texts go in pieces, so that a long text's own repeats don't drown what the dictionaries say."""
    one, two = _packers(good, bad, level)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if text:
            raw, saved = text.encode("utf-8", "replace"), 0
            for at in range(0, len(raw), PIECE):
                saved += len(two.compress(raw[at : at + PIECE])) - len(one.compress(raw[at : at + PIECE]))
            out[i] = saved / len(raw)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method for one slope and an offset, with a small ridge; ``n`` rows have the same x and y."""
    scale = np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)) or 1.0
    design, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))  # separable rows would throw it far off
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, text, turn (0 to 3) of all labelled rows outside the held-out fold that have a text.

    Labels grow with the documents, so they aren't broadcast at any size: a bit table of
    their ids (2 MB) is, and texts that pass it are shuffled to an exact join.
    """
    key = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0)
    slot, *marks = fresh(rows, "slot", "place", "word", "bits")
    hashed = F.xxhash64(F.col("doc_id").cast("string")).alias(slot)
    likely = split(rows.select("*", hashed), slot, key.select(hashed), marks)[1]
    found = likely.select("doc_id", "text").join(key.hint("shuffle_hash"), "doc_id")
    return found.select("quality", "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int").alias("turn"))


def fit(docs: DataFrame, labels: DataFrame, dict_bytes: int = 1 << 20, level: int = 6) -> QualityModel:
    """Learns from all labelled rows outside the held-out fold, and from the whole of their texts.

    Three of four rows, by a hash of their id, tell the dictionaries of ``dict_bytes`` each,
    the fourth the curve. Without rows of both labels every text gets one and the same score.
    """
    rows = durable(labelled(docs, labels), "labelled")
    learn = rows.filter("turn > 0")
    content = _contents(learn, _weights(_gram_counts(learn)), max(1, dict_bytes // SEGMENT))
    for some in (rows.filter("turn = 0"), rows):  # of few rows the fourth may lack a label
        points = _points(some, content, level)
        if points["quality"].nunique() == 2:
            y, n = points["quality"].to_numpy(float), points["n"].to_numpy(float)
            n /= np.where(y == 1, n[y == 1].sum(), n[y == 0].sum()) / n.sum()  # both labels weigh alike
            return QualityModel(*content, *_logistic(points["x"].to_numpy() / STEPS, y, n), level)
    return QualityModel(*content, 0.0, 2.0 if len(points) and points["quality"].max() else 0.0, level)


def _grams(texts: list[str], ends: bool = False) -> Iterator[tuple]:
    """Some segments at a time: their texts' numbers, the bytes they are of, where each begins (and ends), and the segment and bucket of each of their grams, once each."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    many = -(-sizes // SEGMENT)
    whole = b"".join(raw) + bytes(GRAM)
    grams = np.ndarray((len(whole) - GRAM + 1,), np.dtype("<u8"), buffer=whole, strides=(1,))
    of = np.repeat(np.arange(len(raw)), many)
    begin = (np.cumsum(sizes) - sizes)[of] + (np.arange(len(of)) - (np.cumsum(many) - many)[of]) * SEGMENT
    stop = np.minimum(begin + SEGMENT, np.cumsum(sizes)[of])
    for at in range(0, len(of), SOME):
        one, two = begin[at : at + SOME], stop[at : at + SOME]
        n = np.maximum(two - one - GRAM + 1, 0)
        segment = np.repeat(np.arange(len(one), dtype=np.uint32), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - one, n)
        code = grams[place] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        key = np.sort(segment << np.uint32(BITS) | code.astype(np.uint32))
        key = key[np.append(True, key[1:] != key[:-1])[: len(key)]].astype(np.int64)
        yield of[at : at + SOME], whole, *((one, two) if ends else (one,)), key >> BITS, key & (1 << BITS) - 1


def _totals(learn: DataFrame, width: int, add: Callable[..., None]) -> np.ndarray:
    """For each label ``width`` numbers that ``add`` has summed over all segments of all texts. They go in slices, so that no task adds up whole rows of all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, width), np.int64)
        for batch in batches:
            quality = batch.column("quality").to_numpy()
            for of, _, one, segment, bucket in _grams(batch.column("text").to_pylist()):
                add(found, quality[of], one, segment, bucket)
        cut = [(q, at, found[q, at : at + SLICE]) for q in (0, 1) for at in range(0, width, SLICE)]
        cut = [c for c in cut if c[2].any()]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2].tobytes() for c in cut], pa.binary())], names=["quality", "at", "sums"])

    def all_of(frame: pd.DataFrame) -> pd.DataFrame:
        return frame[["quality", "at"]].iloc[:1].assign(sums=[sum(np.frombuffer(x, np.int64) for x in frame["sums"]).tobytes()])

    kind = "quality int, at int, sums binary"
    out = np.zeros((2, width), np.int64)
    for row in learn.select("quality", "text").mapInArrow(count, kind).groupBy("quality", "at").applyInPandas(all_of, kind).collect():  # 2 x width numbers
        out[row.quality, row.at : row.at + SLICE] = np.frombuffer(row.sums, np.int64)
    return out


def _gram_counts(learn: DataFrame) -> np.ndarray:
    """How many segments have a gram of each bucket, and last the number of segments."""

    def add(found: np.ndarray, own: np.ndarray, one: np.ndarray, segment: np.ndarray, bucket: np.ndarray) -> None:
        for q in (0, 1):
            found[q, :-1] += np.bincount(bucket[own[segment] == q], minlength=1 << BITS)
            found[q, -1] += (own == q).sum()

    return _totals(learn, (1 << BITS) + 1, add)


def _weights(counts: np.ndarray) -> np.ndarray:
    """What a gram adds to a segment of each label: the logarithm of how much more often that label's segments have it than the other's. Whole numbers, so that sums don't depend on their order."""
    share = counts[:, :-1] / np.maximum(counts[:, -1:], 1)
    return np.rint(np.log((share + 1e-6) / (share[::-1] + 1e-6)) * 1024).astype(np.int64)


def _placed(weights: np.ndarray, slots: int, own: np.ndarray, one: np.ndarray, segment: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each segment, and its slot: that of its least gram, so that segments alike share one."""
    weight, slot = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
    if len(segment):
        edge = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        weight[segment[edge]] = np.add.reduceat(weights[own[segment], bucket], edge)
        slot[segment[edge]] = np.minimum.reduceat(_ORDER[bucket], edge) % slots
    return weight, slot


def _contents(learn: DataFrame, weights: np.ndarray, slots: int) -> list[bytes]:
    """The dictionaries of good and of bad texts. Every segment of every text competes in its slot; the one whose weight is nearest to the mean of all of them there stays, as the extremes of a label stand for few of its texts."""

    def add(found: np.ndarray, own: np.ndarray, one: np.ndarray, segment: np.ndarray, bucket: np.ndarray) -> None:
        weight, slot = _placed(weights, slots, own, one, segment, bucket)
        np.add.at(found, (own, slot), 1)
        np.add.at(found, (own, slots + slot), weight)

    sums = _totals(learn, 2 * slots, add)
    mean = sums[:, slots:] // np.maximum(sums[:, :slots], 1)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in batches:
            quality = batch.column("quality").to_numpy()
            for of, whole, one, two, segment, bucket in _grams(batch.column("text").to_pylist(), ends=True):
                own = quality[of]
                weight, slot = _placed(weights, slots, own, one, segment, bucket)
                far = np.abs(weight - mean[own, slot])
                order = np.lexsort((far, slot, own))
                first = np.concatenate([[True], (slot[order][1:] != slot[order][:-1]) | (own[order][1:] != own[order][:-1])])
                least = far[order][first][np.cumsum(first) - 1]
                for i in order[far[order] == least].tolist():  # with ties, which the bytes decide
                    place, new = (int(own[i]), int(slot[i])), (int(far[i]), whole[one[i] : two[i]])
                    if place not in held or new < held[place]:
                        held[place] = new
        some = list(held.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.int32()), pa.array([k[1] for k, _ in some], pa.int64()), pa.array([v[0] for _, v in some], pa.int64()), pa.array([v[1] for _, v in some], pa.binary())], names=["quality", "slot", "far", "segment"])

    rows = learn.select("quality", "text").mapInArrow(nearest, "quality int, slot long, far long, segment binary")
    found = rows.groupBy("quality", "slot").agg(F.min(F.struct("far", "segment")).alias("best")).select("quality", "slot", "best.segment").collect()  # dict_bytes a label at most
    return [b"".join(r.segment for r in sorted(found, key=lambda r: r.slot) if r.quality == q) or b"\0" * 8 for q in (1, 0)]


def _mixed(codes: np.ndarray) -> np.ndarray:
    return (codes * 0x5851F42D + 0x14057B7E) % ((1 << 31) - 1)


_ORDER = _mixed(np.arange(1 << BITS))


def _points(rows: DataFrame, content: list[bytes], level: int) -> pd.DataFrame:
    """quality, x, n: how many of all rows have a difference of x / ``STEPS``."""
    good, bad = content

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.rint(_differences(list(frame["text"]), good, bad, level) * STEPS).astype(np.int64)
            yield pd.DataFrame({"quality": frame["quality"], "x": x})

    return rows.select("quality", "text").mapInPandas(run, "quality int, x long").groupBy("quality", "x").agg(F.count("*").alias("n")).orderBy("quality", "x").toPandas()


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = _differences([t if isinstance(t, str) else None for t in frame["text"]], model.good, model.bad, model.level)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": p})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows that aren't rejected, with all their columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _differences(batch.column(batch.schema.get_field_index("text")).to_pylist(), model.good, model.bad, model.level)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))
            yield batch.filter(pa.array(p >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
