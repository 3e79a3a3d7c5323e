"""Windows over the sequences of texts, cut and looked at in the task that reads the texts: texts go in, only results come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandloom.functions import flat
from strandloom.operators import reads as R

#: Bytes of windows that are looked at together, so that they stay in the cache.
PIECE = 1 << 19
#: The base of each byte of a text, 0 for those that give none.
BASE_OF = np.zeros(256, np.uint8)
for _letter, _base in zip(R.LETTERS, R.BASES):
    BASE_OF[[ord(_letter), ord(_letter.upper())]] = ord(_base)
#: Letters beyond ASCII whose lower case has one of a-z.
FOLDED = {"K": "k", "İ": "i"}


def sequence_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``reads.sequence_of``: bases of all texts and the bounds of each. A null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    for letter, plain in FOLDED.items():
        if pc.any(pc.match_substring(texts, letter.encode())).as_py():
            texts = pc.replace_substring(texts, letter.encode(), plain.encode())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    bases = BASE_OF[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]]
    kept = np.flatnonzero(bases)
    return bases[kept], np.searchsorted(kept, bounds - bounds[0])


@dataclass(frozen=True)
class Windows:
    """Some windows: their document, place from 1, name and letters; ``next`` are those that begin further on, where asked for."""

    doc_id: pa.Array
    pos: np.ndarray
    seq: pa.Array
    next: pa.Array | None = None

    @property
    def id(self) -> pa.Array:
        return pc.binary_join_element_wise(self.doc_id.cast(pa.string()), pa.array(self.pos).cast(pa.string()), ":", null_handling="skip")


def _letters(codes: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> pa.Array:
    """Of ``codes``, which have ``size`` letters more than is used, n from each start on."""
    block = np.lib.stride_tricks.sliding_window_view(codes, size)[start]
    flat_codes = block.reshape(-1) if (n == size).all() else block[np.arange(size) < n[:, None]]
    return flat.strings(flat_codes, np.concatenate([[0], np.cumsum(n)]))


def cut(batch: pa.RecordBatch, size: int, step: int, apart: int | None = None) -> Iterator[Windows]:
    """The windows of a batch (doc_id, text), a piece at a time; with ``apart`` those that have one ``apart`` bases on, a multiple of ``step``."""
    codes, bounds = sequence_of(batch.column("text"))
    codes, length = np.concatenate([codes, np.zeros(size + (apart or 0), np.uint8)]), np.diff(bounds)
    last = np.maximum(1, length - step) - (apart or 0)  # the last window's place
    many = np.where((length > 0) & (last >= 1), (last - 1) // step + 1, 0)
    ends = np.cumsum(many)
    for at in range(0, int(ends[-1]) if len(ends) else 0, max(1, PIECE // size)):
        number = np.arange(at, min(int(ends[-1]), at + max(1, PIECE // size)))
        doc = np.searchsorted(ends, number, "right")
        pos = (number - (ends - many)[doc]) * step  # from 0
        take = lambda off: _letters(codes, bounds[doc] + pos + off, np.minimum(size, length[doc] - pos - off), size)
        yield Windows(batch.column("doc_id").take(pa.array(doc)), (pos + 1).astype(np.int32), take(0), None if apart is None else take(apart))


def neighbours(docs: DataFrame, apart: int, schema: str, f: Callable[[Windows], list[pa.Array]], size: int = R.SIZE, step: int = R.STEP) -> DataFrame:
    """What ``f`` tells of windows and their ``next``, those of the same doc_id that begin ``apart`` bases on. Only documents whose doc_id occurs twice are joined."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Windows(batch.column("doc_id"), batch.column("pos").to_numpy(), batch.column("seq"), batch.column("next"))
            yield pa.RecordBatch.from_arrays(f(some), names=names)

    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id").repartition("doc_id")  # told to be few at run time, or none
    once = told(docs.filter("doc_id IS NOT NULL").join(again, "doc_id", "left_anti"), schema, f, apart, size, step)
    more = R.neighbours(docs.join(again, "doc_id", "left_semi"), apart, size, step).select("doc_id", "pos", "seq", "next")
    return once.unionAll(more.mapInArrow(run, schema))


def told(docs: DataFrame, schema: str, f: Callable[[Windows], list[pa.Array]], apart: int | None = None, size: int = R.SIZE, step: int = R.STEP) -> DataFrame:
    """What ``f`` tells of each document's windows, in columns of ``schema``; see ``reads.tiled`` and, with ``apart``, ``reads.neighbours`` (where no doc_id occurs twice)."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in cut(batch, size, step, apart):
                yield pa.RecordBatch.from_arrays(f(some), names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
