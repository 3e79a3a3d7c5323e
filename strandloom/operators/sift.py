"""Bit tables of hashes that a join asks for: what is surely not asked for goes before any shuffle, an exact join judges the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

LEAST, MOST, PART = 20, 29, 20
#: Keys that a task holds before their places go.
HELD = 1 << 21


def table(keys: DataFrame, rows: int) -> Broadcast:
    """A broadcast table of some 8 bits a hash (key) of ``keys``, 2^29 bits (64 MB) at most; where that is full, more pass. Its parts are made by tasks."""
    bits = min(MOST, max(LEAST, (8 * rows).bit_length()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of many keys, one row a part."""
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64((1 << bits) - 1))
            size += len(held[-1])
            if size >= HELD:
                yield sent(held)
                held, size = [], 0
        if size:
            yield sent(held)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        place = np.unique(np.concatenate(held)).astype(np.uint32)
        part = place >> PART
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = (np.append(edge, len(place)) * 4).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(place.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), words], names=["part", "places"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.setdefault(p, np.zeros(1 << PART, bool))[np.frombuffer(words.as_buffer(), np.uint32) & ((1 << PART) - 1)] = True
        for p, found in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

    placed = keys.select(F.col("key").cast("long").alias("key")).filter("key IS NOT NULL").mapInArrow(split, "part int, places binary")
    whole = np.zeros(1 << bits - 3, np.uint8)
    for row in placed.repartition("part").mapInArrow(fill, "part int, bits binary").toLocalIterator():
        begin = row["part"] << PART - 3
        whole[begin : begin + (1 << PART - 3)] |= np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def has(seen: Broadcast, keys: np.ndarray) -> np.ndarray:
    """Which hashes may be in the table; the others are not."""
    bits = seen.value
    place = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
