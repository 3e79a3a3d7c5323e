"""Vectorised tokenising and hashing of whole texts, for use inside Arrow-batched operators.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are
lower-cased. Those separators are ASCII, so UTF-8 bytes and characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

WORD = "[^\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 2 << 20
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd multipliers."""
    step, start = 0x9E3779B97F4A7C15, seed * 0x2545F4914F6CDD1D
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(step) + np.uint64(start & (2**64 - 1))) | np.uint64(1)


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, eight bytes at a time; ``low`` has eight bytes more than the last range."""
    eight = np.ndarray((len(low) - 7,), np.dtype("<u8"), buffer=low, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, left, place = start, size, None
    while len(at):
        piece = eight[at] & _MASK[np.minimum(left, 8)]
        if place is None:
            out = mix(out ^ piece)
        else:
            out[place] = mix(out[place] * np.uint64(0xC2B2AE3D27D4EB4F) ^ piece)
        more = np.flatnonzero(left > 8)
        place = more if place is None else place[more]
        at, left = at[more] + 8, left[more] - 8
    return out


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of several texts: ``hash``, byte ``start``/``end`` within ``buf``, and ``bounds`` of each text's words."""

    def __init__(self, texts: list[str | None]):
        parts = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
        self.buf = buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(parts) else np.zeros(0, np.int64)
        word = np.zeros(len(buf) + 1, bool)
        np.take(_WORD, buf, out=word[1:])
        edge = np.flatnonzero(word[1:] != word[:-1])  # the last byte is a separator
        self.start, self.end = edge[::2], edge[1::2]
        self.bounds = np.append(np.searchsorted(self.start, self.text_start), len(self.start))
        self.hash = _hashes(_LOWER[np.concatenate([buf, np.zeros(8, np.uint8)])], self.start, self.end)

    def __len__(self) -> int:
        return len(self.text_start)

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.bounds[i] : self.bounds[i + 1]]

    def text(self, i: int, j: int) -> str:
        return self.buf[self.start[i] : self.end[j - 1]].tobytes().decode("utf-8", "replace")


_STEP = weights(16, 7)


def shingle_runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs, and each text's bounds among them; a shorter text is one run of all its words."""
    w, b = words.hash, words.bounds
    n = np.diff(b)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(b[:-1], count) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    size = np.minimum(np.repeat(n, count), k)
    total = size.astype(np.uint64) * _STEP[15]
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    for j in range(k):
        total += np.where(j < size, padded[first + j] * _STEP[j], np.uint64(0))
    return mix(total), bounds


def chunks(frames: Iterator[pd.DataFrame], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Cuts batches so that a chunk has about ``most`` characters; a longer text makes a chunk of its own."""
    for frame in frames:
        if not len(frame):
            continue
        size = np.fromiter((len(t) if isinstance(t, str) else 0 for t in frame[column]), np.int64, len(frame))
        cut = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(cut)) + 1), len(frame)]
        for a, b in zip(edges, edges[1:]):
            yield frame.iloc[a:b]
