"""Arrow functions of sequences and scores, batches at a time: what would be interpreted base by base in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from strandloom.functions import flat

INTS = T.ArrayType(T.IntegerType())
#: What a letter adds to its score.
OF_BASE = (np.arange(256) * 7 % 41).astype(np.uint8)
OPERATIONS = np.frombuffer(b"MIDNSHP=X", np.uint8)


def _ints(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int32))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def _given(a: pa.Array) -> int:
    """A constant argument."""
    return a[0].as_py() if len(a) else 0


def _trimer_pairs(two: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Pairs of equal trimers of each row of 2-bit codes, without its last trimer."""
    n = np.diff(bounds)
    counted = np.ones(len(two), bool)
    for j in range(1, 4):  # no trimer that counts begins at a row's last three places
        counted[bounds[1:][n >= j] - j] = False
    trimer = np.zeros(len(two), np.int32)
    trimer[:-2] = (two[:-2] << 4) | (two[1:-1] << 2) | two[2:]
    key = np.repeat(np.arange(len(n), dtype=np.int32) << 6, np.maximum(n - 3, 0)) + trimer[counted]
    times = np.bincount(key, minlength=len(n) << 6).reshape(len(n), 64)
    return (np.einsum("ij,ij->i", times, times) - np.maximum(n - 3, 0)) / 2.0


def _dust(seq: pa.Array) -> pa.Array:
    codes, bounds = flat.text(seq)
    n = np.diff(bounds)
    two = flat.TWO_BITS[codes] if codes.dtype == np.uint8 else None
    if two is not None and two.max(initial=0) < 4:
        return flat.where_valid(pa.array(np.where(n < 3, 0.0, _trimer_pairs(two, bounds) / np.maximum(n - 2, 1))), seq)
    if codes.dtype != np.uint8:  # few and far between: letters by their rank
        codes = np.unique(codes, return_inverse=True)[1]
    bits = np.int64(max(7, int(codes.max(initial=0)).bit_length()))
    row, place = flat.rows(bounds)
    at = np.flatnonzero(place <= n[row] - 4)
    c = codes.astype(np.int64)
    trimer = (c[at] << bits | c[at + 1]) << bits | c[at + 2]
    order = np.lexsort((trimer, row[at])) if 3 * bits + int(len(n)).bit_length() > 62 else None
    if order is None:
        key = np.sort(row[at] << 3 * bits | trimer)
        fresh, of = key[1:] != key[:-1], key >> 3 * bits
    else:
        of, trimer = row[at][order], trimer[order]
        fresh = (of[1:] != of[:-1]) | (trimer[1:] != trimer[:-1])
    start = np.flatnonzero(np.concatenate([[True], fresh])) if len(at) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(at)))
    total = np.bincount(of[start], times * (times - 1) / 2, minlength=len(n))
    return flat.where_valid(pa.array(np.where(n < 3, 0.0, total / np.maximum(n - 2, 1))), seq)


@F.arrow_udf(T.DoubleType())
def dust(seq: pa.Array) -> pa.Array:
    return flat.pieces(_dust, seq)


def _runs(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal letters within a row begin, and their lengths."""
    start = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(codes)))


def _longest_run(seq: pa.Array) -> pa.Array:
    codes, bounds = flat.text(seq)
    row, _ = flat.rows(bounds)
    start, size = _runs(codes, row)
    most = np.zeros(len(seq), np.int64)
    base = np.isin(codes[start], flat.BASES)
    np.maximum.at(most, row[start[base]], size[base])
    return _ints(most)


@F.arrow_udf(T.IntegerType())
def longest_run(seq: pa.Array) -> pa.Array:
    return flat.pieces(_longest_run, seq)


def _placed(one: np.ndarray, first: np.ndarray, other: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first n letters of two texts a row, side by side, and their rows."""
    row, place = flat.rows(np.concatenate([[0], np.cumsum(n)]))
    return one[first[row] + place], other[second[row] + place], row


def _hamming(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    (one, first), (two, second) = flat.text(a), flat.text(b)
    size = np.maximum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False), 0)
    short, long = np.minimum(np.diff(first), np.diff(second)), np.maximum(np.diff(first), np.diff(second))
    x, y, row = _placed(one, first, two, second, np.minimum(short, size))
    beyond = np.minimum(long, size) - np.minimum(short, size)  # a base against nothing
    return flat.where_valid(_ints(np.bincount(row[x != y], minlength=len(a)) + beyond), a, b, n)


@F.arrow_udf(T.IntegerType())
def hamming(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    return flat.pieces(_hamming, a, b, n)


def _diff_string(a: pa.Array, b: pa.Array) -> pa.Array:
    (one, first), (two, second) = flat.text(a), flat.text(b)
    size = np.minimum(np.diff(first), np.diff(second))
    x, y, _ = _placed(one, first, two, second, size)
    return flat.strings(np.where(x == y, y.dtype.type(ord(".")), y), np.concatenate([[0], np.cumsum(size)]))


@F.arrow_udf(T.StringType())
def diff_string(a: pa.Array, b: pa.Array) -> pa.Array:
    return flat.pieces(_diff_string, a, b)


def _scores(seq: pa.Array) -> pa.Array:
    codes, bounds = flat.text(seq)
    n = np.diff(bounds)
    if codes.dtype == np.uint8 and len(n) and n[0] and (n == n[0]).all():  # most windows are of one size
        found = (OF_BASE[codes].reshape(-1, n[0]) + (np.arange(1, n[0] + 1) * 13 % 41).astype(np.uint8)).reshape(-1)
        found -= np.uint8(41) * (found >= 41)
    else:
        found = (codes.astype(np.int64) * 7 + (flat.rows(bounds)[1] + 1) * 13) % 41
    return flat.where_valid(_lists(found, bounds), seq)


@F.arrow_udf(INTS)
def scores(seq: pa.Array) -> pa.Array:
    """Numbers from 0 to 40 that follow from base and place."""
    return flat.pieces(_scores, seq)


def _phred(qual: pa.Array, offset: int) -> pa.Array:
    codes, bounds = flat.text(qual)
    return _lists(codes.astype(np.int32) - offset, bounds)


@F.arrow_udf(INTS)
def phred(qual: pa.Array, offset: pa.Array) -> pa.Array:
    return flat.pieces(lambda q: _phred(q, _given(offset)), qual)


def _phred_string(q: pa.Array, plus: int, top: int) -> pa.Array:
    if q.flatten().null_count:  # nulls have no letter
        q = pa.array([None if x is None else [v for v in x if v is not None] for x in q.to_pylist()], q.type)
    values, bounds = flat.numbers(q)
    codes = np.minimum(values.astype(np.int64), top) + plus
    if len(codes) and codes.min() < 0:  # nor have negative ones
        row, _ = flat.rows(bounds)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[codes >= 0], minlength=len(q)))])
        codes = codes[codes >= 0]
    codes &= 255
    return flat.where_valid(flat.strings(codes.astype(np.uint8 if codes.max(initial=0) < 128 else np.uint32), bounds), q)


@F.arrow_udf(T.StringType())
def phred_string(q: pa.Array, offset: pa.Array, most: pa.Array) -> pa.Array:
    plus, top = _given(offset), _given(most)
    return flat.pieces(lambda q: _phred_string(q, plus, top), q)


def _at_most(q: pa.Array, top: int) -> pa.Array:
    bounds = flat.numbers(q)[1]
    low = pc.fill_null(pc.less_equal(q.flatten(), top), False).to_numpy(zero_copy_only=False)
    sums = np.concatenate([[0], np.cumsum(low, dtype=np.int64)])
    return flat.where_valid(_ints(np.diff(sums[bounds])), q)


@F.arrow_udf(T.IntegerType())
def at_most(q: pa.Array, most: pa.Array) -> pa.Array:
    """How many numbers are at most a given one."""
    top = _given(most)
    return flat.pieces(lambda q: _at_most(q, top), q)


def _total(q: pa.Array) -> pa.Array:
    values, bounds = flat.numbers(q)
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return flat.where_valid(_ints(np.diff(sums[bounds])), q)


@F.arrow_udf(T.IntegerType())
def total(q: pa.Array) -> pa.Array:
    """The sum of a list."""
    return flat.pieces(_total, q)


def _greatest(q: pa.Array) -> pa.Array:
    """The largest number of each list; null for an empty one. Lists hold no nulls."""
    values, bounds = flat.numbers(q)
    has = np.flatnonzero(np.diff(bounds))
    found = np.zeros(len(q), np.int64)
    if len(has):
        found[has] = np.maximum.reduceat(values, bounds[has])
    return pa.array(found.astype(np.int32), mask=np.diff(bounds) == 0)


def _soft_clip(q: pa.Array, least: int) -> pa.Array:
    values, bounds = flat.numbers(q)
    n = np.diff(bounds)
    kept, has = n.copy(), np.flatnonzero(n)
    if len(has):
        row, place = flat.rows(bounds)
        sums = np.concatenate([[0], np.cumsum(least - values.astype(np.int64))])
        after = sums[bounds[1:]][row] - sums[:-1]  # from a place to the end
        best = np.zeros(len(n), np.int64)
        best[has] = np.maximum.reduceat(after, bounds[has])
        at = np.zeros(len(n), np.int64)
        top = np.flatnonzero(after == best[row])
        at[row[top]] = place[top]  # the last one stays
        low = np.zeros(len(n), bool)
        low[has] = values[bounds[has + 1] - 1] < least
        kept = np.where(low & (best > 0), at, n)
    return flat.where_valid(_ints(kept), q)


@F.arrow_udf(T.IntegerType())
def soft_clip(q: pa.Array, trim: pa.Array) -> pa.Array:
    least = _given(trim)
    return flat.pieces(lambda q: _soft_clip(q, least), q)


def _compact_cigar(a: pa.Array) -> pa.Array:
    codes, bounds = flat.text(a)
    row, _ = flat.rows(bounds)
    start, size = _runs(codes, row)
    known = np.isin(codes[start], OPERATIONS)
    start, size = start[known], size[known]
    kinds, which = np.unique(size * 128 + codes[start], return_inverse=True)
    words = pa.array([f"{k // 128}{chr(k % 128)}" for k in kinds.tolist()], pa.string()).take(pa.array(which))
    data, ends = flat.text(words)
    counts = np.concatenate([[0], np.cumsum(np.bincount(row[start], minlength=len(a)))])
    return flat.where_valid(flat.strings(data, ends[counts]), a)


@F.arrow_udf(T.StringType())
def compact_cigar(a: pa.Array) -> pa.Array:
    return flat.pieces(_compact_cigar, a)


def _expand_cigar(a: pa.Array) -> pa.Array:
    codes, bounds = flat.text(a)
    row, _ = flat.rows(bounds)
    digit = (codes >= 48) & (codes <= 57)
    places = np.arange(len(codes))
    blank = np.maximum.accumulate(np.where(digit, -1, places)) if len(codes) else places
    at = np.flatnonzero(np.isin(codes, OPERATIONS) & (places > bounds[row]))
    at = at[digit[at - 1]]
    begin = np.maximum(blank[at - 1] + 1, bounds[row[at]])
    times = np.zeros(len(at), np.int64)
    for j in range(int((at - begin).max(initial=0))):
        more = begin + j < at
        times[more] = times[more] * 10 + codes[begin[more] + j] - 48
    sizes = np.bincount(row[at], times, minlength=len(a)).astype(np.int64)
    return flat.where_valid(flat.strings(np.repeat(codes[at], times), np.concatenate([[0], np.cumsum(sizes)])), a)


@F.arrow_udf(T.StringType())
def expand_cigar(a: pa.Array) -> pa.Array:
    return flat.pieces(_expand_cigar, a)


@F.arrow_udf(T.IntegerType())
def end_overlap(one: pa.Array, two: pa.Array, least: pa.Array) -> pa.Array:
    """The longest end, of at least ``least`` letters, of one text that begins the other; null if there is none."""
    small = _given(least)

    def longest(a: str | None, b: str | None) -> int | None:
        if a is None or b is None or len(b) < small:
            return None
        seed = b[:small]
        at = a.find(seed, max(0, len(a) - len(b)))
        while at >= 0:
            if b.startswith(a[at:]):
                return len(a) - at
            at = a.find(seed, at + 1)
        return None

    return pa.array([longest(a, b) for a, b in zip(one.to_pylist(), two.to_pylist())], pa.int32())
