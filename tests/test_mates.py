"""Walks between mates and merging of pairs against a base-by-base simulation."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import kmers as K, matewalk as MW


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def genome(rng, size=420):
    """A sequence with a repeat and, in a second copy, two differences."""
    parts = ["".join(rng.choice("ACGT") for _ in range(size // 3)) for _ in range(3)]
    one = parts[0] + parts[1] + parts[0][:40] + parts[2]
    two = list(one)
    for at in (size // 3 + 30, size // 2 + 40):
        two[at] = rc(two[at])
    return one, "".join(two)


def library(seed=1, size=40, step=7):
    rng = random.Random(seed)
    reads = []
    for g in genome(rng):
        reads += [g[i : i + size] for i in range(0, len(g) - size + 1, step)]
    reads += [r[:20] + "A" + r[21:] for r in reads[::9]]
    return [r if rng.random() < 0.5 else rc(r) for r in reads]


class Brute:
    """The walk as described, one base a step, by counting substrings of all reads on both strands."""

    def __init__(self, reads):
        self.text = "|".join([*reads, *map(rc, reads)])

    def count(self, s):
        n, at = 0, self.text.find(s)
        while at >= 0:
            n, at = n + 1, self.text.find(s, at + 1)
        return n

    def step(self, leaves, k, support):
        return [p + b for p in leaves for b in "ACGT" if self.count(p[-k:] + b) >= support]

    def touching(self, source, target, m):
        if source[-m:] == target[:m]:
            return source + target[m:]
        p = source.find(target[:m], max(0, len(source) - 200))
        if p >= 0 and target.startswith(source[p:]):
            return source[:p] + target
        q = target.find(source[:m])
        if 0 <= q <= 50 and source.startswith(target[q:]):
            return target[q:]

    def walk(self, source, target, m, most_overlap, support, most_leaves, most_length):
        if min(len(source), len(target)) < m:
            return ("short", None, 0, 0, 0)
        near = self.touching(source, target, m)
        if near is not None:
            return ("overlap", near, 0, 0, 1)
        leaves, k, used, size = [source], m, 0, len(source)
        while leaves and len(leaves) <= most_leaves and size <= most_length:
            new = self.step(leaves, k, support)
            if not new:
                k = m
                new = self.step(leaves, k, support)
            if new:
                k, size = k + 1, size + 1
            leaves = new
            if leaves and k >= most_overlap:
                k = m
            used = max(used, len(leaves))
            done = [p + target[m:] for p in leaves if p.endswith(target[:m])]
            if done:
                cover = {p: sum(self.count(p[i : i + m]) for i in range(0, len(p) - m + 1, max(1, m // 2))) for p in done}
                best = min(done, key=lambda p: (-cover[p], p))
                return ("merged", best, cover[best], used, len(done))
        return ("dead_end" if not leaves else "too_long" if len(leaves) <= most_leaves else "too_many", None, 0, used, 0)


def pairs_of(rng, n=60, insert=75, size=40):
    one, two = genome(random.Random(1))
    out = []
    for i in range(n):
        g = (one, two)[i % 2]
        at = rng.randrange(len(g) - insert)
        out.append((i, f"r{i}/1", g[at : at + size], f"r{i}/2", rc(g[at + insert - size : at + insert])))
    out += [(n, "a/1", one[:40], "a/2", rc(one[:40])), (n + 1, "b/1", one[:40], "b/2", rc(one[10:50])), (n + 2, "c/1", "", "c/2", one[:5]), (n + 3, "d/1", "C" * 40, "d/2", "ACGT" * 10)]
    return out


@pytest.mark.parametrize("limits, tails", [(MW.Limits(13, 30, 3, 4, 100), MW.TAILS), (MW.Limits(15, 22, 2, 2, 70), 3)])
def test_walks_step_base_by_base(spark, monkeypatch, limits, tails):
    monkeypatch.setattr(MW, "TAILS", tails)  # few: m-mers of more tails are counted the other way
    reads = library()
    df = spark.createDataFrame([(i, str(i), r) for i, r in enumerate(reads)], "idx long, id string, seq string")
    rows = []
    for i, _, a, _, b in pairs_of(random.Random(3)):
        rows += [(i, 1, a[: limits.seed], rc(b[: limits.seed]), limits.most_overlap), (i, 2, b[: limits.seed], rc(a[: limits.seed]), limits.most_overlap)]
        rows.append((i, 3, a, rc(b), limits.most_overlap))  # whole mates may touch in other ways
    ends = spark.createDataFrame(rows, "pair_id long, way int, source string, target string, most_overlap int")
    got = MW.walk(ends, MW.Places(df, limits.seed), K.strand_counts(df, limits.seed), limits).collect()
    brute = Brute(reads)
    want = {(i, w): brute.walk(s, t, limits.seed, limits.most_overlap, limits.support, limits.leaves, limits.most_length) for i, w, s, t, _ in rows}
    assert len(got) == len(rows)
    assert {(r.pair_id, r.way): (r.status, r.merged, r.coverage, r.used, r.paths) for r in got} == want
    assert sum(x[0] == "merged" for x in want.values()) > 3 and len({x[0] for x in want.values()}) >= 4


def degrees(reads, k):
    kmers = {s[i : i + k] for r in reads for s in (r, rc(r)) for i in range(len(s) - k + 1)}
    return (lambda x: sum(x[1:] + b in kmers for b in "ACGT")), (lambda x: sum(b + x[:-1] in kmers for b in "ACGT"))


def trim(s, k, after, before):
    head, tail = 0, len(s) - k
    if tail < 0:
        return ""
    if before(s[:k]) == 0:
        head = next((i for i in range(1, tail + 1) if before(s[i : i + k]) >= 2), tail + 1)
    if after(s[tail : tail + k]) == 0:
        tail = next((i for i in range(tail - 1, head - 1, -1) if after(s[i : i + k]) >= 2), head - 1)
    return s[head : tail + k] if head <= tail else ""


def split(s, k, strong, brute_counts, after, before):
    """Parts of a read with the main one's place."""
    n = len(s) - k + 1
    good = [brute_counts(s[i : i + k]) >= strong and brute_counts(rc(s[i : i + k])) >= strong for i in range(n)]
    cuts = [0] + [i for i in range(1, n) if not (good[i - 1] and good[i]) and not (after(s[i - 1 : i - 1 + k]) == 1 and before(s[i : i + k]) == 1)] + [n]
    parts = list(zip(cuts, cuts[1:]))
    most, main = 0, None
    for j, (a, b) in enumerate(parts):
        if any(good[a:b]) and b - 1 - a > most:
            most, main = b - 1 - a, j
    return [s[a : b - 1 + k] for a, b in parts], main


def clean(s):
    runs = max(len(list(g)) for _, g in __import__("itertools").groupby(s))
    return max(map(s.count, "ACGT")) / len(s) < 0.9 and runs * 3 <= len(s)


def test_merging_of_pairs(spark):
    m, k, strong = 13, 11, 2
    limits = MW.Limits(m, 0, 3, 8, 200)
    rows = pairs_of(random.Random(4), 30)
    rows += [(100 + i, f"e{i}/x", a[:18] + rc(a[18]) + a[19:], f"e{i}/y", b) for i, _, a, _, b in rows[:15]]  # errors cut mates
    reads = library(step=4) + [r[2] for r in rows if r[0] >= 100]
    df = spark.createDataFrame([(i, str(i), r) for i, r in enumerate(reads)], "idx long, id string, seq string")
    merger = MW.Merger(spark.createDataFrame(rows, "pair_id long, name1 string, first string, name2 string, second string"), df, limits, k, strong)
    brute, (after, before) = Brute(reads), degrees(reads, k)
    forward = "|".join(reads)
    single = Brute(reads)
    single.text = forward
    counts = sorted(brute.count(r[i : i + m]) for r in reads for i in range(len(r) - m + 1))
    cutoff = counts[len(counts) // 2] * 13 // 10

    def merged(row, hybrid):
        a, b = (trim(s, k, after, before) for s in (row[2], row[4]))
        if min(len(a), len(b)) < m or any(brute.count(s[:m] if hybrid else s) >= cutoff for s in (a, b)):
            return None
        size = (len(row[2]) + len(row[4])) // 2
        most = int(size * (0.95 if hybrid else 0.9))
        x, y = (brute.walk(s[:m], rc(t[:m]), m, most, 3, 8, 200) for s, t in ((a, b), (b, a)))
        found = None
        if (x[1] is None) != (y[1] is None):
            found = (x[1] or y[1]) if max(x[3], y[3]) <= 1 else None
        elif x[1] and (x[1] == rc(y[1]) if hybrid else len(x[1]) == len(y[1])):
            found = x[1] if x[2] > y[2] else y[1]
        return found if found and (hybrid or len(found) > most) else None

    alone = [(r[1].split("/")[0], merged(r, False)) for r in rows]
    got, said = merger.merge_only()
    assert sorted(map(tuple, got.collect())) == sorted(x for x in alone if x[1]) and sum(x[1] is not None for x in alone) > 5
    n = sum(x[1] is not None for x in alone)
    assert tuple(said.first()) == (n, 0, 2 * (len(rows) - n))

    whole, parts, cut, failed = [], [], 0, 0
    for r in rows:
        found = merged(r, True)
        if found:
            whole.append((r[1].split("/")[0], found))
            continue
        for name, s in ((r[1], r[2]), (r[3], r[4])):
            s = trim(s, k, after, before)
            if len(s) < k:
                failed += 1
                continue
            cut += 1
            own, main = split(s, k, strong, single.count, after, before)
            others = [p for j, p in enumerate(own) if j != main and clean(p)]
            parts += [(f"{name}:{j}", p) for j, p in enumerate(others)]
            if main is not None and clean(own[main]):
                parts.append((name, own[main]))
    got, left, said = merger.hybrid()
    assert sorted(map(tuple, got.collect())) == sorted(whole) and len(whole) > 5
    assert sorted(map(tuple, left.collect())) == sorted(parts) and len(parts) > 20
    assert tuple(said.first()) == (len(whole), cut, failed) and failed
