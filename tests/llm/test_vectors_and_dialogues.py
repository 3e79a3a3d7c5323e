"""Near duplicates, hard negatives and conversation repair against brute force, on awkward rows too."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import dialogue, neardup, negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return a @ b / np.sqrt((a @ a) * (b @ b))


def links(rows, least=0.98):
    """vec_id: (links, component) by all pairs; ids differ."""
    good = [(i, e, l) for i, e, l in rows if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    near = {i: set() for i, _, _ in rows}
    for i, e, l in good:
        for j, f, m in good:
            if i != j and l == m and len(e) == len(f) and cosine(e, f) >= least:
                near[i].add(j)
    out = {}
    for i in near:
        met, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - met
            met |= new
            todo += new
        out[i] = (len(near[i]), min(met))
    return out


def groups(seed=3, n=260, width=12):
    """Vectors around few centres, with exact copies, at all distances from the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, width))
    rows = []
    for i in range(n):
        c = centres[min(i % 20, 7)]
        e = c + rng.standard_normal(width) * rng.choice([0, 0.03, 0.1, 0.2]) * np.linalg.norm(c) / width**0.5
        rows.append((i * 3, [float(np.float32(x)) for x in e * rng.choice([0.01, 1, 50])], int(i % 3)))
    return rows


AWKWARD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 12, 1), (9004, [NAN] + [1.0] * 11, 1), (9005, [INF] + [1.0] * 11, 1), (9006, [None] + [1.0] * 11, 1), (9007, [1.0] * 12, None), (9008, [1.0] * 5, 1), (9009, [2.0] * 5, 1), (9010, [-0.0] + [1.0] * 11, 2), (9011, [0.0] + [1.0] * 11, 2), (9012, [1e30] * 5, 1)]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_duplicates_are_all_pairs(spark, block):
    rows = groups() + AWKWARD
    got = neardup.near_duplicates(spark.createDataFrame(rows, VECTORS), block=block, unit=64).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == links(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_duplicates_of_repeated_and_clashing_rows(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (None, [3.0, 4.0], 1)]
    clash = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit("x") for n in ("node", "keys", "bucket", "n", "root", "links", "component_id")})
    got = sorted(neardup.near_duplicates(clash).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 0, 7, True), (None, 0, None, True)], key=lambda r: f"Row(vec_id={r[0]}, n_links={r[1]}")
    empty = neardup.near_duplicates(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_sign_hashing_recall_at_the_threshold():
    """Pairs right at the threshold, the hardest, meet in some table but for about ``miss`` of them."""
    rng = np.random.default_rng(1)
    bits, tables = neardup.shape(1 << 16, 0.98, 1e-3)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    pair = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    met = (neardup.sign_keys(a, bits, tables) == neardup.sign_keys(pair, bits, tables)).any(1)
    assert met.mean() > 0.99


def brute_negatives(rows, positives=5, k=10):
    good = {}
    for i, e, l in rows:
        if i is not None and l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            good[i, tuple(int(np.floor(256 * float(x))) for x in e), (l + 1) % 10 if i % 7 == 0 else l] = 1
    out = []
    for i, e, l in good:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, m) for j, f, m in good if j != i and len(e) == len(f))
        for s, p, _ in [x for x in scored if x[2] == l][:positives]:
            fits = [(t, j) for t, j, m in scored if m != l and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def negative_rows():
    rng = np.random.default_rng(4)
    rows = [(i * 4, [float(np.float32(x)) for x in rng.standard_normal(6) * 0.4 + (i % 3 == 0)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(i * 100, [0.5] * 6, 2) for i in range(20, 60)] + [(i, [0.5] * 6, 3) for i in range(7001, 7040)]  # equal rows, of anchors and others
    rows += [(8000, [-1.0] * 6, 1), (8100, [1.0, 2.0], 1), (8101, [1.0, 2.5], 1), (8102, [0.5, 1.0], 2), (8200, [], 1), (8201, [], 1), (8202, [], 2)]
    rows += [(8300, None, 1), (8400, [NAN] * 6, 1), (8500, [None] + [1.0] * 5, 1), (8600, [1.0] * 6, None), (None, [0.5] * 6, 1)]
    return [r for i, r in enumerate(rows) if r[0] is None or r[0] not in {q[0] for q in rows[:i]}]


@pytest.mark.parametrize("block", [4096, 8])
def test_hard_negatives_are_exact(spark, block):
    rows = negative_rows()
    df = spark.createDataFrame(rows + rows[:30], VECTORS).withColumns({n: F.lit("x") for n in ("x", "node", "list", "d", "wants", "score")})
    assert sorted(map(tuple, negatives.hard_negatives(df, block=block).collect())) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0
    with pytest.raises(Exception, match="leave a long"):
        negatives.hard_negatives(spark.createDataFrame([(100, [1e15], 1), (2, [1e15], 1)], VECTORS)).count()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, rows = rng.integers(-300, 300, (5, 8)), rng.integers(-300, 300, (50, 8))
    centre = rows.mean(0)[None]
    radius = np.array([np.sqrt(((rows - centre) ** 2).sum(1)).max()])
    low, high = negatives._bounds(x.astype(float), centre, radius)
    scores = x @ rows.T
    assert (low[:, 0] <= scores.min(1)).all() and (high[:, 0] >= scores.max(1)).all()


# -- conversations --------------------------------------------------------------


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def brute_repair(rows):
    """All edit strings by rising cost, until the cheapest are known."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not core else "dup" if (role, text) in seen else "cut" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, found = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if found and cost > found[0]:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (not found or audit < found[1]):
            found = (cost, audit, lines)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, lines))
            if faults[i] in ("", "cut"):
                more = cost + (faults[i] == "cut")
                heapq.heappush(heap, (more, audit + "K", i + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (more + 2, audit + "R", i + 1, initials + name[0], (*lines, f"{name}:{text}")))
        for name in ("user", "assistant") if len(initials) < 2 * len(rows) + 4 else ():
            heapq.heappush(heap, (cost + 2, audit + "I", i, initials + name[0], (*lines, f"{name}:")))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("dup"), faults.count("cut"), sum(p not in ("su", "ua", "au") for p in pairs), found[0], found[1], hashlib.sha256("\n".join(found[2]).encode()).hexdigest())


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("piece", [2, 4096])
def test_repair_is_the_cheapest(spark, piece):
    rng = random.Random(5)
    rows = [(c, rng.choice([t, t, t, t + 1, None, 3 * t]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(["a.", "b!", "c", "", " \t", "a.", None, "d?\n", "e　"])) for c in [None, -3, *range(160)] for t in range(rng.randint(1, 5))]
    rows += rows[:15]
    df = spark.createDataFrame(rows, CONVERSATIONS).withColumns({n: F.lit("x") for n in ("c", "mark", "code", "copies", "rank", "audit")})
    got = {r.conv_id: tuple(r)[1:] for r in dialogue.repair(df, piece).collect()}
    by = {}
    for row in rows:
        by.setdefault(row[0], []).append(row)
    assert set(got) == set(by)
    for c, own in by.items():
        left = damage(own)
        if len(left) <= 6:
            assert got[c] == brute_repair(left), (c, left)


def test_long_conversation_in_pieces_of_any_size(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}", "same."])) for t in range(3000)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    one, many = (dialogue.repair(df, piece).collect() for piece in (1 << 20, 64))
    assert one == many and len(one) == 1


def test_dropped_and_empty_conversations(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = dialogue.repair(spark.createDataFrame([(dropped, 0, "user", "x.")], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert dialogue.repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0
