"""Exact n-gram Jaccard join with signature trees.

A document's set has the 64-bit hashes of its distinct shingles; documents with
equal sets are one class. Two sets link when 100 * intersection >= 75 * union.

1. Shingles that many documents share are counted (heavy hitters of bounded
   number). They come last in the order of shingles, rare ones first by hash.
2. Of each set the prefix that two linked sets must share, a bitmap of its
   shingles and its size are kept (a quarter of the set).
3. Sets with the same least hash and like bitmaps form the leaves of
   signature trees: bitmaps OR-combined, ranges of sizes, union of prefixes.
4. Leaves that share as many prefix shingles as linked sets must, and can link
   by size, are paired; pairs whose bitmaps bound the overlap below need are
   pruned.
5. Connected leaves form candidate groups. Each group's sets are sent once to
   one task (a large group to the tasks of its block pairs), which builds the
   tree's upper levels and traverses it against itself, pruning node pairs by
   the largest overlap that their bitmaps and sizes allow. What is left is
   verified on the sets.
6. Links make components.

No step samples or caps: the order of shingles and the bitmaps only decide how
much is pruned. Distinct 64-bit hashes are taken for distinct shingles.

Null texts and texts without words have the empty set, link with nothing and
are their own component. Repeated rows and equal texts are linked. A null id
isn't taken as a component's id unless the component has no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.graph import components
from strandloom.llm.storage import durable, fresh, split
from strandloom.llm.text import Words, chunks, mix, shingle_runs

#: Fixed values of the contract: SHARE / 100 of the union must be common.
WORDS, SHARE = 5, 75
LEAF, FAN = 256, 8
#: Tells the rows of one id apart by their texts.
ROW = "xxhash64(doc_id, text)"
#: Node pairs that the dual traversal opens at once.
SLICE = 1 << 12


def _sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    runs, bounds = shingle_runs(Words(texts), words)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(runs[a:b])


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(frame: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame["text"]]


def heavy_shingles(docs: DataFrame, words: int = WORDS, least: int = 3, flush: int = 1 << 21, most: int = 1 << 18) -> np.ndarray:
    """Shingles that are frequent within runs of ``flush`` shingles, in rising order of their counts; ``most`` at most. Guides the order of shingles only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seen = [], 0, set()

        def count() -> pd.DataFrame:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= least
            return pd.DataFrame({"h": value[keep].view(np.int64), "n": n[keep]})

        for piece in chunks(frames):
            for s in _sets(_texts(piece), words):
                key = _digest(s)
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size >= flush:
                yield count()
                held, size, seen = [], 0, set()
        if held:
            yield count()

    found = docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toPandas()
    return found["h"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


def _leads(s: np.ndarray) -> tuple[int, int]:
    """The least hashes under two functions. Near copies mostly have the same."""
    return int(s[:1].view(np.int64)[0]), int(mix(s * np.uint64(0x9E3779B97F4A7C15)).min() >> np.uint64(1))


def _bits(n: int) -> int:
    return max(64, 1 << (4 * n - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(s >> np.uint64(20)) & np.uint64(bits - 1)] = True
    return np.packbits(out, bitorder="little")


def fold(b: np.ndarray, size: int) -> np.ndarray:
    """Shorter bitmaps of the same set are folds of longer ones."""
    return np.bitwise_or.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b


def _ones(b: np.ndarray) -> int:
    return int(np.bitwise_count(b).sum())


def prefix_size(n: int) -> int:
    return n - (SHARE * n + 99) // 100 + 1


def profiles(docs: DataFrame, heavy: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, row (hash of id and text), n_shingles, sid (digest of the set), lead, second, ones, prefix, bits. The last five are null on all but a task's first row of a set."""
    rank = np.argsort(heavy)
    sent = docs.sparkSession.sparkContext.broadcast((heavy[rank], rank))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, place = sent.value
        seen: set[int] = set()
        for piece in chunks(frames):
            rows = []
            for doc, row, s in zip(piece["doc_id"], piece["row"], _sets(_texts(piece), words)):
                sid, lead, second, ones, prefix, bits = _digest(s), None, None, None, None, None
                if len(s) and sid not in seen:
                    seen.add(sid)
                    p = prefix_size(len(s))
                    if len(common):
                        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        hot = common[at] == s
                        first = s[~hot][:p]
                        if len(first) < p:
                            late = s[hot]
                            first = np.concatenate([first, late[np.argsort(place[at[hot]], kind="stable")][: p - len(first)]])
                    else:
                        first = s[:p]
                    (lead, second), prefix, bits = _leads(s), _short(first), bitmap(s, _bits(len(s)))
                    ones, bits = _ones(bits), bits.tobytes()
                rows.append((doc, row, len(s), sid, lead, second, ones, prefix, bits))
            out = pd.DataFrame(rows, columns=["doc_id", "row", "n_shingles", "sid", "lead", "second", "ones", "prefix", "bits"])
            for c in ("doc_id", "lead", "second", "ones"):
                out[c] = out[c].astype("Int64")
            yield out

    return docs.select("doc_id", "text", F.expr(ROW).alias("row")).mapInPandas(run, "doc_id long, row long, n_shingles long, sid long, lead long, second long, ones long, prefix binary, bits binary")


def _short(tokens: np.ndarray) -> bytes:
    """Six bytes of each hash are enough to find candidates; equal ones that aren't equal whole cost only a check."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


_NODE = ["leaf", "second", "members", "low", "high", "slack", "prefix", "bits"]


def _alike(one: tuple, two: tuple) -> bool:
    """Loosely, by bitmaps of one length: copies of copies share a node, sets that share only a passage don't."""
    if len(one[7]) != len(two[7]) or SHARE * two[4] > 100 * one[3] or SHARE * one[4] > 100 * two[3]:
        return False
    return 10 * overlap_bound(np.frombuffer(one[7], np.uint8), one[5], np.frombuffer(two[7], np.uint8), two[5]) >= 6 * min(one[3], two[3])


def _merge(held: list[tuple]) -> tuple:
    if len(held) == 1:
        return held[0]
    members = [m for h in held for m in h[2]]
    prefix = _short(np.unique(np.concatenate([_long(h[6]) for h in held])))
    bits = np.bitwise_or.reduce([np.frombuffer(h[7], np.uint8) for h in held]).tobytes()
    return held[0][0], held[0][1], members, min(h[3] for h in held), max(h[4] for h in held), max(h[5] for h in held), prefix, bits


def _gather(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes of one key that are like the first of them become one, of at most LEAF sets. Rows of a key are dealt to two places, so a frequent one isn't one task's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size, its = 0, None
        for frame in frames:
            out = []
            for k, *row in zip(frame[key], *(frame[c] for c in _NODE)):
                if held and k == its and row[0] == held[-1][0]:
                    continue  # another task's row of the same set
                row[2] = list(row[2])
                if held and (k != its or size + len(row[2]) > LEAF or not _alike(held[0], row)):
                    out.append(_merge(held))
                    held, size = [], 0
                its = k
                held.append(tuple(row))
                size += len(row[2])
            yield pd.DataFrame(out, columns=_NODE)
        if held:
            yield pd.DataFrame([_merge(held)], columns=_NODE)

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = dict.fromkeys([key, "second", "low", "leaf"])
    dealt = nodes.repartition(parts, key, F.pmod("leaf", F.lit(2))).sortWithinPartitions(*order)
    return dealt.mapInPandas(run, "leaf long, second long, members array<long>, low long, high long, slack long, prefix binary, bits binary")


def leaves(sets: DataFrame) -> DataFrame:
    """leaf, members, low, high, slack, prefix, bits: like sets of one least hash, then like nodes of one second least hash, as near copies differ in one of the two at times but seldom in both. slack: most shingles of a set beyond its bits."""
    slack = F.col("n_shingles") - F.col("ones")
    rows = sets.select("lead", F.col("sid").alias("leaf"), "second", F.array("sid").alias("members"), F.col("n_shingles").alias("low"), F.col("n_shingles").alias("high"), slack.alias("slack"), "prefix", "bits")
    return _gather(_gather(rows, "lead"), "second").drop("second")


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as planes of their bytes, lowest first; those of small numbers are zero and pack to nothing in the shuffle."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _post(parts: int):
    """Prefixes dealt by shingle: a row for a part and batch with its leaves and their shingles, packed. With more parts a leaf is told in more of them, so what is told beside its id is kept small."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lists = [_long(p) for p in frame["prefix"]]
            if not lists:
                continue
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            token = np.concatenate(lists)
            part = ((token & np.uint64(0xFFFF)) * np.uint64(parts)) >> np.uint64(16)
            order = np.argsort(part, kind="stable")
            token, owner, edge = (token[order] >> np.uint64(16)).astype(np.uint32), owner[order], np.searchsorted(part[order], np.arange(parts + 1))
            leaf, low, high = (frame[c].to_numpy() for c in ("leaf", "low", "high"))
            rows = []
            for p in range(parts):
                a, b = edge[p], edge[p + 1]
                if a < b:
                    own, count = np.unique(owner[a:b], return_counts=True)
                    rows.append((p, leaf[own].tobytes(), _planes(low[own]), _planes(high[own] - low[own]), _planes(count), token[a:b].tobytes()))
            yield pd.DataFrame(rows, columns=["part", "leaf", "low", "wider", "count", "token"])

    return run


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of leaves that share a shingle and can link by size, once in a part, with the prefix shingles they share there.

    Of two linked sets of s <= h shingles, let the prefix of one end first, at
    most 3h/4 of its set being behind it. They share 3(s + h)/7 or more, so more
    than 3s/7 - 9h/28 of both prefixes: 28 * shared > 12s - 9h = need.
    """
    get = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
    small = lambda c: np.concatenate([_of_planes(x) for x in rows[c]])
    leaf, low = get("leaf", np.int64), small("low")
    high = low + small("wider")
    owner = np.repeat(np.arange(len(leaf), dtype=np.int64), small("count"))
    token = get("token", np.uint32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(start, len(token)))
    last = np.repeat(start + size, size)  # end of each entry's run
    at = np.flatnonzero(np.repeat(size, size) > 1)
    met, shared, held, step = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def count() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([met, *held]), return_inverse=True)
        weight = np.concatenate([shared, *[np.ones(len(h), np.int64) for h in held]])
        return key, np.bincount(inverse, weight, minlength=len(key)).astype(np.int64)

    while len(at):
        step += 1
        at = at[at + step < last[at]]
        x, y = owner[at], owner[at + step]
        ok = (x != y) & (100 * high[x] >= SHARE * low[y]) & (100 * high[y] >= SHARE * low[x])
        x, y = x[ok], y[ok]
        held.append(np.minimum(x, y) * len(leaf) + np.maximum(x, y))
        if sum(map(len, held)) > 1 << 21:
            met, shared = count()
            held = []
    met, shared = count()
    x, y = met // max(1, len(leaf)), met % max(1, len(leaf))
    need = 12 * np.minimum(low[x], low[y]) - 9 * np.maximum(high[x], high[y])
    a, b = leaf[x], leaf[y]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "shared": shared, "need": need})


def overlap_bound(one: np.ndarray, slack_one: int, two: np.ndarray, slack_two: int) -> int:
    """Most shingles that a set under one node can share with a set under the other."""
    if len(one) < len(two):
        one, slack_one, two, slack_two = two, slack_two, one, slack_one
    common = _ones(fold(one, len(two)) & two)
    return common + (min(slack_one, slack_two) if len(one) == len(two) else slack_two)


def _prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        keep = [
            175 * overlap_bound(np.frombuffer(x, np.uint8), sx, np.frombuffer(y, np.uint8), sy) >= 75 * (lx + ly)
            for x, sx, lx, y, sy, ly in zip(f["bits_a"], f["slack_a"], f["low_a"], f["bits_b"], f["slack_b"], f["low_b"])
        ]
        yield f.loc[keep, ["a", "b"]]


def candidate_pairs(tree: DataFrame, part_tokens: int = 1 << 20) -> DataFrame:
    """Pairs of leaves that may hold linked sets. Parts are as many as the prefixes need at ``part_tokens`` shingles each, whatever the number of shuffle partitions, so that a part stays small and a pair is met in few."""
    total = tree.agg(F.sum(F.length("prefix"))).first()[0] or 0
    parts = max(1, -(-total // (6 * part_tokens)))
    posted = tree.select("leaf", "low", "high", "prefix").mapInPandas(_post(parts), "part int, leaf binary, low binary, wider binary, count binary, token binary")
    met = posted.groupBy("part").applyInPandas(_meet, "a long, b long, shared long, need long")
    met = met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).filter(28 * F.col("shared") > F.col("need")).select("a", "b")
    side = lambda c: tree.select(F.col("leaf").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("slack").alias(f"slack_{c}"), F.col("low").alias(f"low_{c}"))
    return durable(met, "pairs").join(side("a"), "a").join(side("b"), "b").mapInPandas(_prune, "a long, b long")


class Tree:
    """Levels of nodes over sets in order of size; level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        bits = _bits(int(np.median(n)))
        base = np.array([bitmap(s, bits) for s in sets])
        self.levels = [(base, n, n, n - np.bitwise_count(base).sum(1))]
        while len(self.levels[-1][0]) > FAN:
            b, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))

    def survivors(self, level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, low, high, slack = self.levels[level]
        ok = (100 * high[x] >= SHARE * low[y]) & (100 * high[y] >= SHARE * low[x])
        x, y = x[ok], y[ok]
        keep = np.zeros(len(x), bool)
        room = max(1, (8 << 20) // b.shape[1])
        for at in range(0, len(x), room):
            i, j = x[at : at + room], y[at : at + room]
            most = np.bitwise_count(b[i] & b[j]).sum(1) + np.minimum(slack[i], slack[j])
            keep[at : at + room] = 175 * most >= 75 * (low[i] + low[j])
        return x[keep], y[keep]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal from the root against itself; set pairs x < y that no bound excludes. Goes depth first in slices, so a level never holds more than one slice's children."""
        top = len(self.levels) - 1
        k = len(self.levels[top][0])
        return self._below(top, *np.triu_indices(k, 1 if top == 0 else 0))

    def _below(self, level: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = self.survivors(level, x, y)
        if level == 0:
            if len(x):
                yield x, y
            return
        width = len(self.levels[level - 1][0])
        for at in range(0, len(x), SLICE):
            i = (x[at : at + SLICE, None, None] * FAN + np.arange(FAN)[None, :, None]) + np.zeros((1, 1, FAN), np.int64)
            j = (y[at : at + SLICE, None, None] * FAN + np.arange(FAN)[None, None, :]) + np.zeros((1, FAN, 1), np.int64)
            i, j = i.ravel(), j.ravel()
            ok = (i < width) & (j < width) & ((i < j) if level == 1 else (i <= j))
            yield from self._below(level - 1, i[ok], j[ok])


def _verify(sid: np.ndarray, block: np.ndarray, copies: np.ndarray, tokens: list[np.ndarray], cross: bool) -> pd.DataFrame:
    """Links of the sets of a group (between its two blocks if ``cross``): sid, links, root."""
    order = np.argsort([len(t) for t in tokens], kind="stable")
    sid, block, copies, tokens = sid[order], block[order], copies[order], [tokens[i] for i in order]
    k = len(sid)
    links, parent = np.zeros(k, np.int64), list(range(k))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    size = np.array([len(t) for t in tokens])
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(tokens), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(ids.max()) + 1, bool)
    for xs, ys in Tree(tokens).pairs():
        if cross:
            ok = block[xs] != block[ys]
            xs, ys = xs[ok], ys[ok]
        by = np.argsort(xs, kind="stable")
        xs, ys = xs[by], ys[by]
        edge = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]])) if len(xs) else []
        for a, b in zip(edge, [*edge[1:], len(xs)]):
            x, y = int(xs[a]), ys[a:b]
            own = ids[start[x] : start[x + 1]]
            mark[own] = True
            n = size[y]
            flat = ids[np.repeat(start[y] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common = np.add.reduceat(mark[flat].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            hit = y[100 * common >= SHARE * (size[x] + n - common)]
            links[x] += copies[hit].sum()
            links[hit] += copies[x]
            for i in map(int, hit):
                one, two = root(x), root(i)
                if one != two:
                    parent[max(one, two)] = min(one, two)
    least: dict[int, int] = {}
    tops = [root(i) for i in range(k)]
    for i, t in enumerate(tops):
        least[t] = min(least.get(t, sid[i]), sid[i])
    return pd.DataFrame({"sid": sid, "links": links, "root": [least[t] for t in tops]})


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group; a group is verified as soon as its last row is there."""
    key, held = None, []

    def done() -> pd.DataFrame:
        sid = np.array([h[0] for h in held])
        return _verify(sid, np.array([h[1] for h in held]), np.array([h[2] for h in held]), [np.frombuffer(h[3], np.uint64) for h in held], key[1] != key[2])

    for f in frames:
        for comp, i, j, sid, block, copies, tokens in zip(f["comp"], f["i"], f["j"], f["sid"], f["block"], f["copies"], f["tokens"]):
            if key != (comp, i, j):
                if len(held) > 1:
                    yield done()
                key, held = (comp, i, j), []
            if not held or held[-1][0] != sid:  # rows of one set are next to each other
                held.append((sid, block, copies, tokens))
    if len(held) > 1:
        yield done()


def _token_sets(docs: DataFrame, wanted: DataFrame, words: int, bits: int = 24) -> DataFrame:
    """sid, tokens of documents whose id passes a bit table of the wanted ids (2^bits bits, whatever their number); few others pass, and the join on sid drops them."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    rows = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 31 as int)))").alias("v")).toPandas()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        for frame in frames:
            s = frame["s"].to_numpy(np.int64)
            for piece in chunks([frame[(table[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1]]):
                found = list(_sets(_texts(piece), words))
                yield pd.DataFrame({"sid": [_digest(x) for x in found], "tokens": [x.tobytes() for x in found]})

    return docs.select("text", slot.alias("s")).mapInPandas(run, "sid long, tokens binary")


def join(docs: DataFrame, words: int = WORDS, group_shingles: int = 1 << 21) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row. n_links counts all other rows that a row links with, copies included."""
    return _joined(docs, words, group_shingles).select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(docs: DataFrame, words: int, group_shingles: int) -> DataFrame:
    """As ``join``, with row and root, which tells components apart whose least id is the same."""
    held = durable(profiles(docs, heavy_shingles(docs, words), words), "profiles")
    full = held.filter(F.col("n_shingles") > 0)
    classes = durable(full.groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"), F.min(F.when(F.col("lead").isNotNull(), F.col("doc_id"))).alias("carrier")), "classes")
    tree = durable(leaves(full.filter(F.col("lead").isNotNull()).select("sid", "n_shingles", "lead", "second", "ones", "prefix", "bits")), "leaves")
    tied = components(candidate_pairs(tree))
    alone = tree.filter(F.size("members") > 1).select(F.col("leaf").alias("node"))
    group = tied.unionAll(alone.join(tied, "node", "left_anti").select("node", F.col("node").alias("root")))
    member = group.join(tree.select(F.col("leaf").alias("node"), "members"), "node").select(F.col("root").alias("comp"), F.explode("members").alias("sid"))
    member = durable(member.join(classes.select("sid", "copies", "n", "carrier"), "sid"), "members")
    blocks = member.groupBy("comp").agg(F.sum("n").alias("total")).select("comp", F.ceil(F.col("total") / group_shingles).cast("int").alias("blocks"))
    placed = member.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    sets = _token_sets(docs, member.select(F.col("carrier").alias("doc_id")), words)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.join(sets, "sid").withColumn("o", other).select("comp", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "sid", "block", "copies", "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checked = dealt.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "sid").mapInPandas(_groups, "sid long, links long, root long")
    checked = durable(checked, "checked")
    links = checked.groupBy("sid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if blocks.filter(F.col("blocks") > 1).limit(1).count():
        roots = components(checked.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid").withColumnRenamed("root", "top")
        links = links.drop("root").join(roots, "sid", "left").select("sid", "links", F.coalesce("top", "sid").alias("root"))
    found = classes.join(links, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "root", "component_id", "n_links")
    out = held.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("sid")).alias("sid")).join(found, "sid", "left")
    return out.select("doc_id", "row", "root", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, words: int = WORDS, group_shingles: int = 1 << 21) -> DataFrame:
    """One row of each component, with all columns as they were: that of the least id (no id counts as the largest) and, of several texts of that id, of the least hash.

    Rows are told apart by id and text, so another text under the id of a dropped
    row stays. Of repeated rows one stays, that whose other columns come first as
    JSON. Rows without words link with nothing and all stay.
    """
    found = durable(_joined(docs, words, group_shingles).filter(F.col("n_shingles") > 0).select("root", "doc_id", "row"), "decisions")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    chosen = first.select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    times = found.groupBy("row").agg(F.count("*").alias("times")).join(chosen, "row", "left")
    row, stays, turn, *marks = fresh(docs, "_row", "_stays", "_turn", "_slot", "_word", "_bits")
    moot = durable(times.filter(F.col("stays").isNull() | (F.col("times") > 1)).select(F.col("row").alias(row), F.coalesce("stays", F.lit(False)).alias(stays)), "moot")
    names = [F.col(f"`{c}`") for c in docs.columns]
    free, held = split(docs.withColumn(row, F.expr(ROW)), row, moot, marks)
    held = held.join(moot, row, "left").filter(F.coalesce(stays, F.lit(True)))
    if moot.filter(F.col(stays)).limit(1).count():
        others = F.to_json(F.struct(*[c for c, name in zip(names, docs.columns) if name not in ("doc_id", "text")]))
        place = F.row_number().over(Window.partitionBy(row).orderBy(others))
        held = held.withColumn(turn, place).filter((F.col(turn) == 1) | F.col(stays).isNull())
    return free.select(*names).unionAll(held.select(*names))
