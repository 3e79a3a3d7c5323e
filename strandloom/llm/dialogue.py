"""Conversation repair: the cheapest edits that make roles alternate, with an audit of the edits.

A repaired conversation's role initials are ``(s?(ua)+)?``. While rows are read
in order, the initials so far leave one of four states: nothing yet, after s,
after u, after a; the first and the last may end. An edit is an arc between
(rows read, state) nodes: K keeps a row (0), R gives it the role that the state
asks for, user or assistant (2), D deletes it (3, the only choice for blank and
duplicate rows), I inserts an empty row of the role asked for (2); a truncated
row that isn't deleted costs 1 more. As costs are small whole numbers, distances
to the end come from a bucket queue (Dial); of the arcs that lie on shortest
paths the walk from the start takes the least letter each time, which gives the
ASCII-least audit, as a letter has one arc a node.

A conversation can be of any length. Only one character a row, its code, takes
part in the search, and a conversation is cut into pieces of at most ``PIECE``
rows. A piece has a table of distances from each state before it to each state
after it; tables are chained from the end to give each piece the distances at
its end, and then pieces are walked independently, from each state, and chained
from the start. Whole texts are shuffled once, to be hashed in order: one task
streams a conversation's rows, as SHA-256 is sequential, and holds the audit, as
it is one value, but not the rows.

Null ids and turns are one space in the damage's key, null roles and texts are
one space everywhere. Rows are in order of turn, null first, then of a hash of
role and text; identical rows are interchangeable. Repeated rows are duplicates
like others. A role that begins with none of s, u, a can't be kept.
"""

from __future__ import annotations

import functools
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SPACE = "\\x20\\x09-\\x0D"
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
PIECE = 4096
#: Codes: the role's initial (s, u, a, another) for each fault (none, truncated, blank, duplicate).
CODES = "".join(chr(ord("A") + i) for i in range(16))
NONE, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
ASKED = (USER, USER, ASSISTANT, USER)  # the state that an inserted or renamed row leads to


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row."""
    if initial == 0:
        return SYSTEM if state == START else None
    return ASKED[state] if initial < 3 and ASKED[state] == initial + 1 else None


@functools.cache
def _arcs(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """letter, cost and next state of the ways to read a row, by letter."""
    fault, initial = divmod(CODES.index(code), 4)
    out = [("D", DELETE, state)]
    if fault < BLANK:
        more = CUT_SHORT * (fault == TRUNCATED)
        to = _kept(state, initial)
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, ASKED[state]))
    return tuple(out)


def distances(codes: str, ends: tuple[int, ...]) -> list[list[int]]:
    """Least costs from (rows read, state) to the end, where the states cost ``ends``: a bucket queue over the reversed arcs."""
    n = len(codes)
    best = [[FAR] * 4 for _ in range(n + 1)]
    least = min(ends)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for state, cost in enumerate(ends):
        if cost < FAR:
            best[n][state] = cost
            buckets.setdefault(cost, []).append((n, state))
    now, left = least, len(buckets)
    while left:
        nodes = buckets.pop(now, None)
        if nodes is not None:
            left -= 1
            for i, state in nodes:  # grows by arcs of no cost
                if best[i][state] != now:
                    continue
                before = [(i, s, INSERT) for s in range(4) if ASKED[s] == state] if i < n else []
                if i:
                    before += [(i - 1, s, cost) for s in range(4) for _, cost, to in _arcs(codes[i - 1], s) if to == state]
                for j, s, cost in before:
                    if now + cost < best[j][s]:
                        best[j][s] = now + cost
                        if cost == 0:
                            nodes.append((j, s))
                        else:
                            if now + cost not in buckets:
                                left += 1
                            buckets.setdefault(now + cost, []).append((j, s))
        now += 1
    return best


@functools.lru_cache(1 << 14)
def table(codes: str) -> tuple[int, ...]:
    """Costs of a piece from each state before it to each state after it, row by row."""
    columns = [distances(codes, tuple(0 if s == end else FAR for s in range(4)))[0] for end in range(4)]
    return tuple(columns[end][start] for start in range(4) for end in range(4))


def walk(codes: str, start: int, best: list[list[int]]) -> tuple[str, int]:
    """The letters of the least tight path through a piece, and the state after it."""
    i, state, out = 0, start, []
    while i < len(codes):
        here = best[i][state]
        steps = [(letter, i + 1, to, cost) for letter, cost, to in _arcs(codes[i], state)]
        letter, i, state, _ = min(s for s in [*steps, ("I", i, ASKED[state], INSERT)] if s[3] + best[s[1]][s[2]] == here)
        out.append(letter)
    return "".join(out), state


#: Costs after the last row: inserts up to a state that may end.
LAST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
# an empty conversation may end at once; after s a whole exchange must follow


@functools.lru_cache(1 << 14)
def ways(codes: str, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """For each state before a piece: letters and the state after it."""
    best = distances(codes, ends)
    return tuple(walk(codes, s, best) if best[0][s] < FAR else ("", s) for s in range(4))


def chain(tables: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Costs at the end of each piece and, last, at the start of the first."""
    out = [LAST]
    for t in reversed(tables):
        out.append(tuple(min(t[4 * s + e] + out[-1][e] for e in range(4)) for s in range(4)))
    return [*reversed(out[:-1]), out[-1]]


# -- rows ---------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """c (the id as a string), turn, role, text, copies (0: dropped) after the damage."""
    id_, turn = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn"))
    kind = F.pmod(F.crc32(F.concat(id_, F.lit(":"), turn)), F.lit(20))
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("string").alias("c"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _mark() -> Column:
    """Tells rows of different role or text apart."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))


def coded(rows: DataFrame) -> DataFrame:
    """c, turn, mark, copy, code of damaged rows; a conversation's dropped rows have copy 0 and no code."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    there = F.col("copies") > 0
    slim = rows.select("c", F.when(there, F.col("turn")).alias("turn"), F.when(there, _mark()).alias("mark"), F.when(there, initial).alias("initial"), F.when(there, F.when(blank, BLANK).when(cut, TRUNCATED).otherwise(NONE)).alias("fault"), "copies")
    same = slim.groupBy("c", "turn", "mark", "initial", "fault").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.filter("copies > 0").groupBy(F.col("c").alias("c1"), F.col("mark").alias("mark1")).agg(F.min(place).alias("first"))
    same = same.join(first, F.col("c").eqNullSafe(F.col("c1")) & (F.col("mark") == F.col("mark1")), "left")
    each = same.select("c", "turn", "mark", "initial", "fault", place.eqNullSafe(F.col("first")).alias("early"), F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("copy"))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(~F.col("early") | (F.col("copy") > 1), DUPLICATE).otherwise(F.col("fault"))
    code = F.when(F.col("copy") > 0, F.substring(F.lit(CODES), fault * 4 + F.col("initial") + 1, F.lit(1)))
    return each.select("c", "turn", "mark", "copy", code.alias("code"))


_PIECE = "c string, piece bigint, codes string, first_turn string, last_turn string, turns bigint, costs array<bigint>"


def _pieces(most: int):
    """Cuts sorted rows into pieces of one conversation and at most ``most`` rows each; ``part`` is the partition's number."""
    names = [x.split()[0] for x in _PIECE.split(", ")]

    def run(frames):
        made, now, out = 0, None, []

        def close() -> None:
            nonlocal made
            out.append((now["c"], (now["part"] << 32) + made, "".join(now["codes"]), now["first"], now["last"], now["turns"], table("".join(now["codes"]))))
            made += 1

        for frame in frames:
            for c, turn, code, part in zip(*(frame[x].tolist() for x in ("c", "turn", "code", "part"))):
                if now is None or now["c"] != c or len(now["codes"]) >= most:
                    if now is not None:
                        close()
                    now = {"c": c, "part": part, "codes": [], "first": None, "last": None, "turns": 0}
                if code is not None:
                    now["codes"].append(code)
                    if turn is not None and turn != now["last"]:
                        now["first"], now["last"] = now["first"] or turn, turn
                        now["turns"] += 1
            yield pd.DataFrame(out, columns=names)
            out = []
        if now is not None:
            close()
        yield pd.DataFrame(out, columns=names)

    return run


_COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def counts(codes: list[str], turns: list[tuple[str | None, str | None, int]]) -> tuple[int, ...]:
    """gaps, blank, duplicate, truncated and illegal of a conversation's pieces in order."""
    faults = [sum(part.count(CODES[4 * f + i]) for part in codes for i in range(4)) for f in range(4)]
    illegal, before = 0, None
    for part in codes:
        for code in part:
            initial = CODES.index(code) % 4
            illegal += before is not None and (before, initial) not in LEGAL
            before = initial
    known = [t for t in turns if t[2]]
    distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    gaps = int(known[-1][1]) - int(known[0][0]) + 1 - distinct if known else 0
    return gaps, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal


def _chained(frames):
    """Pieces with the costs at their ends, and their conversation's counts."""
    for frame in frames:
        out = []
        for c, pieces in zip(frame["c"].tolist(), frame["pieces"].tolist()):
            ends = chain([tuple(map(int, p["costs"])) for p in pieces])
            said = counts([p["codes"] for p in pieces], [(p["first_turn"], p["last_turn"], int(p["turns"])) for p in pieces])
            for k, (p, end) in enumerate(zip(pieces, ends)):
                out.append((c, k, p["codes"], end, *said, ends[-1][START]))
        yield pd.DataFrame(out, columns=["c", "k", "codes", "ends", *[x.split()[0] for x in _COUNTS.split(", ")]])


def _walked(frames):
    for frame in frames:
        found = [ways(codes, tuple(int(e - min(ends)) for e in ends)) for codes, ends in zip(frame["codes"].tolist(), frame["ends"].tolist())]
        yield frame.drop(columns=["codes", "ends"]).assign(audits=[[a for a, _ in w] for w in found], states=[[s for _, s in w] for w in found])


def _audited(frames):
    for frame in frames:
        out = []
        for ways_ in frame["ways"].tolist():
            state, parts = START, []
            for w in ways_:
                parts.append(w["audits"][state])
                state = int(w["states"][state])
            out.append("".join(parts) + TAIL[state])
        yield frame.drop(columns="ways").assign(audit=out)


def audits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """c, counts, cost and audit of damaged rows, one row a conversation."""
    order = ["c", "turn", "mark", "copy"]  # Spark sorts nulls first
    placed = coded(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("c", F.col("turn").cast("string").alias("turn"), "code", F.spark_partition_id().cast("bigint").alias("part"))
    pieces = placed.mapInPandas(_pieces(piece), _PIECE)
    whole = pieces.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("piece", "codes", "first_turn", "last_turn", "turns", "costs"))).alias("pieces"))
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    ended = whole.mapInPandas(_chained, f"c string, k bigint, codes string, ends array<bigint>, {_COUNTS}").repartition("c", "k")
    walked = ended.mapInPandas(_walked, f"c string, k bigint, {_COUNTS}, audits array<string>, states array<int>")
    way = F.sort_array(F.collect_list(F.struct("k", "audits", "states"))).alias("ways")
    return walked.groupBy("c", *names).agg(way).mapInPandas(_audited, f"c string, {_COUNTS}, audit string")


def _hashed(names: list[str]):
    """One row a conversation from its audit, which comes first, and its rows in order."""

    def run(frames):
        said, out = None, []

        def line(text: str) -> None:
            digest.update((b"\n" if said["lines"] else b"") + text.encode("utf-8", "surrogatepass"))
            said["lines"] += 1

        def apply(role: str | None, text: str | None) -> None:
            """Letters up to and with the one that reads a row; all that are left without a row."""
            audit = said["audit"]
            while said["at"] < len(audit):
                letter = audit[said["at"]]
                said["at"] += 1
                if letter == "K":
                    initial = INITIALS.index(role[0])
                    said["state"] = SYSTEM if initial == 0 else initial + 1
                    line(f"{role}:{text}")
                elif letter != "D":
                    said["state"] = ASKED[said["state"]]
                    line(f"{('user', 'assistant')[said['state'] - USER]}:{text if letter == 'R' else ''}")
                if letter != "I":
                    return

        def close() -> None:
            apply(None, None)
            out.append((*said["row"], digest.hexdigest()))

        digest = None
        for frame in frames:
            columns = [frame[x].tolist() for x in ("c", "rank", *names, "audit", "role", "text")]
            for c, rank, *row, audit, role, text in zip(*columns):
                if rank == 0:
                    if said is not None:
                        close()
                    digest = hashlib.sha256()
                    said = {"row": (c, *row, audit), "audit": audit, "at": 0, "state": START, "lines": 0}
                else:
                    apply(role, text)
            yield pd.DataFrame(out, columns=["c", *names, "audit", "repaired_sha256"])
            out = []
        if said is not None:
            close()
        yield pd.DataFrame(out, columns=["c", *names, "audit", "repaired_sha256"])

    return run


def repair(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row an id of the table."""
    rows = damaged(conversations)
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    told = audits(rows, piece)
    there = rows.filter("copies > 0").select("c", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    blank = lambda *columns: [F.lit(None).cast(kind).alias(n) for n, kind in columns]
    heads = told.select("c", F.lit(0).alias("rank"), *names, "audit", *blank(("turn", "bigint"), ("role", "string"), ("text", "string"), ("mark", "string")))
    zeros = [F.lit(0).cast("bigint").alias(n) for n in names]
    bodies = there.select("c", F.lit(1).alias("rank"), *zeros, F.lit(None).cast("string").alias("audit"), "turn", "role", "text", _mark().alias("mark"))
    lines = heads.unionByName(bodies).repartition("c").sortWithinPartitions("c", "rank", "turn", "mark").select("c", "rank", *names, "audit", "role", "text")
    found = lines.mapInPandas(_hashed(names), f"c string, {_COUNTS}, audit string, repaired_sha256 string")
    return found.select(F.col("c").cast(conversations.schema["conv_id"].dataType).alias("conv_id"), *names, "audit", "repaired_sha256")
