"""Algebra of matches between intervals of two sequences, as struct expressions.

An interval is (start, end, len), closed and from 0. A match is (a, b, rc,
diffs): interval a of one sequence matches interval b of another, on the other
strand if rc. Intervals of a match are equally long.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandloom.functions import dna


def interval(start: Column, end: Column, size: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), size.cast("int").alias("len"))


def match(a: Column, b: Column, rc: Column, diffs: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), rc.alias("rc"), diffs.cast("int").alias("diffs"))


def width(i: Column) -> Column:
    return i["end"] - i["start"] + 1


def complement(i: Column) -> Column:
    """What an interval that begins or ends its sequence leaves; null for others and for whole sequences."""
    left, right = i["start"] == 0, i["end"] == i["len"] - 1
    return F.when(left & ~right, interval(i["end"] + 1, i["len"] - 1, i["len"])).when(right & ~left, interval(F.lit(0), i["start"] - 1, i["len"]))


def piece(i: Column, seq: Column | str) -> Column:
    return dna.substr(seq, i["start"] + 1, width(i))


def intersect(x: Column, y: Column) -> Column:
    """The common part of two intervals of one sequence; null if there is none."""
    start, end = F.greatest(x["start"], y["start"]), F.least(x["end"], y["end"])
    return F.when(start <= end, interval(start, end, x["len"]))


def invert(m: Column) -> Column:
    return F.when(m.isNotNull(), match(m["b"], m["a"], m["rc"], m["diffs"]))


def translate(m: Column, at: Column) -> Column:
    """The place in b of a place in a; outside of the match the same line goes on."""
    return F.when(m["rc"], m["b"]["end"] - (at - m["a"]["start"])).otherwise(m["b"]["start"] + (at - m["a"]["start"]))


def over(m: Column, i: Column) -> Column:
    """The interval of b that an interval of a matches."""
    one, two = translate(m, i["start"]), translate(m, i["end"])
    return interval(F.least(one, two), F.greatest(one, two), m["b"]["len"])


def compose(x: Column, y: Column) -> Column:
    """a to c by a to b and b to c: what both matches hold of b; null if that is nothing. Differences add up."""
    common = intersect(x["b"], y["a"])
    return F.when(common.isNotNull(), match(over(invert(x), common), over(y, common), x["rc"] != y["rc"], x["diffs"] + y["diffs"]))


def expand(m: Column) -> Column:
    """The match grown both ways until it meets an end of either sequence."""
    a, b = m["a"], m["b"]
    left = F.least(a["start"], F.when(m["rc"], b["len"] - 1 - b["end"]).otherwise(b["start"]))
    right = F.least(a["len"] - 1 - a["end"], F.when(m["rc"], b["start"]).otherwise(b["len"] - 1 - b["end"]))
    near, far = F.when(m["rc"], right).otherwise(left), F.when(m["rc"], left).otherwise(right)
    return match(interval(a["start"] - left, a["end"] + right, a["len"]), interval(b["start"] - near, b["end"] + far, b["len"]), m["rc"], m["diffs"])


def contains(m: Column) -> Column:
    """Either sequence is wholly matched."""
    return dna.is_contained(m["a"]) | dna.is_contained(m["b"])


def of_arc(a: Column, b: Column, size: Column, len_a: Column, len_b: Column) -> Column:
    """The match of an arc between oriented vertices, on the vertices' own strands."""
    one = F.when(a % 2 == 0, len_a - size).otherwise(F.lit(0))
    two = F.when(b % 2 == 0, F.lit(0)).otherwise(len_b - size)
    return match(interval(one, one + size - 1, len_a), interval(two, two + size - 1, len_b), a % 2 != b % 2, F.lit(0))
