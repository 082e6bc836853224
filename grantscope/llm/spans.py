"""Whole-text pattern matching with code-point offsets, in DataFrame functions only.

A pattern's matches come from regexp_extract_all; what stands between them from split with the same pattern.
Running sums of both lengths are the offsets. Patterns use possessive quantifiers and start where a run of their
first class starts (or where the last match ended), so that long texts take linear time and no deep recursion.

Lambdas read other columns through let(): a column named inside a lambda would be worked out once per element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An empty list of matches.
NONE = "array<struct<text:string,before:string,after:string,start:int,end:int>>"
#: Matches summed up at a time: a list of n costs n * (BLOCK + n / BLOCK) short copies, not n * n.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with `value` worked out once however often, and in whatever lambda, the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(sizes: Column) -> Column:
    """array<int>: where each match starts, from array<struct<gap, width>>, a lambda variable of at least one element."""
    none = F.array().cast("array<int>")

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + x["gap"] + x["width"]
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out"))

    def block(s: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK)), F.struct(s["at"].alias("at"), none.alias("out")), step)
        return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(s["out"], o["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda s: s["out"])


def matched(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<text, before, after, start, end>> of the leftmost non-overlapping matches; empty where there is none.

    `before` and `after` are what stands between a match and its neighbours. `gate` is a cheaper necessary condition.
    """
    empty = F.array().cast(NONE)

    def located(found: Column, rest: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.struct(F.char_length(F.get(rest, i)).alias("gap"), F.char_length(m).alias("width")))
        starts = let(sizes, _starts)
        one = lambda at, i: F.struct(
            F.get(found, i).alias("text"), F.get(rest, i).alias("before"), F.get(rest, i + 1).alias("after"),
            at.alias("start"), (at + F.char_length(F.get(found, i))).alias("end"),
        )
        return F.transform(starts, one).cast(NONE)

    split = lambda found: let(F.split(text, pattern, -1), lambda rest: located(found, rest))
    some = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, split(found)).otherwise(empty))
    known = text.isNotNull() if gate is None else gate
    return F.when(known, some).otherwise(empty)


def lower_bound(values: Column, least: Column) -> Column:
    """Index of the first of the sorted `values` (a lambda variable) that is at least `least`: a binary search."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        above = F.get(values, middle) >= least
        narrower = F.struct(F.when(above, s["lo"]).otherwise(middle + 1).alias("lo"), F.when(above, middle).otherwise(s["hi"]).alias("hi"))
        return F.when(s["lo"] < s["hi"], narrower).otherwise(s)

    return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), halve, lambda s: s["lo"])


def apart(found: Column, spans: Column) -> Column:
    """The matches of `found` that overlap none of `spans` (an array of structs with start and end)."""

    def free(starts: Column, ends: Column) -> Column:
        # spans that start before a match ends, but for those that end before it starts
        return F.filter(found, lambda m: lower_bound(starts, m["end"]) <= lower_bound(ends, m["start"] + 1))

    sort = lambda side: F.array_sort(F.transform(spans, lambda s: s[side]))
    both = let(sort("start"), lambda starts: let(sort("end"), lambda ends: free(starts, ends)))
    return F.when(F.size(spans) == 0, found).otherwise(both)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    return F.aggregate(F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(twice(d))), F.lit(0), lambda a, d: a + d) % 10 == 0


def joined(spans: Column) -> Column:
    """`kind:start:end` of an array of spans, in its order, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def as_spans(found: Column, rank: int, kind: str) -> Column:
    """Matches as array<struct<rank, start, end, kind>>."""
    one = lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    return F.transform(found, one)
