"""Places of pattern matches in texts, with DataFrame functions only, in time linear in the text for any number of matches a text may have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.arrays import before, let

SPAN = "array<struct<start:bigint,end:bigint,hit:string>>"
#: Characters of the pieces that a text is cut into to read parts of it from any place.
PIECE = 1024


def total_before(values: Column) -> Column:
    return before(values, lambda a, x: a + x, F.lit(0).cast("bigint"))


def most_before(values: Column) -> Column:
    return before(values, F.greatest, F.lit(0).cast("bigint"))


def hits(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, found: Column, pattern: str) -> Column:
    """start, end (code points, end exclusive) and text of each of the matches `found` of the pattern.

    Splitting at the pattern gives what stands between the matches; running sums of both lengths give the places.
    """
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(hit).cast("bigint").alias("own"), hit.alias("hit")))

    def placed(p: Column) -> Column:
        at = total_before(F.transform(p, lambda x: x["gap"] + x["own"]))
        return F.zip_with(p, F.slice(at, 1, F.size(p)), lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["own"]).alias("end"), x["hit"].alias("hit")))

    return F.when(F.size(found) > 0, let(pairs, placed)).otherwise(F.array().cast(SPAN))


def touching(inner: Column, outer: Column) -> Column:
    """For each of the spans `inner` (apart from each other, in order), whether it shares a place with any of `outer` (in any order).

    Both are put in one order of starts: a span is touched by one that starts before it if the furthest end so far lies
    beyond its start, and by one that starts within it if its next neighbour does.
    """
    events = F.array_sort(F.concat(F.transform(outer, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("side"), b["end"].alias("end"))), F.transform(inner, lambda t: F.struct(t["start"].alias("start"), F.lit(1).alias("side"), t["end"].alias("end")))))

    def told(e: Column) -> Column:
        reach = most_before(F.transform(e, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(F.lit(0).cast("bigint"))))
        following = F.slice(e, 2, F.size(e))
        both = F.zip_with(F.zip_with(e, F.slice(reach, 1, F.size(e)), lambda x, r: F.struct(x.alias("x"), r.alias("r"))), following, lambda y, z: F.struct(y["x"]["side"].alias("side"), ((y["r"] > y["x"]["start"]) | F.coalesce((z["side"] == 0) & (z["start"] < y["x"]["end"]), F.lit(False))).alias("on")))
        return F.transform(F.filter(both, lambda x: x["side"] == 1), lambda x: x["on"])

    return F.when((F.size(inner) > 0) & (F.size(outer) > 0), let(events, told)).otherwise(F.transform(inner, lambda t: F.lit(False)))


def apart(inner: Column, outer: Column) -> Column:
    """Those of the spans `inner` that share no place with any of `outer`."""
    marked = F.zip_with(inner, touching(inner, outer), lambda s, on: F.struct(s.alias("s"), on.alias("on")))
    return F.transform(F.filter(marked, lambda x: ~x["on"]), lambda x: x["s"])


def _with(found: Column, rank: int, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def labelled(spans_by_kind: dict[str, Column]) -> Column:
    """Spans of several kinds in one array, by start, then kind in the order given: struct<start, rank, end, kind>."""
    parts = []
    for rank, (kind, found) in enumerate(spans_by_kind.items()):
        parts.append(_with(found, rank, kind))
    return F.array_sort(F.concat(*parts))


def written(spans_array: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kept_if(found: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(found, lambda s: test(s["hit"]))


def masked(text: Column, found: Column) -> Column:
    """The text with each span (in order of starts) replaced by its kind in angle brackets; a span that begins inside an earlier one is part of it."""

    def written_anew(pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            whole = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(a < b, F.substring(whole, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        def anew(reach: Column) -> Column:
            heads = F.zip_with(found, F.slice(reach, 1, F.size(found)), lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("at")))
            parts = F.transform(F.filter(heads, lambda h: h["start"] >= h["at"]), lambda h: F.concat(part(h["at"], h["start"]), F.lit("<"), F.upper(h["kind"]), F.lit(">")))
            return F.concat(F.array_join(parts, ""), part(F.element_at(reach, -1), F.length(text).cast("bigint")))

        return let(most_before(F.transform(found, lambda s: s["end"])), anew)

    return F.when(F.size(found) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), written_anew)).otherwise(text)
