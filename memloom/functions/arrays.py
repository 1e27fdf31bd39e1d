"""Array functions that Spark has no name for, as compositions of those it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once."""
    return F.transform(F.array(x), body)[0]


def before(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each place of an array, `combine` (associative) over all values before it; one more place at the end for all of them.

    An array that grows by one is copied at each step, so the values are walked in blocks of about the square root of
    their number: block by block, then over the blocks' sums.
    """

    def walk(block: Column) -> Column:
        return F.aggregate(block, F.array(zero), lambda a, x: F.concat(a, F.array(combine(F.element_at(a, -1), x))))

    def in_blocks(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(0), F.size(v) - 1, side)
        return let(side, lambda s: F.transform(starts, lambda k: walk(F.slice(v, k + 1, s))))

    def joined(w: Column) -> Column:
        sums = walk(F.transform(w, lambda b: F.element_at(b, -1)))
        moved = F.zip_with(F.slice(sums, 1, F.size(w)), w, lambda t, b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: combine(t, x)))
        return F.concat(F.flatten(moved), F.array(F.element_at(sums, -1)))

    return let(values, lambda v: F.when(F.size(v) > 64, let(in_blocks(v), joined)).otherwise(walk(v)))


def occurrences(words: Column) -> Column:
    """The words sorted, each with its number among its equals: two arrays of these have as many in common as the words have as multisets."""
    kind = lambda w, n, whole: F.struct(w.alias("w"), n.alias("n"), whole.alias("whole"))
    ones = F.transform(F.array_sort(words), lambda w: kind(w, F.lit(1), F.lit(True)))

    def behind(a: Column, b: Column) -> Column:
        # how many equals stand at the end of both parts together, and whether they are all there is
        same = a["w"].eqNullSafe(b["w"])
        both = kind(b["w"], F.when(b["whole"] & same, a["n"] + b["n"]).otherwise(b["n"]), b["whole"] & ((a["n"] == 0) | (a["whole"] & same)))
        return F.when(b["n"] == 0, a).otherwise(both)

    counted = before(ones, behind, kind(F.lit(None).cast("string"), F.lit(0), F.lit(True)))
    return F.transform(F.slice(counted, 2, F.greatest(F.size(words), F.lit(0))), lambda x: F.concat_ws("#", x["n"].cast("string"), x["w"]))
