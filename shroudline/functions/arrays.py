"""Searches in sorted arrays of a row, of a logarithmic number of steps.

A lambda variable is evaluated once, a column that a lambda mentions once for each element: what is
looked up in again and again is therefore bound first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(values: Column) -> Column:
    """0, 1, ... as often as an array of so many elements can be halved, and once more."""
    return F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1.0)).cast("int"))


def rank(values: Column, x: Column, before: Callable[[Column, Column], Column] = lambda v, x: v < x) -> Column:
    """How many elements of a sorted array come before x: a binary search."""

    def halve(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        right = (a["low"] < a["high"]) & before(F.get(values, middle), x)
        low = F.when(right, middle + 1).otherwise(a["low"])
        high = F.when(right | (a["low"] >= a["high"]), a["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(_steps(values), F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halve, lambda a: a["low"])


def contains_sorted(values: Column, x: Column) -> Column:
    """True if a sorted array has an element that equals x."""
    return F.coalesce(F.get(values, rank(values, x)) == x, F.lit(False))


def prefix_max(values: Column) -> Column:
    """Each element's maximum with all before it, by doubling the distance looked back."""

    def further(a: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda v, i: F.greatest(v, F.get(a, F.when(i >= back, i - back).otherwise(i))))

    return F.aggregate(_steps(values), values, further)


def merged(ranges: Column, start: str, end: str) -> Column:
    """struct<starts, ends> of an array of ranges: the starts in order, and the greatest end of the ranges so far."""
    return bind(
        F.sort_array(F.transform(ranges, lambda r: F.struct(r[start].alias("a"), r[end].alias("b")))),
        lambda s: F.struct(F.transform(s, lambda r: r["a"]).alias("starts"), bind(F.transform(s, lambda r: r["b"]), prefix_max).alias("ends")),
    )


def covered_by(m: Column, x: Column) -> Column:
    """True if a range of merged ranges m has x in it, ends included."""
    return F.coalesce(F.get(m["ends"], F.greatest(rank(m["starts"], x, lambda v, x: v <= x) - 1, F.lit(0))) >= x, F.lit(False)) & F.coalesce(F.get(m["starts"], F.lit(0)) <= x, F.lit(False))
