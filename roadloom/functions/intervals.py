"""Interval algebra over arrays of structs (a, b), fractions of a fragment's length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
LEAST_METRES = 10.0
LIST = "array<struct<a:double,b:double>>"


def interval(a: Column, b: Column) -> Column:
    return F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))


def none() -> Column:
    return F.array().cast(LIST)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(items: Column, gap: Column | float = EPSILON, strict: bool = False) -> Column:
    """Sorted, and joined where the next one begins within ``gap`` of the end so far (``strict``: nearer than it)."""
    gap = F.lit(gap) if isinstance(gap, float) else gap

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (x["a"] - last["b"] < gap) if strict else (x["a"] <= last["b"] + gap)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(interval(last["a"], F.greatest(last["b"], x["b"]))))
        return F.when(F.size(acc) == 0, F.array(x)).when(near, joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(items), none(), add)


def intersected(left: Column, right: Column) -> Column:
    pairs = let(right, lambda others: F.flatten(F.transform(left, lambda x: F.transform(others, lambda y: interval(F.greatest(x["a"], y["a"]), F.least(x["b"], y["b"]))))))
    return merged(F.filter(pairs, lambda x: x["b"] > x["a"]))


def subtracted(left: Column, right: Column) -> Column:
    """What of the left list no interval of the right one covers."""

    def carve(acc: Column, y: Column) -> Column:
        parts = F.flatten(F.transform(acc, lambda x: F.when((y["b"] <= x["a"]) | (y["a"] >= x["b"]), F.array(x)).otherwise(F.array(interval(x["a"], y["a"]), interval(y["b"], x["b"])))))
        return F.filter(parts, lambda x: x["b"] - x["a"] > EPSILON)

    return F.aggregate(right, merged(left), carve)


def complement(items: Column) -> Column:
    return subtracted(F.array(interval(F.lit(0.0), F.lit(1.0))), items)


def without_tiny(items: Column, length_m: Column) -> Column:
    """Without intervals of less than ten metres, where the length is known."""
    return F.filter(items, lambda x: F.coalesce(length_m <= 0, F.lit(True)) | ((x["b"] - x["a"]) * length_m >= LEAST_METRES))


def gaps_closed(items: Column, length_m: Column) -> Column:
    """Merged; gaps and ends of less than ten metres are closed where the length is known."""
    near = F.lit(LEAST_METRES) / length_m
    known = F.coalesce(length_m > 0, F.lit(False))

    def closed(found: Column) -> Column:
        joined = merged(found, near, strict=True)
        return F.transform(joined, lambda x: interval(F.when(x["a"] < near, 0.0).otherwise(x["a"]), F.when(1 - x["b"] < near, 1.0).otherwise(x["b"])))

    return let(merged(items), lambda found: F.when(known, closed(found)).otherwise(found))


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda t, x: t + (x["b"] - x["a"]))


def done(both: Column, south: Column, first: Column, length_m: Column) -> Column:
    """Fully done: both sides at once, or one side and the other."""
    clean = lambda x: gaps_closed(without_tiny(x, length_m), length_m)
    return gaps_closed(without_tiny(F.concat(both, intersected(clean(south), clean(first))), length_m), length_m)


def half_done(one: Column, finished: Column, length_m: Column) -> Column:
    """Done on one side only."""
    return without_tiny(subtracted(gaps_closed(without_tiny(one, length_m), length_m), finished), length_m)
