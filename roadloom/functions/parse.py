"""Expressions that read the sheet's own notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.functions.geo import POINTS, point

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
MODES = ("strict", "tolerant", "all_or_nothing", "keep_index")


def linestrings(text: Column, mode: str = "tolerant") -> Column:
    """``LINESTRING(lon lat, …)|…`` as an array of fragments.

    strict: an error for a part that is no line; tolerant: that part is dropped; all_or_nothing: the whole is
    empty; keep_index: that part is an empty fragment.
    """
    if mode not in MODES:
        raise ValueError(mode)

    def fragment(part: Column) -> Column:
        inner = F.regexp_extract(part, r"(?i)^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
        pairs = F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+"))
        points = F.transform(pairs, lambda p: point(F.get(p, F.lit(0)).try_cast("double"), F.get(p, F.lit(1)).try_cast("double")))
        bad = (inner == "") | F.exists(points, lambda p: p["lon"].isNull() | p["lat"].isNull())
        return F.when(~bad, points).otherwise(F.array().cast(POINTS))

    absent = text.isNull() | F.trim(text).isin("", "-")
    parts = F.transform(F.split(text, r"\|"), fragment)
    broken = F.exists(parts, lambda f: F.size(f) == 0)
    empty = F.array().cast(f"array<{POINTS}>")
    if mode == "strict":
        parts = F.when(broken, F.raise_error(F.concat(F.lit("not a line: "), text))).otherwise(parts)
    elif mode == "tolerant":
        parts = F.filter(parts, lambda f: F.size(f) > 0)
    elif mode == "all_or_nothing":
        parts = F.when(broken, empty).otherwise(parts)
    return F.when(absent, empty).otherwise(parts)


# The forms of a geometry and of a done stretch, as sheets have them.
def partial_ranges(text: Column) -> Column:
    """``seg<i>:<from>-<to>:<side>|…`` as an array of (frag, a, b, side); a side other than S and F counts as both."""
    found = F.transform(F.split(F.coalesce(text, F.lit("-")), r"\|"), lambda t: F.regexp_extract_all(t, F.lit(r"seg(\d+):([\d.]+)-([\d.]+):(\w)"), F.lit(0)))

    def token(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, r"seg(\d+):([\d.]+)-([\d.]+):(\w)", k)
        a, b = part(2).try_cast("double"), part(3).try_cast("double")
        side = F.when(part(4).isin("S", "F"), part(4)).otherwise("B")
        return F.struct(part(1).cast("int").alias("frag"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), side.alias("side"))

    return F.transform(F.filter(F.transform(found, lambda x: F.get(x, F.lit(0))), lambda x: x.isNotNull()), token)


def partial_text(ranges: Column) -> Column:
    """The notation of an array of (frag, a, b, side); a hyphen for none."""
    shown = F.transform(ranges, lambda r: F.format_string("seg%d:%.4f-%.4f:%s", r["frag"], r["a"], r["b"], r["side"]))
    return F.when(F.size(shown) > 0, F.array_join(shown, "|")).otherwise("-")


def coordinate_paste(text: Column) -> Column:
    """(lat, lon) of pasted text: labelled numbers, else the first two; null if there are none."""
    labelled = lambda names: F.regexp_extract(text, rf"(?i)\b(?:{names})\s*[:=]?\s*({_NUMBER})", 1).try_cast("double")
    lat, lon = labelled("latitude|lat"), labelled("longitude|long|lon|lng")
    numbers = F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))
    plain = F.when(F.size(numbers) >= 2, F.struct(F.get(numbers, F.lit(0)).try_cast("double").alias("lat"), F.get(numbers, F.lit(1)).try_cast("double").alias("lon")))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))).otherwise(plain)


def sign_fixed(lat: Column, lon: Column, box: tuple[float, float, float, float], margin: float = 0.5) -> Column:
    """(lat, lon) with signs turned if only that brings the point into (min lat, min lon, max lat, max lon)."""
    inside = lambda a, o: a.between(box[0] - margin, box[2] + margin) & o.between(box[1] - margin, box[3] + margin)
    pick = lambda a, o: F.struct(a.alias("lat"), o.alias("lon"))
    return F.when(inside(lat, lon), pick(lat, lon)).when(inside(-lat, lon), pick(-lat, lon)).when(inside(lat, -lon), pick(lat, -lon)).when(inside(-lat, -lon), pick(-lat, -lon)).otherwise(pick(lat, lon))
