"""Geometry expressions. Points are structs (lon, lat) of doubles; the projection is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree: of longitude at the equator, and of latitude for planning and for directions.
X_DEGREE, Y_PLAN, Y_WALK = 111320.0, 111320.0, 110540.0
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
POINTS = "array<struct<lon:double,lat:double>>"


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def metres(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, lat0: Column, y: float = Y_PLAN) -> Column:
    dx = (a_lon - b_lon) * (F.lit(X_DEGREE) * F.cos(F.radians(lat0)))
    dy = (a_lat - b_lat) * F.lit(y)
    return F.sqrt(dx * dx + dy * dy)


def distance(a: Column, b: Column, lat0: Column, y: float = Y_PLAN) -> Column:
    return metres(a["lon"], a["lat"], b["lon"], b["lat"], lat0, y)


def line_length(points: Column, lat0: Column, y: float = Y_PLAN) -> Column:
    """Length of one fragment."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: distance(F.get(points, i - 1), F.get(points, i), lat0, y))
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda t, x: t + x)).otherwise(0.0)


def point_at(points: Column, fraction: Column, lat0: Column, y: float = Y_PLAN) -> Column:
    """The point at a fraction of a fragment's length."""
    total = line_length(points, lat0, y)
    empty = F.lit(None).cast("struct<lon:double,lat:double>")
    start = F.struct(F.lit(0.0).alias("at"), empty.alias("p"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        size, goal = distance(a, b, lat0, y), F.least(F.greatest(fraction, F.lit(0.0)), F.lit(1.0)) * total
        here = acc["p"].isNull() & ((acc["at"] + size >= goal) | (i == F.size(points) - 1))
        t = F.when(size > 0, F.least((goal - acc["at"]) / size, F.lit(1.0))).otherwise(0.0)
        found = point(a["lon"] + (b["lon"] - a["lon"]) * t, a["lat"] + (b["lat"] - a["lat"]) * t)
        return F.struct((acc["at"] + size).alias("at"), F.when(here, found).otherwise(acc["p"]).alias("p"))

    return F.when(F.size(points) > 1, F.aggregate(F.sequence(F.lit(1), F.size(points) - 1), start, step, lambda acc: acc["p"])).otherwise(F.get(points, F.lit(0)))


def on_segment(p_lon: Column, p_lat: Column, a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, lat0: Column, y: float = Y_WALK) -> tuple[Column, Column]:
    """Position from 0 to 1 along a segment of the place nearest to a point, and its distance; both in metres."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(lat0))
    bx, by = (b_lon - a_lon) * x, (b_lat - a_lat) * F.lit(y)
    px, py = (p_lon - a_lon) * x, (p_lat - a_lat) * F.lit(y)
    square = bx * bx + by * by
    t = F.when(square > 0, F.least(F.greatest((px * bx + py * by) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    dx, dy = px - bx * t, py - by * t
    return t, F.sqrt(dx * dx + dy * dy)


def bearing(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, lat0: Column, y: float = Y_WALK) -> Column:
    """Degrees from north, clockwise, from 0 to below 360."""
    dx = (b_lon - a_lon) * (F.lit(X_DEGREE) * F.cos(F.radians(lat0)))
    dy = (b_lat - a_lat) * F.lit(y)
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.floor(degrees / 45.0 + 0.5) % 8 + 1).cast("int"))


def turn(before: Column, after: Column) -> Column:
    """The word for a change of bearing."""
    change = F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(change) < 35, "straight on").when(F.abs(change) > 150, "turn round").when(change > 0, "right").otherwise("left")


def halves_up(x: Column, digits: int = 0) -> Column:
    """Rounded with halves towards plus infinity."""
    factor = F.lit(float(10**digits))
    return F.floor(x * factor + 0.5) / factor


def effort_weight(residences: Column, length_m: Column) -> Column:
    """1 for 60 homes a kilometre or more, 6.25 for 15 or fewer, between them a straight line of logarithms."""
    density = residences / F.greatest(length_m / 1000.0, F.lit(0.02))
    share = (F.ln(F.lit(60.0)) - F.ln(F.greatest(density, F.lit(15.0)))) / (F.ln(F.lit(60.0)) - F.ln(F.lit(15.0)))
    return F.when(density >= 60, 1.0).when(density <= 15, 6.25).otherwise(F.exp(F.ln(F.lit(6.25)) * share))


def route_kind(min_dist_m: Column) -> Column:
    return F.when(min_dist_m <= 700, "walk").when(min_dist_m <= 1100, "hybrid").otherwise("drive")


def difficulty(value: Column, least: Column, most: Column) -> Column:
    """Band 1 to 5 by the place within a span."""
    share = F.when(most > least, (value - least) / (most - least)).otherwise(0.5)
    return F.when(share < 0.10, 1).when(share < 0.37, 2).when(share < 0.63, 3).when(share < 0.90, 4).otherwise(5)
