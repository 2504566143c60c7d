"""Boxes on the map, many at once: which contain which, what a cache covers, and what it takes up.

A box stands in the cells, at most four, of a grid whose cells are just wider than it is; grids halve from level to level. A box
that contains another is no smaller, so the other's corner looks up one cell on each coarser level: an equality join,
in which neither side is broadcast and each pair meets once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.operators.poi import box_contains, in_box, poi_key

BOX = ("min_lat", "min_lon", "max_lat", "max_lon")
#: Grids from the whole globe to cells of some metres; smaller boxes stand in the finest.
WORLD_DEGREES, FINEST = 512.0, 24
MOST_DEGREES, MOST_BOXES = 0.6, 300


def _side(level: Column) -> Column:
    return F.lit(WORLD_DEGREES) / F.pow(F.lit(2.0), level)


def _level(prefix: str = "") -> Column:
    """The finest level whose cells are as wide and high as a box."""
    size = F.greatest(F.col(f"{prefix}max_lat") - F.col(f"{prefix}min_lat"), F.col(f"{prefix}max_lon") - F.col(f"{prefix}min_lon"))
    return F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(WORLD_DEGREES) / size))))).otherwise(FINEST).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / _side(level)).cast("long")


def in_grid(boxes: DataFrame) -> DataFrame:
    """boxes once for each cell (_level, _x, _y) of their level that they touch."""
    spread = boxes.withColumn("_level", _level())
    cells = lambda low, high: F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level")))
    return spread.withColumn("_x", F.explode(cells("min_lon", "max_lon"))).withColumn("_y", F.explode(cells("min_lat", "max_lat")))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner_id, outer_id of all boxes (id and BOX) of the one table within boxes of the other; a box contains its equal."""
    placed = in_grid(outer.select(F.col("id").alias("outer_id"), *BOX)).select("outer_id", F.struct(*BOX).alias("_o"), "_level", "_x", "_y")
    asked = inner.select(F.col("id").alias("inner_id"), F.struct(*BOX).alias("_i"), F.explode(F.sequence(F.lit(0), _level())).alias("_l"))
    asked = asked.withColumn("_cx", _cell(F.col("_i.min_lon"), F.col("_l"))).withColumn("_cy", _cell(F.col("_i.min_lat"), F.col("_l")))
    met = asked.join(placed, (F.col("_l") == F.col("_level")) & (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")))
    of = lambda s: tuple(F.col(f"{s}.{c}") for c in BOX)
    return met.filter(box_contains(of("_o"), of("_i"))).select("inner_id", "outer_id")


def points_within(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """box and the columns of points (lat, lon and others) of all points in boxes (id and BOX), edges included.

    Points look up the levels that the boxes have.
    """
    placed = in_grid(boxes.select(F.col("id").alias("box"), *BOX)).select("box", F.struct(*BOX).alias("_b"), "_level", "_x", "_y")
    levels = placed.groupBy().agg(F.collect_set("_level").alias("_levels"))  # one row of at most 25 numbers
    asked = points.join(F.broadcast(levels)).withColumn("_l", F.explode("_levels")).drop("_levels")
    asked = asked.withColumn("_cx", _cell(F.col("lon"), F.col("_l"))).withColumn("_cy", _cell(F.col("lat"), F.col("_l")))
    met = asked.join(placed, (F.col("_l") == F.col("_level")) & (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")))
    return met.filter(in_box(F.col("lat"), F.col("lon"), tuple(F.col(f"_b.{c}") for c in BOX))).select("box", *points.columns)


def refusal(most_degrees: float = MOST_DEGREES) -> Column:
    """Why a requested box can't be fetched, or null. The messages."""
    low_lat, low_lon, high_lat, high_lon = map(F.col, BOX)
    known = F.lit(True)
    for c in BOX:
        known = known & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ranged = (low_lat >= -90) & (high_lat <= 90) & (low_lon >= -180) & (high_lon <= 180) & (low_lat < high_lat) & (low_lon < high_lon)
    small = (high_lat - low_lat <= most_degrees) & (high_lon - low_lon <= most_degrees)
    return F.when(~known, "bbox must be [minLat, minLon, maxLat, maxLon]").when(~ranged, "bbox out of range").when(~small, f"bbox larger than {most_degrees} degrees")


def read_through(requests: DataFrame, coverage: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a cache answers, what has to be fetched, and what is refused: (box and columns of cached), (id, BOX), (id, reason).

    requests and coverage: id, BOX; cached: name, lat, lon. A request is answered from the cache if one box of the coverage
    contains it, of whatever size; one that is neither covered nor fit to be fetched is refused. Of requests to fetch that another one
    contains only the larger stays, of equal ones that with the least id; answers to the others come with it.
    """
    sane = requests.filter(F.coalesce(refusal(1e9), F.lit("")) == "")
    covered = containing(sane, coverage).select(F.col("inner_id").alias("id")).distinct()
    answers = points_within(cached, sane.join(covered, "id", "left_semi"))
    rest = requests.join(covered, "id", "left_anti").withColumn("reason", refusal())
    asked = rest.filter("reason is null").drop("reason")
    return answers, without_swallowed(asked), rest.filter("reason is not null").select("id", "reason")


def without_swallowed(boxes: DataFrame) -> DataFrame:
    """boxes that no other one contains; of equal ones the least id stays."""
    pairs = containing(boxes, boxes).filter("inner_id <> outer_id")
    back = pairs.select(F.col("outer_id").alias("_i"), F.col("inner_id").alias("_o"))
    equal = pairs.join(back, (F.col("inner_id") == F.col("_i")) & (F.col("outer_id") == F.col("_o")), "left").withColumn("_equal", F.col("_i").isNotNull())
    gone = equal.filter("not _equal or outer_id < inner_id").select(F.col("inner_id").alias("id")).distinct()
    return boxes.join(gone, "id", "left_anti")


def taken_up(cached: DataFrame, coverage: DataFrame, fetched: DataFrame, found: DataFrame, most: int = MOST_BOXES) -> tuple[DataFrame, DataFrame]:
    """The cache after boxes were fetched: its points (name, lat, lon), each key once, and its coverage (id, BOX, fetched_at).

    coverage and fetched: id, BOX, fetched_at (ids differ); found: box, name, lat, lon. Cached points within a fetched box are replaced by what was
    found there, and boxes that a fetched one contains go. As long as the coverage has fewer than ``most`` boxes, it takes fetched
    ones, by id; with the others nothing changes.
    """
    room = max(0, most - coverage.count())
    new = without_swallowed(fetched).orderBy("id").limit(room)
    # a box that the coverage contains already was fetched for nothing
    new = new.join(containing(new, coverage).select(F.col("inner_id").alias("id")).distinct(), "id", "left_anti")
    swallowed = containing(coverage, new).select(F.col("inner_id").alias("id")).distinct()
    inside = points_within(cached.select("name", "lat", "lon"), new).select("name", "lat", "lon").distinct()
    kept = cached.select("name", "lat", "lon").join(inside, ["name", "lat", "lon"], "left_anti")
    fresh = found.join(new.select(F.col("id").alias("box")), "box", "left_semi").select("name", "lat", "lon")
    every = kept.withColumn("_new", F.lit(0)).union(fresh.withColumn("_new", F.lit(1))).withColumn("_key", poi_key(F.col("name"), F.col("lat"), F.col("lon")))
    points = every.groupBy("_key").agg(F.min(F.struct("_new", "name", "lat", "lon")).alias("p")).select("p.name", "p.lat", "p.lon")
    columns = ("id", *BOX, "fetched_at")
    return points, coverage.join(swallowed, "id", "left_anti").select(*columns).unionByName(new.select(*columns))
