"""Points of interest: shortlist, cache upsert, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import Y_PLAN, metres
from roadloom.operators.ranking import numbered


def in_box(lat: Column, lon: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Inclusive; box is (min lat, min lon, max lat, max lon)."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def box_contains(outer: tuple, inner: tuple) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def poi_key(name: Column, lat: Column, lon: Column) -> Column:
    return F.format_string("%s|%.6f|%.6f", name, lat, lon)


def shortlist(centres: DataFrame, pois: DataFrame, n: int = 5, keys: tuple[str, ...] = ("ward_name",)) -> DataFrame:
    """The n nearest points of interest of each centre. centres: keys, lon, lat; pois: keys, poi, p_lon, p_lat."""
    met = centres.join(pois, list(keys))
    dist = metres(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"), F.col("lat"), Y_PLAN)
    ranked = met.withColumn("dist_m", dist).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("dist_m", "poi")))
    return ranked.filter(F.col("rank") <= n).select(*keys, "poi", F.round("dist_m", 3).alias("dist_m"), F.col("rank").cast("long").alias("rank"))


def upsert(cached: DataFrame, fresh: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Cached points outside the box and all fresh ones, each key once. Both: name, lat, lon."""
    kept = cached.filter(~in_box(F.col("lat"), F.col("lon"), tuple(map(F.lit, box))))
    return kept.unionByName(fresh).withColumn("key", poi_key(F.col("name"), F.col("lat"), F.col("lon"))).dropDuplicates(["key"])


def coverage_upsert(coverage: DataFrame, box: tuple[float, float, float, float], fetched_at: str, most: int = 300) -> DataFrame:
    """Coverage boxes without those the new one swallows, and the new one; the latest ``most``."""
    mine = tuple(map(F.lit, box))
    own = tuple(F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon"))
    kept = coverage.filter(~box_contains(mine, own))
    new = coverage.sparkSession.createDataFrame([(*box, fetched_at)], "min_lat double, min_lon double, max_lat double, max_lon double, fetched_at string")
    return kept.unionByName(new).orderBy(F.col("fetched_at").desc()).limit(most)


def listed(points: DataFrame) -> DataFrame:
    """points with place, their number from 1 in the order of names (by a locale's rules) and latitudes."""
    return numbered(points, [F.collate("name", "UNICODE"), "lat"])
