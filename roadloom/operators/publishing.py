"""Page manifest: retention, idempotent publishing, free names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retained(manifest: DataFrame, now: Column, at: str = "generated_at", days: int = 14) -> DataFrame:
    """Without entries older than ``days``; an entry whose time is unknown stays."""
    return manifest.filter(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(F.lit(days))))


def first_publishes(requests: DataFrame, key: str = "publish_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The first request of each identifier; the others are retries of it. Requests without one all stay."""
    named = requests.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return named.filter("_n = 1").drop("_n").unionByName(requests.filter(F.col(key).isNull()))


def free_name(taken: DataFrame, base: str, most: int = 1000) -> DataFrame:
    """name: the first of base.html, base1.html, … that no row of taken (name) has."""
    numbers = taken.sparkSession.range(most).select("id", F.concat(F.lit(base), F.when(F.col("id") == 0, "").otherwise(F.col("id").cast("string")), F.lit(".html")).alias("name"))
    return numbers.join(taken.select("name"), "name", "left_anti").orderBy("id").limit(1).select("name")


def still_there(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """The manifest's entries whose file is in the folder's listing (filename); vanished files drop out."""
    return manifest.join(listing.select("filename"), "filename", "left_semi")


def vanished(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    return manifest.join(listing.select("filename"), "filename", "left_anti")
