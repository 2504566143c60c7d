"""Road sheets, address points, caches and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.text import leading_int
from roadloom.operators.roads import network_split

# The fields of a road sheet and the headers that stand for them, as letters and digits.
FIELDS = {
    "street": ("street", "road", "roadname", "name"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "longitude"),
    "ward_name": ("ward",),
    "constituency": ("localauthoritydistrict", "constituency", "district", "lad"),
    "status": ("status",),
    "residences": ("residences", "uprns", "uprncount", "estimatedresidences"),
    "road_geometry": ("roadgeometry", "geometry"),
    "partial_geometry": ("partialgeometry",),
}
OPTIONAL = ("constituency",)
# The settings that a tracker page holds.
SETTINGS = ("SHEET_ID", "SHEET_GID", "APPS_SCRIPT_URL", "GOOGLE_CLIENT_ID", "TITLE", "SUBTITLE")


def detect_columns(header: list[str]) -> dict[str, str | None]:
    """For each field the first header that stands for it; the street falls back to the first column."""
    normal = {h: "".join(c for c in h.lower() if c.isascii() and c.isalnum()) for h in header}
    found = {f: next((h for h in header if normal[h] in names), None) for f, names in FIELDS.items()}
    found["street"] = found["street"] or (header[0] if header else None)
    return found


def missing_fields(header: list[str]) -> list[str]:
    return [f for f, h in detect_columns(header).items() if h is None and f not in OPTIONAL]


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A road sheet (CSV with quoted line breaks) as typed rows with row_index and is_network."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return typed_rows(raw)


def read_values_grid(spark: SparkSession, path: str) -> DataFrame:
    """A sheet as a grid of values (a JSON list of lists, or an object whose ``values`` is one), as typed rows like ``read_sheet``.

    The first list is the header; short rows are filled up, cells beyond the header are left out, of equal headers the last one counts. An empty grid has no rows.
    """
    text = spark.read.text(path, wholetext=True)
    cells = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<array<string>>")).otherwise(F.from_json("value", "struct<values:array<array<string>>>")["values"])
    rows = text.select(F.posexplode(cells).alias("_at", "_row"))
    first = rows.filter("_at = 0").select("_row").first()
    place = {h or "": i for i, h in enumerate(first._row if first else [])}
    header = list(place) or ["street"]
    raw = rows.filter("_at > 0").select((F.col("_at") + 1).cast("int").alias("_index"), *[F.coalesce(F.get("_row", F.lit(place.get(h, 0))), F.lit("")).alias(h) for h in header])
    return typed_rows(raw, "_index")


def sheet_problems(header: list[str]) -> list[str]:
    """What a sheet lacks: its missing fields, or that it is empty."""
    return missing_fields(header) if header else ["(empty sheet)"]


def _counted(raw: DataFrame) -> DataFrame:
    """Adds row_index, the sheet's rows from its second line on: the rows before a partition and those before a row within it.

    Only the partitions' numbers of rows meet in one task.
    """
    placed = raw.withColumn("_m", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_m", 33), "_o": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return placed.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("row_index", (F.col("_b") + F.col("_o") + 2).cast("int"))


def typed_rows(raw: DataFrame, index: str | None = None) -> DataFrame:
    """All-string rows of a sheet, in its order, as the fixed schema; ``index`` names a column that has their row_index already."""
    header = [c for c in raw.columns if c != index]
    at = detect_columns(header)
    placed = _counted(raw) if index is None else raw.withColumnRenamed(index, "row_index")
    cell = lambda f: F.coalesce(F.col(f"`{at[f]}`"), F.lit("")) if at[f] else F.lit("")
    number = lambda f: F.regexp_extract(cell(f), r"^\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1).try_cast("double")
    rows = placed.select(
        "row_index",
        F.trim(cell("street")).alias("street"),
        F.trim(cell("status")).alias("status"),
        leading_int(cell("residences")).alias("residences"),
        F.trim(cell("ward_name")).alias("ward_name"),
        F.trim(cell("constituency")).alias("constituency"),
        number("lat").alias("lat"),
        number("lon").alias("lon"),
        cell("road_geometry").alias("road_geometry"),
        F.when(cell("partial_geometry") == "", "-").otherwise(cell("partial_geometry")).alias("partial_geometry"),
        F.array(*[F.col(f"`{h}`") for h in header]).alias("_cells"),
    )
    split = network_split(rows.withColumn("_all", F.array_join("_cells", "\n")), "row_index", ["street", *[c for c in ("status", "ward_name") if at[c]]])
    return split.drop("_cells", "_all")


def read_address_points(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """lat, lon of a national address file, within (min lat, min lon, max lat, max lon); the filter reaches the scan."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip().upper(): c for c in raw.columns}
    absent = [c for c in ("LATITUDE", "LONGITUDE") if c not in names]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    points = raw.select(F.col(f"`{names['LATITUDE']}`").try_cast("double").alias("lat"), F.col(f"`{names['LONGITUDE']}`").try_cast("double").alias("lon")).filter("lat is not null and lon is not null")
    return points if box is None else points.filter(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))


def read_poi_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (name, lat, lon) and coverage boxes of a cache file."""
    schema = "coverage array<struct<bbox:array<double>,fetchedAt:string>>, pubs array<struct<name:string,lat:double,lon:double>>"
    cache = spark.read.schema(schema).option("multiLine", True).json(path)
    points = cache.select(F.explode("pubs").alias("p")).select("p.name", "p.lat", "p.lon")
    boxes = cache.select(F.explode("coverage").alias("c")).select(*[F.col("c.bbox")[i].alias(n) for i, n in enumerate(("min_lat", "min_lon", "max_lat", "max_lon"))], F.col("c.fetchedAt").alias("fetched_at"))
    return points, boxes


def read_poi_response(spark: SparkSession, path: str) -> DataFrame:
    """Named points of a landed service response: pubs as nodes or ways (by their centres), bars as nodes."""
    schema = "elements array<struct<type:string,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    kind, name = F.try_element_at("e.tags", F.lit("amenity")), F.try_element_at("e.tags", F.lit("name"))
    wanted = name.isNotNull() & ((kind == "pub") | ((kind == "bar") & (F.col("e.type") == "node")))
    return found.filter(wanted).select(name.alias("name"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"))


def read_home_index(spark: SparkSession, path: str, version: int = 1, lines: bool = False) -> DataFrame:
    """row_key, positions (thousandths by fragment) of a home index of the right version: one document, or a folder of lines."""
    schema = "version int, roads map<string,array<array<int>>>"
    return spark.read.schema(schema).option("multiLine", not lines).json(path).filter(F.col("version") == version).select(F.explode("roads").alias("row_key", "positions"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """filename and its entry."""
    entry = "struct<ward:string,constituency:string,generatedAt:string,publishId:string,sheets:string>"
    text = spark.read.text(path, wholetext=True)
    pages = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("filename", "e"))
    return pages.select("filename", "e.ward", "e.constituency", F.col("e.generatedAt").try_cast("timestamp").alias("generated_at"), F.col("e.publishId").alias("publish_id"), "e.sheets")


def read_deployments(spark: SparkSession, path: str) -> DataFrame:
    """The areas of a registry file as maps of text: a list, or an object whose ``deployments`` is one.

    A file that is neither has no areas.
    """
    items = "array<map<string,string>>"
    text = spark.read.text(path, wholetext=True)
    is_list = F.ltrim("value").startswith("[")
    found = F.when(is_list, F.from_json("value", items)).otherwise(F.from_json("value", f"struct<deployments:{items}>")["deployments"])
    return text.select(F.explode(found).alias("deployment"))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """filename, modified, bytes of the files in a folder; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def tracker_settings(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds a column for each setting that a page's script assigns."""
    for name in SETTINGS:
        pages = pages.withColumn(name.lower(), F.nullif(F.regexp_extract(html, name + r"""\s*[:=]\s*["']([^"']*)["']""", 1), F.lit("")))
    return pages


def index_url(url: Column) -> Column:
    """The page to read of a deployment's address: itself if it names a page, else its index."""
    bare = F.trim(url)
    return F.when(bare.rlike(r"(?i)\.html?(\?|#|$)"), bare).otherwise(F.concat(F.regexp_replace(bare, "/?$", ""), F.lit("/index.html")))


def tracker_configs(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settings of trackers with their defaults, and why the other pages have none: (url, …, csv_url) and (url, reason).

    pages: url, html (null if it could not be fetched), status (of the answer; null if there was none).
    """
    # only what the page's own block of settings holds (a fixed form)
    block = F.regexp_extract("html", r"(?s)(?:window\.)?MAP_CONFIG\s*=\s*\{(.*?)\n\s*\};", 1)
    read = tracker_settings(pages.withColumns({"_url": index_url(F.col("url")), "_block": block}), "_block")
    reason = (
        F.when(F.col("status").isNull(), F.concat(F.lit("no answer from "), "_url"))
        .when(~F.col("status").between(200, 299), F.concat(F.lit("could not fetch "), "_url", F.lit(" (HTTP "), F.col("status").cast("string"), F.lit(")")))
        .when(F.col("sheet_id").isNull(), "no SHEET_ID in the page's settings")
    )
    judged = read.withColumn("reason", reason)
    sheet = F.coalesce("sheet_gid", F.lit("0"))
    # Fixed value: the address of a published sheet as CSV
    csv = F.concat(F.lit("https://docs.google.com/spreadsheets/d/e/"), "sheet_id", F.lit("/pub?gid="), sheet, F.lit("&single=true&output=csv"))
    known = judged.filter("reason is null").select("url", "sheet_id", sheet.alias("sheet_gid"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("apps_script_url", "google_client_id", "title", "subtitle")], csv.alias("csv_url"))
    return known, judged.filter("reason is not null").select("url", "reason")
