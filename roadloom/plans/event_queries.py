"""Queries of events: hubs, route records, documents of wards, over the driver's tables. See ``walk_queries`` for the roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators import events, homes, publishing, splits
from roadloom.operators.network import Rounds, large
from roadloom.plans.driver_queries import EDGES_SQL, LAT0, ROADS_SQL, S_LAT, S_LON, _cluster_input, _ward_edges, grid_roads, key_point, metres_sql, query, table
from roadloom.plans.walk_queries import SEG_SQL, near_sql, order_homes, segments
from roadloom.sources import pages, sheets

#: Routes of given clusters: seven in a ward, of which the odd ones are the second hub's.
GIVEN_SQL = f"""{ROADS_SQL}, {EDGES_SQL}, m0 AS (SELECT k, ward, k // 30 % 7 AS c, k // 30 % 7 % 2 AS hub, residences, status, lon0, lat0 FROM road),
num AS (SELECT ward, hub, c, row_number() OVER (PARTITION BY ward ORDER BY hub, c) AS place FROM (SELECT DISTINCT ward, hub, c FROM m0)),
m AS (SELECT m0.*, chr((64 + place)::INTEGER) AS route, CASE c % 3 WHEN 0 THEN 'walk' WHEN 1 THEN 'hybrid' ELSE 'drive' END AS kind FROM m0 JOIN num USING (ward, hub, c)),
both_ AS (SELECT src, dst FROM pair UNION SELECT dst, src FROM pair),
near_ AS (SELECT a.ward, a.route, a.k, b.k AS n FROM both_ JOIN m a ON src = a.k JOIN m b ON dst = b.k AND a.ward = b.ward AND a.route = b.route),
deg AS (SELECT k, count(*) AS degree FROM near_ GROUP BY 1), edges_ AS (SELECT ward, route, count(*) FILTER (WHERE k < n) AS e FROM near_ GROUP BY 1, 2),
park AS (SELECT ward, route, m.k AS parking, lon0, lat0 FROM m LEFT JOIN deg USING (k) QUALIFY row_number() OVER (PARTITION BY ward, route ORDER BY coalesce(degree, 0) DESC, residences DESC, m.k) = 1),
street AS (SELECT ward, route, 'Lane ' || k % 9 AS street, sum(residences) AS n FROM m GROUP BY 1, 2, 3), top_ AS (SELECT *, row_number() OVER (PARTITION BY ward, route ORDER BY n DESC, street) AS r FROM street WHERE n > 0),
name_ AS (SELECT ward, route, string_agg(street, ' & ' ORDER BY r) AS name FROM top_ WHERE r <= 2 GROUP BY 1, 2),
rec AS (SELECT ward, route, any_value(hub) AS hub, any_value(kind) AS kind, sum(residences)::DOUBLE AS residences, count(*) AS roads, bool_or(c = 5) AS merged FROM m GROUP BY 1, 2)"""


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of given clusters, neighbours, and hubs."""
    c = F.floor(F.col("k") / 30) % 7
    kind = F.when(c % 3 == 0, "walk").when(c % 3 == 1, "hybrid").otherwise("drive")
    points = F.array(geo.point(F.col("lon0"), F.col("lat0")), geo.point(F.col("lon0") + 0.002, F.col("lat0")))
    r = grid_roads(spark, sf_dir)
    members = r.select(
        F.col("ward").cast("string").alias("ward"), (c % 2).alias("hub_seq"), c.alias("cluster"), F.col("k").alias("seq"), F.col("k").cast("string").alias("road"), F.concat(F.lit("Lane "), (F.col("k") % 9).cast("string")).alias("street"),
        "status", "residences", F.col("k").alias("row_index"), kind.alias("kind"), (c == 5).alias("merged"), (F.col("lon0") + 0.0005).alias("lon"), (F.col("lat0") + 0.001).alias("lat"), points.alias("points"),
    )
    edges = _ward_edges(spark, sf_dir)[1].select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    n = table(spark, sf_dir, "nation", "n_nationkey").withColumn("hub_seq", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    hubs = n.select(F.col("n_nationkey").cast("string").alias("ward"), "hub_seq", F.concat(F.lit("H"), (F.col("hub_seq") + 1).cast("string")).alias("id"), F.concat(F.lit("Inn "), F.col("hub_seq").cast("string")).alias("label"), (F.lit(-2.4) + F.col("hub_seq") * 0.1).alias("lon"), F.lit(52.7).alias("lat"))
    return members, edges, hubs


@query(f"""WITH {GIVEN_SQL}, hint AS (SELECT rec.*, name, CASE WHEN coalesce(e, 0) >= roads THEN 'loop' ELSE 'out-and-back' END AS shape, parking, lon0, lat0 FROM rec LEFT JOIN name_ USING (ward, route) LEFT JOIN edges_ USING (ward, route) JOIN park USING (ward, route))
SELECT ward::VARCHAR AS ward, route, 'H' || (hub + 1) AS hub_id, coalesce(name, '') AS name, kind, shape, residences, roads, merged AS review,
  CASE kind WHEN 'walk' THEN 'Inn ' || hub || ' (event start point)' WHEN 'hybrid' THEN 'Drive to ' || parking || ' and park there (suggested — please use your own discretion), then walk the route' ELSE 'Park on ' || parking || ' (suggested — please use your own discretion)' END AS start_hint,
  CASE WHEN kind <> 'walk' THEN parking::VARCHAR END AS parking, CASE WHEN kind <> 'walk' THEN round(lon0 + 5e-4, 6) END AS lon, CASE WHEN kind <> 'walk' THEN round(lat0, 6) END AS lat FROM hint""")
def route_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events.route_records(*_given(spark, sf_dir))
    marker = [F.col("marker.label").alias("parking"), F.round("marker.lon", 6).alias("lon"), F.round("marker.lat", 6).alias("lat")]
    return made.select("ward", "route", "hub_id", "name", "kind", "shape", "residences", F.size("roads").cast("long").alias("roads"), (F.col("notes") != "").alias("review"), "start_hint", *marker)


@query(f"""WITH {ROADS_SQL} SELECT ward::VARCHAR AS ward, count(DISTINCT k // 30 % 7) AS routes, sum(residences)::DOUBLE AS residences, 'Inn 0' AS start, 2::INTEGER AS hubs, round(min(lon0), 6) AS min_lon, round(max(lon0) + 2e-3, 6) AS max_lon, round(min(lat0), 6) AS min_lat, round(max(lat0), 6) AS max_lat FROM road GROUP BY 1""")
def ward_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, edges, hubs = _given(spark, sf_dir)
    made = events.ward_documents(events.route_records(members, edges, hubs), hubs)
    return made.select("ward", "routes", "residences", F.col("start.label").alias("start"), F.size("hubs").alias("hubs"), *[F.round(f"bounds.{c}", 6).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")])


@query(f"""WITH {ROADS_SQL}, r AS (SELECT ward, k // 30 % 7 AS c, sum(residences) AS n FROM road GROUP BY 1, 2)
SELECT ward::VARCHAR AS ward, count(*) AS routes, sum(n)::DOUBLE AS residences, count(*) FILTER (WHERE c % 3 = 0) AS walk, count(*) FILTER (WHERE c % 3 = 1) AS hybrid, count(*) FILTER (WHERE c % 3 = 2) AS drive FROM r GROUP BY 1""")
def cover_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cover_stats(events.route_records(*_given(spark, sf_dir)))


@query(f"""WITH c AS (SELECT n_nationkey AS ward, n_regionkey AS district, -25e-1 + n_nationkey::DOUBLE * 2e-2 AS lon, 526e-1 + n_nationkey::DOUBLE * 1e-2 AS lat FROM nation),
p AS (SELECT s_name AS poi, s_suppkey % 4 AS pd, {S_LON} AS p_lon, {S_LAT} AS p_lat FROM supplier), b AS (SELECT *, {metres_sql('lon', 'lat', 'p_lon', 'p_lat', 'lat')} AS d FROM c LEFT JOIN p ON pd = district)
SELECT ward::VARCHAR AS ward, coalesce(poi, 'Settlement 3 centre') AS label, round(coalesce(p_lon, lon), 6) AS lon, round(coalesce(p_lat, lat), 6) AS lat FROM b QUALIFY row_number() OVER (PARTITION BY ward ORDER BY d, poi) = 1""")
def nearest_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth region has no points of interest, so its wards start at their own centres."""
    n = F.col("n_nationkey")
    centres = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(n.cast("string").alias("ward"), F.lit(3).cast("long").alias("hub_seq"), F.col("n_regionkey").cast("long").alias("district"), (F.lit(-2.5) + n.cast("double") * 0.02).alias("lon"), (F.lit(52.6) + n.cast("double") * 0.01).alias("lat"))
    lon, lat = key_point(F.col("s_suppkey"))
    pois = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select((F.col("s_suppkey") % 4).cast("long").alias("district"), F.col("s_name").alias("poi"), lon.alias("p_lon"), lat.alias("p_lat"))
    return events.nearest_hubs(centres, pois).select("ward", "label", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""WITH r AS (SELECT c_custkey AS road, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_custkey % 60 END AS n, 'homes' AS by_ FROM customer)
SELECT road, 'homes' AS by, greatest(floor(n / 2e1 + 5e-1), ceil(n / 25e0))::INTEGER AS k FROM r WHERE greatest(floor(n / 2e1 + 5e-1), ceil(n / 25e0)) >= 2
UNION ALL SELECT road, 'effort', ceil(n * 625e-2 / 15e1)::INTEGER FROM r WHERE ceil(n * 625e-2 / 15e1) >= 2""")
def oversized_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict sizes by homes, and sizes by effort of roads of five kilometres, on which a home counts most."""
    r = grid_roads(spark, sf_dir).select(F.col("k").alias("road"), "status", "residences", F.lit(5000.0).alias("length_m"))
    cut = splits.oversized(r, 20.0, strict=True).withColumn("by", F.lit("homes")).unionByName(splits.oversized(r, by_effort=True).withColumn("by", F.lit("effort")))
    return cut.unionByName(splits.oversized(r).withColumn("by", F.lit("none")))


@query(f"""WITH {SEG_SQL}, near AS (SELECT * FROM home JOIN seg ON hk = k AND seq = 0), {near_sql('near')} SELECT DISTINCT k AS road, pt FROM z WHERE d <= 2e0""")
def points_on_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homes that lie on the first half of their road."""
    first = segments(spark, sf_dir).filter("seq = 0").select(F.col("k").alias("road"), F.lit(0).alias("piece"), "seq", "a_lon", "a_lat", "b_lon", "b_lat", F.lit(0.0).alias("from_m"))
    return homes.points_on(order_homes(spark, sf_dir), first, LAT0).select("road", "pt")


@query("""SELECT count(*) AS points, count(*) FILTER (WHERE o_orderkey % 5 > 0) AS placed, count(*) FILTER (WHERE o_orderkey % 5 = 4) AS far, count(DISTINCT o_custkey) FILTER (WHERE o_orderkey % 5 > 0) AS roads FROM orders""")
def home_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderkey") % 5
    return homes.build_stats(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("pt"), F.when(at > 0, at).alias("seg"), F.when(at > 0, F.col("o_custkey")).alias("road"), F.when(at > 0, at == 4).alias("far")))


@query("""SELECT url AS filename, page_id % 3 > 0 AS there FROM pages""")
def manifest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url").withColumnRenamed("url", "filename")
    listing = p.filter("page_id % 3 > 0").select("filename")
    return publishing.still_there(p, listing).withColumn("there", F.lit(True)).unionByName(publishing.vanished(p, listing).withColumn("there", F.lit(False))).select("filename", "there")


def road_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as roads of an event, whose ward is a nation and whose district a ward of its own."""
    points = F.array(*[geo.point(F.col("lon0") + F.lit(float(i)) * 0.001, F.col("lat0") + (0.0002 if i == 1 else 0.0)) for i in range(3)])
    known = grid_roads(spark, sf_dir).select(F.col("road").alias("name"), F.concat(F.lit("Lane "), (F.col("k") % 9).cast("string")).alias("street"), "status", F.col("k").alias("row_index"), points.alias("points"))
    base = _cluster_input(spark, sf_dir).drop("dist_m").join(large(known), F.col("road") == F.col("name")).drop("name")
    return base.withColumns({"length_m": F.lit(140.0), "district": F.col("ward")})


@query()
def multi_hub_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("s_suppkey"))
    pois = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_name").select(F.col("s_nationkey").cast("string").alias("district"), F.col("s_name").alias("poi"), lon.alias("p_lon"), lat.alias("p_lat"))
    return events.multi_hub(road_table(spark, sf_dir), pois, LAT0, target=150)[0]


@query()
def general_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.range(0).select(F.lit("").alias("district"), F.lit("").alias("poi"), F.lit(0.0).alias("p_lon"), F.lit(0.0).alias("p_lat"))
    return events.multi_hub(road_table(spark, sf_dir), none, LAT0, general=True, target=150)[1]


@query("""WITH p AS (SELECT page_id, page_id % 2 AS c, CASE WHEN page_id % 4 > 0 THEN 'p' || page_id % 37 END AS publish_id, 'ward-' || page_id % 7 AS base, 'w' || page_id AS ward, page_id % 6 = 0 AS sheets FROM pages),
one AS (SELECT * FROM p QUALIFY publish_id IS NULL OR row_number() OVER (PARTITION BY publish_id ORDER BY c, base, ward) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c, coalesce(publish_id, ''), ward) - 1 AS i FROM one), f AS (SELECT *, base || CASE WHEN i = 0 THEN '' ELSE i::VARCHAR END AS stem FROM n)
SELECT stem || '.html' AS filename, publish_id, ward, CASE WHEN sheets THEN stem || '-sheets.html' END AS sheets, bytes FROM f JOIN (SELECT page_id, strlen(coalesce(html, '')) AS bytes FROM pages) USING (page_id)""")
def published_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages published in two commits, some of them retries; the bytes are those of the files."""
    p, k = table(spark, sf_dir, "pages", "page_id", "html"), F.col("page_id")
    rows = p.select(
        F.when(k % 4 > 0, F.concat(F.lit("p"), (k % 37).cast("string"))).alias("publish_id"), F.concat(F.lit("ward-"), (k % 7).cast("string")).alias("base"), F.concat(F.lit("w"), k.cast("string")).alias("ward"),
        F.lit("north").alias("constituency"), "html", F.when(k % 6 == 0, "sheets").alias("sheets"), (k % 2).alias("c"),
    )
    folder = Rounds(p).base
    for c in (0, 1):
        pages.publish(rows.filter(F.col("c") == c), f"{folder}/site", now="2024-05-20T12:00:00+00:00")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(f"{folder}/site").select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"))
    return pages.published(spark, f"{folder}/site").join(files, "filename").select("filename", "publish_id", "ward", "sheets", "bytes")


@query("""SELECT c_custkey + 2 AS row_index, 'Road ' || c_custkey % 50 AS street, CASE c_custkey % 3 WHEN 0 THEN 'Complete' ELSE 'Not_Started' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey % 60 END AS residences, 'W' || c_nationkey AS ward_name,
CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 90) / 1e1 END AS lat, '' AS geometry, c_custkey >= 1000 AS is_network FROM customer WHERE c_custkey <> 1000 AND NOT (c_custkey > 1000 AND c_custkey % 11 = 0)""")
def values_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a grid of values with short rows; from the thousandth on, which is the marker, rows are roads to walk along only."""
    k = F.col("c_custkey")
    street = F.when(k == 1000, "## route_planner_only_below ##").when((k > 1000) & (k % 11 == 0), "").otherwise(F.concat(F.lit("Road "), (k % 50).cast("string")))
    cells = F.array(street, F.when(k % 3 == 0, "Complete").otherwise("Not_Started"), F.when(k % 5 == 0, "-").otherwise((k % 60).cast("string")), F.concat(F.lit("W"), F.col("c_nationkey").cast("string")))
    full = F.when(k % 7 > 0, F.concat(cells, F.array(((k % 90) / 10.0).cast("string"), F.lit("9")))).otherwise(cells)
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(k, full.alias("cells")))), lambda r: r["cells"]).alias("rows"))
    header = F.array(F.array(*map(F.lit, ("Street", "STATUS", "UPRN count", "Ward", "@lat", "@lon", "Road Geometry"))))
    folder = Rounds(c).base
    c.select(F.to_json(F.struct(F.concat(header, "rows").alias("values"))).alias("value")).write.text(f"{folder}/grid")
    read = sheets.read_values_grid(spark, f"{folder}/grid")
    return read.select(F.col("row_index").cast("long").alias("row_index"), "street", "status", F.col("residences").cast("long").alias("residences"), "ward_name", "lat", F.col("road_geometry").alias("geometry"), "is_network")


@query("""WITH p AS (SELECT page_id AS k, 'https://site' || page_id || CASE page_id % 3 WHEN 0 THEN '.test/map/' WHEN 1 THEN '.test/map' ELSE '.test/Map.HTML?x=1' END AS url FROM pages), i AS (SELECT *, CASE k % 3 WHEN 0 THEN url || 'index.html' WHEN 1 THEN url || '/index.html' ELSE url END AS page FROM p)
SELECT url, CASE WHEN k % 5 = 0 THEN 'no answer from ' || page WHEN k % 5 = 1 THEN 'could not fetch ' || page || ' (HTTP 404)' WHEN k % 7 = 0 THEN 'no SHEET_ID in the page''s settings' ELSE 'S' || k || '|' || CASE WHEN k % 2 = 0 THEN '0' ELSE 'g' || k END || '|' || CASE WHEN k % 4 = 0 THEN '' ELSE 'Title ' || k END
 || '|https://docs.google.com/spreadsheets/d/e/S' || k || '/pub?gid=' || CASE WHEN k % 2 = 0 THEN '0' ELSE 'g' || k END || '&single=true&output=csv' END AS what FROM i""")
def tracker_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of trackers: some give no answer, some an error, some lack their sheet; gid and title have defaults."""
    k = F.col("page_id")
    named = k.cast("string")
    url = F.concat(F.lit("https://site"), named, F.when(k % 3 == 0, ".test/map/").when(k % 3 == 1, ".test/map").otherwise(".test/Map.HTML?x=1"))
    field = lambda name, value, there: F.when(there, F.concat(F.lit(f"\n  {name}: '"), value, F.lit("',"))).otherwise("")
    block = F.concat(F.lit("<script>var SHEET_ID = 'elsewhere';\nwindow.MAP_CONFIG = {"), field("SHEET_ID", F.concat(F.lit("S"), named), k % 7 > 0), field("SHEET_GID", F.concat(F.lit("g"), named), k % 2 == 1), field("TITLE", F.concat(F.lit("Title "), named), k % 4 > 0), F.lit("\n};</script>"))
    p = table(spark, sf_dir, "pages", "page_id").select(url.alias("url"), block.alias("html"), F.when(k % 5 == 1, 404).when(k % 5 > 1, 200).alias("status"))
    known, errors = sheets.tracker_configs(p)
    return known.select("url", F.concat_ws("|", "sheet_id", "sheet_gid", "title", "csv_url").alias("what")).union(errors)
