"""Queries that write files of the formats the library reads, out of the driver's tables, and read them again; and cuts of roads.

Each has its SQL over the tables that the files were made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import sql
from roadloom.functions.geo import X_DEGREE
from roadloom.operators import homes, junctions, publishing, splits
from roadloom.operators.network import Rounds
from roadloom.plans.driver_queries import LAT0, query, table
from roadloom.sources import sheets
from roadloom.streaming import progress

FLAT = 52.0


def _folder(df: DataFrame, name: str) -> str:
    return f"{Rounds(df).base}/{name}"


def _document(df: DataFrame, name: str, body: Column) -> str:
    """Writes a frame of one row as one text and returns its path."""
    path = _folder(df, name)
    df.select(body.cast("string").alias("value")).coalesce(1).write.text(path)
    return path


@query("""SELECT row_number() OVER (ORDER BY c_custkey) + 1 AS row_index, 'Lane "' || c_custkey || '",' || chr(10) || 'North' AS street, c_mktsegment AS status, c_custkey % 70 AS residences, 'W' || c_nationkey AS ward_name,
c_name AS constituency, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 90) / 8e0 END AS lat, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE 'seg0:0.1-0.2:B' END AS partial_geometry FROM customer""")
def csv_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a sheet with quoted quotes, commas and line breaks, and numbers with words behind them."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name", "c_mktsegment")
    raw = c.orderBy("c_custkey").coalesce(1).select(
        F.format_string('Lane "%d",\nNorth', k).alias("Road name"), F.concat(F.lit("W"), F.col("c_nationkey").cast("string")).alias("Ward"), F.col("c_name").alias("Local Authority District"), F.concat(F.lit("  "), "c_mktsegment").alias("status"),
        F.concat((k % 70).cast("string"), F.lit(",5 homes")).alias("Est-imated Residences"), F.when(k % 4 > 0, ((k % 90) / 8.0).cast("string")).otherwise("north").alias("@lat"), F.lit("").alias("@lon"), F.lit("").alias("Road Geometry"), F.when(k % 3 > 0, "seg0:0.1-0.2:B").alias("Partial Geometry"),
    )
    path = _folder(c, "sheet")
    raw.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    read = sheets.read_sheet(spark, path)
    return read.select(F.col("row_index").cast("long").alias("row_index"), "street", "status", F.col("residences").cast("long").alias("residences"), "ward_name", "constituency", "lat", "partial_geometry")


@query("""SELECT s_name AS what, (s_suppkey % 90) / 8e0 AS lat, (s_suppkey % 50) / 8e0 AS lon FROM supplier UNION ALL SELECT '2024-' || s_suppkey, (s_suppkey % 9) / 8e0, (s_suppkey % 7) / 8e0 FROM supplier WHERE s_suppkey % 3 = 0""")
def poi_cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the points and coverage boxes of a cache file."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    low = F.array((k % 9) / 8.0, (k % 7) / 8.0, k % 9 + 1.0, k % 7 + 1.0)
    box = F.when(k % 3 == 0, F.struct(low.alias("bbox"), F.concat(F.lit("2024-"), k.cast("string")).alias("fetchedAt")))
    point = F.struct(F.col("s_name").alias("name"), ((k % 90) / 8.0).alias("lat"), ((k % 50) / 8.0).alias("lon"))
    one = s.groupBy().agg(F.collect_list(box).alias("coverage"), F.collect_list(point).alias("pubs"))
    points, boxes = sheets.read_poi_cache(spark, _document(one, "cache", F.to_json(F.struct("coverage", "pubs"))))
    return points.select(F.col("name").alias("what"), "lat", "lon").union(boxes.select("fetched_at", "min_lat", "min_lon"))


@query("""SELECT s_name AS name, (s_suppkey % 90) / 8e0 AS lat, (s_suppkey % 50) / 8e0 AS lon FROM supplier WHERE s_suppkey % 7 > 0 AND (s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 2 = 0))""")
def poi_response_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as elements of a service's answer: pubs, bars and shops, as nodes and as ways with centres, some without a name."""
    k = F.col("s_suppkey")
    at = F.struct(((k % 90) / 8.0).alias("lat"), ((k % 50) / 8.0).alias("lon"))
    node = k % 2 == 0
    kind = F.when(k % 3 == 0, "pub").when(k % 3 == 1, "bar").otherwise("shop")
    tags = F.when(k % 7 > 0, F.create_map(F.lit("amenity"), kind, F.lit("name"), F.col("s_name"))).otherwise(F.create_map(F.lit("amenity"), kind))
    element = F.struct(F.when(node, "node").otherwise("way").alias("type"), F.when(node, at["lat"]).alias("lat"), F.when(node, at["lon"]).alias("lon"), F.when(~node, at).alias("center"), tags.alias("tags"))
    one = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").groupBy().agg(F.collect_list(element).alias("elements"))
    return sheets.read_poi_response(spark, _document(one, "answer", F.to_json(F.struct("elements"))))


@query("""SELECT 'k' || c_custkey AS row_key, (c_custkey % 1000) AS first, c_custkey % 3 AS fragments FROM customer WHERE c_custkey % 3 > 0""")
def home_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A home index that is written in parts and read again."""
    k = F.col("c_custkey")
    index = table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 3 > 0").select(F.concat(F.lit("k"), k.cast("string")).alias("row_key"), F.array_repeat(F.array((k % 1000).cast("int"), F.lit(999)), (k % 3).cast("int")).alias("positions"))
    path = _folder(index, "homes")
    homes.write_home_index(index, path)
    read = sheets.read_home_index(spark, path, lines=True)
    return read.select("row_key", F.get(F.get("positions", F.lit(0)), F.lit(0)).cast("long").alias("first"), F.size("positions").cast("long").alias("fragments")).unionByName(sheets.read_home_index(spark, path, version=2, lines=True).selectExpr("row_key", "0L as first", "0L as fragments"))


@query("""SELECT c_custkey AS k, round(52 + (c_custkey % 1000) / 1e3, 3) AS lat, round(-3 + (c_custkey % 700) / 1e3, 3) AS lon FROM customer WHERE c_custkey % 9 > 0 AND c_custkey % 1000 BETWEEN 200 AND 800 AND c_custkey % 700 BETWEEN 100 AND 600""")
def address_points_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a national address file, of which a box is read; some have no numbers."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("UPRN"), F.when(k % 9 > 0, F.format_string("%.3f", 52 + (k % 1000) / 1000.0)).otherwise("n/a").alias("LATITUDE"), F.format_string("%.3f", -3 + (k % 700) / 1000.0).alias("LONGITUDE"))
    path = _folder(c, "points")
    c.write.option("header", True).csv(path)
    points = sheets.read_address_points(spark, path, (52.2, -2.9, 52.8, -2.4))
    met = points.select(F.round((F.col("lat") - 52) * 1000).cast("long").alias("_a"), F.round((F.col("lon") + 3) * 1000).cast("long").alias("_b"), "lat", "lon")
    known = table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 9 > 0").select(k.alias("k"), (k % 1000).alias("_a"), (k % 700).alias("_b"))
    return known.join(met.distinct(), ["_a", "_b"]).select("k", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@query("""SELECT 'page' || page_id || '.html' AS filename, 'W' || page_id % 7 AS ward, CASE WHEN page_id % 5 > 0 THEN TIMESTAMP '2024-05-01 00:00:00' + INTERVAL (page_id) HOUR END AS generated_at, CASE WHEN page_id % 3 = 0 THEN 'p' || page_id END AS publish_id FROM pages""")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a manifest, some with times that are none."""
    k = F.col("page_id")
    at = F.when(k % 5 > 0, F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-05-01 00:00:00").cast("timestamp")) + k * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("yesterday")
    entry = F.struct(F.concat(F.lit("W"), (k % 7).cast("string")).alias("ward"), F.lit("north").alias("constituency"), at.alias("generatedAt"), F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).alias("publishId"))
    one = table(spark, sf_dir, "pages", "page_id").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.format_string("page%d.html", k), entry))).alias("m"))
    read = sheets.read_manifest(spark, _document(one, "manifest", F.to_json("m")))
    return read.select("filename", "ward", F.col("generated_at").cast("timestamp_ntz").alias("generated_at"), "publish_id")


@query("""SELECT 'Area ' || n_nationkey AS name, 'https://area' || n_nationkey || '.test/' AS url, CASE n_regionkey % 2 WHEN 0 THEN 'list' ELSE 'object' END AS form FROM nation""")
def deployments_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as two registries of areas, a list and an object with a list, beside a file that is neither."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").withColumn("odd", F.col("n_regionkey") % 2)
    area = F.struct(F.concat(F.lit("Area "), k.cast("string")).alias("name"), F.format_string("https://area%d.test/", k).alias("url"))
    of = lambda odd: n.filter(F.col("odd") == odd).groupBy().agg(F.collect_list(area).alias("deployments"))
    lists, objects, other = _document(of(0), "list", F.to_json("deployments")), _document(of(1), "object", F.to_json(F.struct("deployments"))), _document(of(1), "other", F.lit('{"areas": 3}'))
    read = lambda path, form: sheets.read_deployments(spark, path).select(F.col("deployment")["name"].alias("name"), F.col("deployment")["url"].alias("url"), F.lit(form).alias("form"))
    return read(lists, "list").union(read(objects, "object")).union(read(other, "other"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'review' END AS queue FROM events""")
def routed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of authorised users are written, those of others, or of unknown ones, are reviewed."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events", "event_id").withColumn("allowed", F.when(k % 3 == 0, True).when(k % 3 == 1, False))
    now, later = progress.routed(e, F.col("allowed"))
    return now.select("event_id", F.lit("write").alias("queue")).union(later.select("event_id", F.lit("review")))


@query("""WITH t AS (SELECT s_suppkey % 3 AS b, s_suppkey // 3 AS n FROM supplier WHERE s_suppkey % 11 > 0), g AS (SELECT b, i FROM range(3) AS x(b), range(400) AS y(i) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.b = x.b AND t.n = i))
SELECT 'ward' || chr((97 + b)::INTEGER) || CASE WHEN min(i) = 0 THEN '' ELSE min(i)::VARCHAR END || '.html' AS name FROM g GROUP BY b""")
def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first free name of three wards whose pages are numbered by suppliers, with gaps."""
    k = F.col("s_suppkey")
    letter = F.element_at(F.array(*map(F.lit, "abc")), (k % 3 + 1).cast("int"))
    taken = table(spark, sf_dir, "supplier", "s_suppkey").filter("s_suppkey % 11 > 0").select(F.concat(F.lit("ward"), letter, F.when(F.floor(k / 3) == 0, "").otherwise(F.floor(k / 3).cast("string")), F.lit(".html")).alias("name"))
    a, b, c = (publishing.free_name(taken, f"ward{x}") for x in "abc")
    return a.union(b).union(c)


@query("""WITH p AS (SELECT c_custkey AS k, i AS n FROM customer, range(4) AS g(i) WHERE i < 1 + c_custkey % 4), u AS (SELECT c_custkey AS k, j FROM customer, range(1, 6) AS g(j) WHERE (c_custkey * j) % 3 = 1),
f AS (SELECT c_custkey AS k, j, row_number() OVER (PARTITION BY c_custkey ORDER BY j) - 1 AS n FROM customer, range(1, 12) AS g(j) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = c_custkey AND u.j = g.j))
SELECT 'Road ' || p.k AS road, p.n, 'Road ' || p.k || ' (part ' || j || ')' AS name FROM p JOIN f ON f.k = p.k AND f.n = p.n""")
def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of up to four parts of a road, past numbers that are taken."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey")
    road = F.concat(F.lit("Road "), k.cast("string"))
    parts = c.select(road.alias("road"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("n"))
    taken = c.select(road.alias("_road"), k, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("j")).filter("(c_custkey * j) % 3 = 1").select(F.format_string("%s (part %d)", "_road", "j").alias("road")).union(c.select(road))
    return splits.part_names(parts, taken).select("road", F.col("n").cast("long").alias("n"), "name")


def _flat_line(k: Column, points: list[tuple[int, int, Column]]) -> Column:
    """frag, idx, lon, lat of points (frag, idx, metres from the west)."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(FLAT)))
    return F.explode(F.array(*[F.struct(F.lit(f).alias("frag"), F.lit(i).alias("idx"), (F.lit(-2.0) + m / x).alias("lon"), F.lit(FLAT).alias("lat")) for f, i, m in points]))


@query("""WITH h AS (SELECT o_custkey AS k, ((o_orderkey * 7919) % 2000)::DOUBLE AS pos FROM orders), n AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY k ORDER BY pos) <= 250 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM n), s AS (SELECT k, greatest(min(pos) - 30, 0) AS a, least(max(pos) + 30, 2000) AS b, count(*) AS homes FROM g GROUP BY k, i), kept AS (SELECT * FROM s WHERE b - a > 1),
w AS (SELECT kept.*, sum(b - a) OVER (PARTITION BY k) AS len, (SELECT count(*) FROM h WHERE h.k = kept.k) AS placed FROM kept)
SELECT k AS road, row_number() OVER (PARTITION BY k ORDER BY a) - 1 AS part, round(a, 2) AS a, round(b, 2) AS b, round((k % 60) * homes / placed::DOUBLE, 4) AS residences FROM w JOIN customer ON c_custkey = k WHERE len < 85e-2 * 2000 AND k % 60 > 0 AND k % 5 > 0""")
def trimmed_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight roads of two kilometres, cut down to where orders stand along them; every fifth road is finished."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey")
    lines = splits.with_positions(c.select(k.alias("road"), _flat_line(k, [(0, 0, F.lit(0.0)), (0, 1, F.lit(2000.0))]).alias("v")).select("road", "v.*"), FLAT)
    roads = c.select(k.alias("road"), F.when(k % 5 == 0, "Complete").otherwise("Not_Started").alias("status"), (k % 60).alias("residences"))
    placed = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("road"), F.lit(0).alias("frag"), ((F.col("o_orderkey") * 7919) % 2000).cast("double").alias("pos"))
    made = splits.trim_to_homes(roads, lines, placed)
    return made.select("road", F.col("part").cast("long").alias("part"), F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("residences", 4).alias("residences"))


@query("""WITH RECURSIVE f AS (SELECT DISTINCT o_custkey AS k, ((o_orderkey * 7919) % 1000) / 1e3 AS f FROM orders), r AS (SELECT k, min(f) AS f FROM f GROUP BY k UNION ALL SELECT r.k, min(f.f) FROM r JOIN f ON f.k = r.k AND f.f - r.f > 8e-2 GROUP BY r.k, r.f) SELECT k AS road, f AS cut FROM r""")
def thinned_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along a road of which each lies more than 0.08 beyond the last one kept."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").groupBy(F.col("o_custkey").alias("road")).agg(F.collect_set(((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("f"))
    return o.select("road", F.explode(splits.thinned(F.col("f"))).alias("cut"))


@query("""WITH g AS (SELECT c_custkey AS k, i, CASE WHEN i = 0 THEN 0 ELSE (c_custkey * (i + 6)) % 1000 END AS gap FROM customer, range(4) AS g(i)), s AS (SELECT *, 1 + sum(CASE WHEN gap > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS area FROM g WHERE gap NOT BETWEEN 599 AND 601 OR true)
SELECT k AS road, i AS frag, area::BIGINT AS area, (max(area) OVER (PARTITION BY k))::BIGINT AS n_areas FROM s WHERE k % 1000 NOT IN (600)""")
def split_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fragments in a row with gaps by the key; those within 600 m of each other are one area."""
    k = F.col("c_custkey")
    gap = lambda i: (k * (i + 6)) % 1000 if i else F.lit(0)
    points, at = [], F.lit(0.0)
    for i in range(4):
        at = at + gap(i).cast("double")
        points += [(i, 0, at), (i, 1, at + 100.0)]
        at = at + 100.0
    c = table(spark, sf_dir, "customer", "c_custkey").filter("c_custkey % 1000 <> 600")
    lines = c.select(k.alias("road"), _flat_line(k, points).alias("v")).select("road", "v.*")
    return splits.split_disconnected(lines, FLAT, 600.001).select("road", F.col("frag").cast("long").alias("frag"), F.col("area").cast("long").alias("area"), F.col("n_areas").cast("long").alias("n_areas"))


@query("""SELECT c_custkey AS road, (i + c_custkey) % 3 AS frag, i AS place, (c_custkey + i) % 2 = 1 AS turned FROM customer, range(3) AS g(i)""")
def chained_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fragments of a street, numbered and turned by the key, put end to end from the end that is farthest out."""
    k = F.col("c_custkey")
    spans = ((0.0, 100.0), (120.0, 300.0), (310.0, 350.0))
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(FLAT)))
    turned = lambda i: (k + i) % 2 == 1
    vertex = lambda i, j: F.struct(((k + i) % 3).cast("int").alias("frag"), F.lit(j).alias("idx"), (F.lit(-2.0) + F.when(turned(i), spans[i][1 - j]).otherwise(spans[i][j]) / x).alias("lon"), F.lit(FLAT).alias("lat"))
    lines = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("road"), F.explode(F.array(*[vertex(i, j) for i in range(3) for j in (0, 1)])).alias("v")).select("road", "v.*")
    return splits.chained(lines, FLAT).select("road", F.col("frag").cast("long").alias("frag"), F.col("place").cast("long").alias("place"), "turned")


def _corner(k: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return F.lit(-3.0) + (k % 40) * 0.02 + x / (F.lit(X_DEGREE) * F.cos(F.radians(F.lit(LAT0)))), F.lit(52.0) + F.floor(k / 40) * 0.02 + y / 110540.0


def _crossings(spark: SparkSession, sf_dir: str, side: Column) -> DataFrame:
    """line, idx, pos, lon, lat: of each customer a main line 2k of 400 m with vertices every 100 m, and a line 2k + 1 that begins ``side`` metres beside it, at 100 or 250 m."""
    k = F.col("c_custkey")
    s = F.when(k % 2 == 0, 100.0).otherwise(250.0)
    at = lambda r, i, pos, x, y: F.struct((2 * k + r).alias("line"), F.lit(i).alias("idx"), F.lit(float(pos)).alias("pos"), x.alias("x"), y.alias("y"))
    points = [at(0, i, 100 * i, F.lit(100.0 * i), F.lit(0.0)) for i in range(5)] + [at(1, 0, 0, s, side), at(1, 1, 120, s, side + 120.0)]
    made = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(F.array(*points)).alias("p"))
    lon, lat = _corner(F.col("c_custkey"), F.col("p.x"), F.col("p.y"))
    return made.select("p.line", "p.idx", "p.pos", lon.alias("lon"), lat.alias("lat"))


@query("""SELECT 2 * c_custkey + 1 AS line, 0e0 AS end_pos, 2 * c_custkey AS other, CASE WHEN c_custkey % 2 = 0 THEN 1e2 ELSE 25e1 END AS pos FROM customer WHERE c_custkey % 37 < 20""")
def touching_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that end up to 36 m beside another: those within 20 m touch it there."""
    vertices = _crossings(spark, sf_dir, F.col("c_custkey") % 37 + 0.5)
    return junctions.touching_ends(vertices, LAT0).select("line", "end_pos", "other", F.round("pos", 2).alias("pos"))


@query("""SELECT 2 * c_custkey + r AS line, CASE r WHEN 0 THEN 1e2 ELSE 0e0 END AS pos FROM customer, range(2) AS g(r) WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0""")
def shared_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that two lines share; every third line begins on the other, and only at 100 m that has a vertex."""
    vertices = _crossings(spark, sf_dir, F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(9.0))
    return junctions.shared_vertices(vertices, LAT0).select("line", F.round("pos", 2).alias("pos"))


@query("""SELECT o_custkey AS road, o_orderkey AS pt FROM orders WHERE o_orderkey % 7 <= 3 AND (o_orderkey * 31) % 500 BETWEEN 120 AND 300""")
def half_done_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches done on one side whose middle lies within three metres of the part from 120 to 300 m of their road."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    lon, lat = _corner(k, F.lit(120.0), F.lit(0.0))
    to_lon, _ = _corner(k, F.lit(300.0), F.lit(0.0))
    pieces = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("road"), F.lit(0).alias("piece"), F.lit(0).alias("seq"), lon.alias("a_lon"), lat.alias("a_lat"), to_lon.alias("b_lon"), lat.alias("b_lat"), F.lit(0.0).alias("from_m"))
    # beside the line by whole metres but a little less, so that none lies just at three
    x, y = _corner(F.col("o_custkey"), ((o * 31) % 500).cast("double"), (o % 7).cast("double") * 0.99)
    stretches = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("road"), o.alias("pt"), x.alias("lon"), y.alias("lat")).filter("pt * 31 % 500 not between 114 and 119 and pt * 31 % 500 not between 301 and 306")
    return homes.half_done_of_parts(stretches, pieces, LAT0).select("road", "pt")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS kind FROM customer WHERE c_custkey % 5 < 4),
v AS (SELECT k, f, i FROM c, range(2) AS a(f), range(3) AS b(i) WHERE (kind = 0) OR (kind = 1 AND f = 0) OR (kind = 2 AND f = 0))
SELECT k, 'vertex' AS what, f::INTEGER AS frag, i::INTEGER AS place, round(k % 90 + f + i / 8e0, 4) AS a, round(50 + i / 4e0, 4) AS b, '' AS side FROM v
UNION ALL SELECT c_custkey, 'stretch', (c_custkey % 4)::INTEGER, t::INTEGER, round(least(c_custkey % 50, c_custkey % 70) / 1e2, 4), round(greatest(c_custkey % 50, c_custkey % 70) / 1e2, 4), CASE t WHEN 0 THEN 'S' ELSE 'B' END FROM customer, range(2) AS g(t) WHERE c_custkey % 6 > 0""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries and stretches read by table functions, laterally: two lines, one beside a broken one, one in odd spelling, and none."""
    sql.register(spark)
    k = F.col("c_custkey")
    line = lambda f: F.format_string("LINESTRING(%s %s, %s %s, %s %s)", *[x for i in range(3) for x in ((k % 90 + f + i / 8.0).cast("string"), F.lit(str(50 + i / 4.0)))])
    kind = k % 5
    odd = F.regexp_replace(F.regexp_replace(line(0), "LINESTRING", "  linestring  "), ", ", " ,   ")
    wkt = F.when(kind == 0, F.concat_ws("|", line(0), line(1))).when(kind == 1, F.concat_ws("|", F.lit("LINESTRING(1 x, 2 3)"), line(0), F.lit("POINT(1 2)"))).when(kind == 2, odd).when(kind == 3, "-")
    token = lambda side: F.format_string("seg%d:%.4f-%.4f:%s", k % 4, (k % 50) / 100.0, (k % 70) / 100.0, F.lit(side))
    rows = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("k"), wkt.alias("wkt"), F.when(k % 6 > 0, F.concat_ws("|", token("S"), F.lit("nonsense"), token("X"))).alias("done"))
    return spark.sql(
        """SELECT k, 'vertex' AS what, frag, idx AS place, round(lon, 4) AS a, round(lat, 4) AS b, '' AS side FROM {rows}, LATERAL wkt_vertices(wkt)
        UNION ALL SELECT k, 'stretch', frag, place, round(a, 4), round(b, 4), side FROM {rows}, LATERAL stretches(done)""", rows=rows,
    )
