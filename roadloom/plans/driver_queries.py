"""The operators applied to the driver's tables, each with its SQL where SQL can say it.

The tables hold no roads, so roads are made from keys: a customer is a road of three vertices on a grid, its
nation is its ward; suppliers are points of interest. Literals in the SQL are doubles (``1e0``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import geo, intervals, parse, text
from roadloom.operators import clusters, network, payload, poi, publishing, roads, spatial, splits
from roadloom.streaming import progress

LAT0 = 52.8
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def key_point(k: Column) -> tuple[Column, Column]:
    """A place for a key, spread over half a degree."""
    lon = F.lit(-2.5) + (k % 997).cast("double") / F.lit(997.0) * F.lit(0.5)
    lat = F.lit(52.6) + ((k * 7919) % 991).cast("double") / F.lit(991.0) * F.lit(0.4)
    return lon, lat


def key_point_sql(k: str) -> tuple[str, str]:
    return f"(-25e-1 + ({k} % 997)::DOUBLE / 997e0 * 5e-1)", f"(526e-1 + (({k} * 7919) % 991)::DOUBLE / 991e0 * 4e-1)"


def metres_sql(a_lon: str, a_lat: str, b_lon: str, b_lat: str, lat0: str, y: str = "111320e0") -> str:
    dx, dy = f"(({a_lon} - {b_lon}) * (111320e0 * cos(radians({lat0}))))", f"(({a_lat} - {b_lat}) * {y})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


C_LON, C_LAT = key_point_sql("c_custkey")
S_LON, S_LAT = key_point_sql("s_suppkey")
#: Roads on a grid: 40 in a row, each ends where the next one begins.
ROADS_SQL = """road AS (
  SELECT c_custkey AS k, c_name AS road, c_nationkey AS ward, (c_custkey % 60)::INTEGER AS residences,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Complete' WHEN 'AUTOMOBILE' THEN 'In_Progress' ELSE 'Not_Started' END AS status,
         -25e-1 + (c_custkey % 40)::DOUBLE * 2e-3 AS lon0, 526e-1 + ((c_custkey // 40) % 400)::DOUBLE * 1e-3 AS lat0 FROM customer),
vertex AS (SELECT k, road, ward, residences, status, i AS idx, lon0 + i::DOUBLE * 1e-3 AS lon, lat0 + CASE WHEN i = 1 THEN 2e-4 ELSE 0e0 END AS lat FROM road, (VALUES (0), (1), (2)) AS v(i))"""


def grid_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "Complete").when(F.col("c_mktsegment") == "AUTOMOBILE", "In_Progress").otherwise("Not_Started")
    k = F.col("c_custkey")
    return c.select(
        k.alias("k"), F.col("c_name").alias("road"), F.col("c_nationkey").alias("ward"), (k % 60).cast("int").alias("residences"), status.alias("status"),
        (F.lit(-2.5) + (k % 40).cast("double") * 0.002).alias("lon0"), (F.lit(52.6) + (F.floor(k / 40) % 400).cast("double") * 0.001).alias("lat0"),
    )


def grid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = grid_roads(spark, sf_dir).withColumn("idx", F.explode(F.array(*map(F.lit, range(3)))))
    i = F.col("idx").cast("double")
    return spread.select("k", "road", "ward", "residences", "status", "idx", (F.col("lon0") + i * 0.001).alias("lon"), (F.col("lat0") + F.when(F.col("idx") == 1, 0.0002).otherwise(0.0)).alias("lat"))


@query("""SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm_key,
  regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  p_size::INTEGER AS size_read, replace(replace(replace(replace(p_name || ' <&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM part""")
def typed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    read = text.leading_int(F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(",500")))
    return p.select("p_partkey", text.norm_key(F.col("p_name")).alias("norm_key"), text.slug(F.concat("p_brand", F.lit(" / "), "p_type")).alias("slug"), read.alias("size_read"), text.escaped(F.concat("p_name", F.lit(' <&"'))).alias("html"))


WARD_SQL = f"""WITH {ROADS_SQL}, w AS (SELECT *, CASE WHEN status <> 'Complete' THEN greatest(residences, 1)::DOUBLE END AS weight FROM vertex)
SELECT ward, round(sum(lon * weight) / sum(weight), 6) AS lon, round(sum(lat * weight) / sum(weight), 6) AS lat,
  round(min(lon) - 2e-2, 6) AS min_lon, round(min(lat) - 2e-2, 6) AS min_lat, round(max(lon) + 2e-2, 6) AS max_lon, round(max(lat) + 2e-2, 6) AS max_lat FROM w GROUP BY ward"""


@query(WARD_SQL)
def ward_centroid_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = roads.ward_summary(grid_vertices(spark, sf_dir), ("ward",))
    return out.select("ward", *[F.round(c, 6).alias(c) for c in ("lon", "lat", "min_lon", "min_lat", "max_lon", "max_lat")])


@query(f"""WITH c AS (SELECT c_nationkey AS ward, round(avg({C_LON}), 6) AS lon, round(avg({C_LAT}), 6) AS lat FROM customer GROUP BY 1),
d AS (SELECT ward, s_suppkey AS poi, {metres_sql('lon', 'lat', S_LON, S_LAT, 'lat')} AS dist_m FROM c JOIN supplier ON s_nationkey = ward),
r AS (SELECT *, row_number() OVER (PARTITION BY ward ORDER BY dist_m, poi) AS rank FROM d)
SELECT ward, poi, round(dist_m, 3) AS dist_m, rank FROM r WHERE rank <= 5""")
def poi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("c_custkey"))
    centres = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").groupBy(F.col("c_nationkey").alias("ward")).agg(F.round(F.avg(lon), 6).alias("lon"), F.round(F.avg(lat), 6).alias("lat"))
    p_lon, p_lat = key_point(F.col("s_suppkey"))
    pois = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").alias("ward"), F.col("s_suppkey").alias("poi"), p_lon.alias("p_lon"), p_lat.alias("p_lat"))
    return poi.shortlist(centres, pois, 5, ("ward",))


@query("""WITH o AS (SELECT o_custkey, count(*)::DOUBLE AS homes, sum(o_totalprice) / 1e3 AS len FROM orders GROUP BY 1), d AS (SELECT *, homes / greatest(len / 1e3, 2e-2) AS dens FROM o)
SELECT o_custkey, round(CASE WHEN dens >= 60 THEN 1e0 WHEN dens <= 15 THEN 625e-2 ELSE exp(ln(625e-2) * (ln(6e1) - ln(dens)) / (ln(6e1) - ln(15e0))) END, 6) AS effort_weight FROM d""")
def effort_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").cast("double").alias("homes"), (F.sum("o_totalprice") / 1000.0).alias("len"))
    return o.select("o_custkey", F.round(geo.effort_weight(F.col("homes"), F.col("len")), 6).alias("effort_weight"))


#: Ranges of each user, one for each event.
RANGES_SQL = "rng AS (SELECT user_id, (event_id % 1000)::DOUBLE / 1e3 AS a, (event_id % 1000)::DOUBLE / 1e3 + (event_id % 7)::DOUBLE / 1e3 AS b FROM events)"


def event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    a = (F.col("event_id") % 1000).cast("double") / 1000.0
    return e.select("user_id", a.alias("a"), (a + (F.col("event_id") % 7).cast("double") / 1000.0).alias("b"))


MERGED_SQL = f"""{RANGES_SQL}, o AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rng),
f AS (SELECT *, CASE WHEN reach IS NULL OR a > reach + 1e-9 THEN 1 ELSE 0 END AS new FROM o),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b, new DESC ROWS UNBOUNDED PRECEDING) AS i FROM f),
m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM n GROUP BY user_id, i)"""


@query(f"WITH {MERGED_SQL} SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.merged_intervals(event_ranges(spark, sf_dir), ("user_id",)).select("user_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.merged_intervals(event_ranges(spark, sf_dir), ("user_id",))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(f"""WITH {MERGED_SQL}, g AS (SELECT user_id, coalesce(lag(b) OVER w, 0e0) AS a, a AS b FROM m WINDOW w AS (PARTITION BY user_id ORDER BY a)
  UNION ALL SELECT user_id, max(b), 1e0 FROM m GROUP BY user_id)
SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM g WHERE b - a > 1e-9""")
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roads.gaps(_merged(spark, sf_dir), ("user_id",)))


@query(f"""WITH {MERGED_SQL}, e AS (SELECT user_id, a, b, row_number() OVER (PARTITION BY user_id ORDER BY a) AS n FROM m), x AS (SELECT * FROM e WHERE n % 2 = 0),
p AS (SELECT m.user_id, greatest(m.a, f.a) AS a, least(m.b, f.b) AS b FROM m, (VALUES (1e-1, 45e-2), (5e-1, 51e-2), (6e-1, 95e-2)) AS f(a, b))
SELECT user_id, round(a, 6) AS a, round(b, 6) AS b FROM p WHERE b > a""")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roads.overlaps(_merged(spark, sf_dir), ("user_id",), ((0.1, 0.45), (0.5, 0.51), (0.6, 0.95))))


@query(f"""WITH {MERGED_SQL}, g AS (SELECT *, sum(CASE WHEN pb IS NULL OR NOT (a - pb < 1e1 / 333e0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a) AS pb FROM m)), j AS (SELECT user_id, min(a) AS a, max(b) AS b FROM g GROUP BY user_id, i)
SELECT user_id, round(CASE WHEN a < 1e1 / 333e0 THEN 0e0 ELSE a END, 6) AS a, round(CASE WHEN 1e0 - b < 1e1 / 333e0 THEN 1e0 ELSE b END, 6) AS b FROM j""")
def close_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(roads.small_gaps_closed(_merged(spark, sf_dir), ("user_id",), intervals.LEAST_METRES / 333.0))


@query("""WITH p AS (SELECT l_suppkey AS road, (l_orderkey * 131 % 2000003)::DOUBLE AS pos, 2e6 AS len FROM lineitem),
o AS (SELECT *, CASE WHEN coalesce(pos - lag(pos) OVER (PARTITION BY road ORDER BY pos), 251e0) > 25e1 THEN 1 ELSE 0 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY road ORDER BY pos, n DESC ROWS UNBOUNDED PRECEDING) AS island FROM o),
s AS (SELECT road, island::BIGINT AS island, greatest(min(pos) - 3e1, 0e0) AS from_m, least(max(pos) + 3e1, max(len)) AS to_m, count(*) AS homes FROM i GROUP BY road, island)
SELECT * FROM s WHERE to_m - from_m > 1""")
def home_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey")
    return roads.islands(p.select(F.col("l_suppkey").alias("road"), (F.col("l_orderkey") * 131 % 2000003).cast("double").alias("pos"), F.lit(2000000.0).alias("len")), ("road",), "len")


O_LON, O_LAT = key_point_sql("o_orderkey")


@query(f"""WITH v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS idx, {O_LON} AS lon, {O_LAT} AS lat FROM orders),
d AS (SELECT o_custkey, idx, coalesce({metres_sql('lon', 'lat', 'plon', 'plat', '528e-1')}, 0e0) AS step FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY idx)))
SELECT o_custkey, idx::BIGINT AS idx, round(sum(step) OVER (PARTITION BY o_custkey ORDER BY idx ROWS UNBOUNDED PRECEDING), 3) AS cum_m FROM d""")
def cum_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("o_orderkey"))
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    v = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select("o_custkey", idx.alias("idx"), lon.alias("lon"), lat.alias("lat"))
    step = geo.metres(F.col("lon"), F.col("lat"), F.col("prev_lon"), F.col("prev_lat"), F.lit(LAT0))
    return roads.running_length(v, ("o_custkey",), step).select("o_custkey", "idx", F.round("cum_m", 3).alias("cum_m"))


@query(f"""WITH e AS (SELECT c_custkey AS "end", {C_LON} AS lon, {C_LAT} AS lat FROM customer), v AS (SELECT s_suppkey AS other, {S_LON} AS lon, {S_LAT} AS lat FROM supplier),
d AS (SELECT "end", other, {metres_sql('e.lon', 'e.lat', 'v.lon', 'v.lat', '528e-1')} AS dist FROM e, v WHERE abs(e.lat - v.lat) < 1e-2 AND "end" <> other),
r AS (SELECT *, row_number() OVER (PARTITION BY "end" ORDER BY dist, other) AS n FROM d WHERE dist <= 6e2)
SELECT "end" AS point, other, round(dist, 3) AS dist_m FROM r WHERE n = 1""")
def nearest_vertex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("c_custkey"))
    ends = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("end"), F.col("c_custkey").alias("road"), lon.alias("lon"), lat.alias("lat"))
    lon, lat = key_point(F.col("s_suppkey"))
    vertices = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("road"), lon.alias("lon"), lat.alias("lat"))
    return spatial.nearest_vertices(ends, vertices, LAT0, 600.0, 0.01).select(F.col("end").alias("point"), "other", F.round("dist", 3).alias("dist_m"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("s_suppkey"))
    s = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("seg"), lon.alias("a_lon"), lat.alias("a_lat"))
    return s.select("*", (F.col("a_lon") + 0.004).alias("b_lon"), (F.col("a_lat") + 0.002).alias("b_lat"))


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("c_custkey"))
    return table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("pt"), lon.alias("lon"), lat.alias("lat"))


@query(f"""WITH p AS (SELECT c_custkey AS pt, {C_LON} AS lon, {C_LAT} AS lat FROM customer), s AS (SELECT s_suppkey AS seg, {S_LON} AS a_lon, {S_LAT} AS a_lat FROM supplier),
m AS (SELECT pt, seg, (4e-3) * kx AS bx, (2e-3) * 110540e0 AS dy, (lon - a_lon) * kx AS px, (lat - a_lat) * 110540e0 AS py FROM p, s, (SELECT 111320e0 * cos(radians(528e-1)) AS kx) WHERE abs(lat - a_lat) < 1e-2 AND abs(lon - a_lon) < 1e-2),
t AS (SELECT *, least(greatest((px * bx + py * dy) / (bx * bx + dy * dy), 0e0), 1e0) AS t FROM m), d AS (SELECT pt, seg, t, sqrt((px - bx * t) * (px - bx * t) + (py - dy * t) * (py - dy * t)) AS dist FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY round(dist, 6), seg) AS n FROM d WHERE dist <= 25e1)
SELECT pt, seg, round(t, 4) AS t, round(dist, 3) AS dist_m, dist > 4e1 AS far FROM r WHERE n = 1""")
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.match_homes(_homes(spark, sf_dir), _segments(spark, sf_dir), LAT0).select("pt", "seg", F.round("t", 4).alias("t"), F.round("dist", 3).alias("dist_m"), "far")


@query("""WITH p AS (SELECT l_orderkey AS pt, (l_partkey % 40)::DOUBLE / 1e3 AS lon, (l_suppkey % 10)::DOUBLE / 1e3 AS lat FROM lineitem)
SELECT pt, lon, lat FROM p QUALIFY count(*) OVER (PARTITION BY round(lon * 1e5)::BIGINT, round(lat * 1e5)::BIGINT) < 150""")
def commercial_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return spatial.without_commercial_spots(p.select(F.col("l_orderkey").alias("pt"), ((F.col("l_partkey") % 40).cast("double") / 1000.0).alias("lon"), ((F.col("l_suppkey") % 10).cast("double") / 1000.0).alias("lat")))


@query("""SELECT lang, count(*) AS docs, count(l.doc_id) AS matched, coalesce(sum(quality), 0)::BIGINT AS good FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang""")
def left_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents", "doc_id", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return d.join(labels.withColumn("hit", F.lit(1)), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count("hit").alias("matched"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


def _ward_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Roads of a ward follow each other by key, but for some gaps."""
    r = grid_roads(spark, sf_dir).select("k", "ward", "residences")
    order = Window.partitionBy("ward").orderBy("k")
    pairs = r.withColumn("after", F.lead("k").over(order)).filter("after is not null and (k + after) % 4 <> 0").select(F.col("k").alias("src"), F.col("after").alias("dst"))
    return r, pairs.union(pairs.select("dst", "src"))


EDGES_SQL = "pair AS (SELECT k AS src, after AS dst FROM (SELECT c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS after FROM customer) WHERE after IS NOT NULL AND (k + after) % 4 <> 0)"


@query(f"""WITH {EDGES_SQL}, n AS (SELECT c_custkey AS k, c_nationkey AS ward, CASE WHEN c_custkey IN (SELECT dst FROM pair) THEN 0 ELSE 1 END AS new FROM customer),
g AS (SELECT k, ward, sum(new) OVER (PARTITION BY ward ORDER BY k ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT k AS node, min(k) OVER (PARTITION BY ward, i) AS component FROM g""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, edges = _ward_edges(spark, sf_dir)
    return network.connected(r.select(F.col("k").alias("node")), edges)


@query(f"""WITH {EDGES_SQL}, n AS (SELECT c_custkey AS k, c_nationkey AS ward, (c_custkey % 60)::DOUBLE + 1e0 AS len, CASE WHEN c_custkey IN (SELECT dst FROM pair) THEN 0 ELSE 1 END AS new FROM customer),
g AS (SELECT *, sum(new) OVER (PARTITION BY ward ORDER BY k ROWS UNBOUNDED PRECEDING) AS i FROM n),
s AS (SELECT *, sum(len) OVER (PARTITION BY ward, i ORDER BY k ROWS UNBOUNDED PRECEDING) - first_value(len) OVER (PARTITION BY ward, i ORDER BY k) AS cum FROM g)
SELECT k AS road, cum AS dist_m FROM s""")
def network_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, edges = _ward_edges(spark, sf_dir)
    lengths = r.select(F.col("k").alias("road"), ((F.col("k") % 60).cast("double") + 1.0).alias("length_m"))
    first = network.connected(r.select(F.col("k").alias("node")), edges).filter("node = component")
    return network.network_distances(lengths, edges, first.select(F.col("node").alias("road"), F.lit(0.0).alias("dist_m")))


@query("""WITH o AS (SELECT o_custkey, sum(o_totalprice) / 1e3 AS d FROM orders GROUP BY 1), s AS (SELECT min(d) AS lo, max(d) AS hi FROM o)
SELECT o_custkey, CASE WHEN d <= 700 THEN 'walk' WHEN d <= 1100 THEN 'hybrid' ELSE 'drive' END AS kind,
  CASE WHEN (d - lo) / (hi - lo) < 1e-1 THEN 1 WHEN (d - lo) / (hi - lo) < 37e-2 THEN 2 WHEN (d - lo) / (hi - lo) < 63e-2 THEN 3 WHEN (d - lo) / (hi - lo) < 9e-1 THEN 4 ELSE 5 END AS band FROM o, s""")
def classify_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg((F.sum("o_totalprice") / 1000.0).alias("d"))
    span = o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return o.join(F.broadcast(span)).select("o_custkey", geo.route_kind(F.col("d")).alias("kind"), geo.difficulty(F.col("d"), F.col("lo"), F.col("hi")).alias("band"))


@query("""WITH t AS (SELECT p_size AS route, p_brand AS street, sum(p_partkey % 9)::BIGINT AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY n DESC, street) AS k FROM t WHERE n > 0)
SELECT route, string_agg(street, ' & ' ORDER BY k) AS name FROM r WHERE k <= 2 GROUP BY route""")
def route_name_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    street = F.concat("p_brand", F.lit(" (part "), (F.col("p_partkey") % 3).cast("string"), F.lit(")"))
    return roads.route_names(p.select(F.col("p_size").alias("route"), street.alias("street"), (F.col("p_partkey") % 9).alias("residences")))


@query("""WITH p AS (SELECT user_id, event_id AS part, (event_id % 1000)::DOUBLE / 1e3 AS a, (event_id % 1000)::DOUBLE / 1e3 + 1e-4 AS b FROM events)
SELECT user_id, part, round(coalesce((lag(b) OVER w + a) / 2e0, 0e0), 6) AS from_f, round(coalesce((b + lead(a) OVER w) / 2e0, 1e0), 6) AS to_f FROM p WINDOW w AS (PARTITION BY user_id ORDER BY a, b, part)""")
def midpoint_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_id")
    a = (F.col("event_id") % 1000).cast("double") / 1000.0
    out = roads.midpoint_stretches(e.select("user_id", F.col("event_id").alias("part"), a.alias("a"), (a + 0.0001).alias("b")), ("user_id",))
    return out.select("user_id", "part", F.round("from_f", 6).alias("from_f"), F.round("to_f", 6).alias("to_f"))


@query(f"""WITH p AS (SELECT s_name AS name, {S_LAT} AS lat, {S_LON} AS lon, s_suppkey % 3 = 0 AS fresh FROM supplier),
k AS (SELECT name, lat, lon FROM p WHERE NOT fresh AND NOT (lat BETWEEN 527e-1 AND 529e-1 AND lon BETWEEN -24e-1 AND -21e-1) UNION SELECT name, lat, lon FROM p WHERE fresh)
SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM k""")
def poi_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = key_point(F.col("s_suppkey"))
    p = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_name").alias("name"), lat.alias("lat"), lon.alias("lon"), (F.col("s_suppkey") % 3 == 0).alias("fresh"))
    cols = ("name", "lat", "lon")
    out = poi.upsert(p.filter("not fresh").select(*cols), p.filter("fresh").select(*cols), (52.7, -2.4, 52.9, -2.1))
    return out.select("name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
def retention_14d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return publishing.retained(e, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), "ts").select("event_id", "user_id")


@query("SELECT props, event_id FROM events QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts, event_id) = 1")
def dedupe_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.first_publishes(table(spark, sf_dir, "events", "props", "event_id", "ts"), "props", ("ts", "event_id")).select("props", "event_id")


@query("""SELECT p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS fnv FROM part""")
def fnv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", text.fingerprint(F.col("p_name")).alias("fnv"))


@query(f"""WITH {ROADS_SQL} SELECT k, frag, idx, round(lon + frag * 1e-1, 6) AS lon, round(lat, 6) AS lat FROM vertex, (VALUES (0), (1)) AS f(frag) WHERE idx <> 1""")
def parse_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid_roads(spark, sf_dir)
    shown = lambda dx: F.format_string("LINESTRING(%.6f %.6f,  %.6f   %.6f)", F.col("lon0") + dx, F.col("lat0"), F.col("lon0") + dx + 0.002, F.col("lat0"))
    wkt = F.concat(shown(F.lit(0.0)), F.lit("|"), shown(F.lit(0.1)), F.lit("|POINT(1 2)"))
    out = r.select("k", F.posexplode(parse.linestrings(wkt)).alias("frag", "points")).select("k", "frag", F.posexplode("points").alias("i", "p"))
    return out.select("k", "frag", (F.col("i") * 2).alias("idx"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("""SELECT c_custkey AS k, (c_custkey % 4)::INTEGER AS frag, round(least(x, y), 4) AS a, round(greatest(x, y), 4) AS b, CASE c_custkey % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'F' ELSE 'B' END AS side
FROM (SELECT c_custkey, (c_custkey % 50)::DOUBLE / 1e2 AS x, (c_custkey % 70)::DOUBLE / 1e2 AS y FROM customer) WHERE c_custkey % 5 <> 0""")
def parse_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    side = F.element_at(F.array(*map(F.lit, "SFX")), (k % 3 + 1).cast("int"))
    token = F.format_string("seg%d:%.4f-%.4f:%s", k % 4, (k % 50).cast("double") / 100.0, (k % 70).cast("double") / 100.0, side)
    notation = F.when(k % 5 == 0, "-").otherwise(F.concat(token, F.lit("|nonsense")))
    out = c.select(k.alias("k"), F.explode(parse.partial_ranges(notation)).alias("r"))
    return out.select("k", "r.frag", F.round("r.a", 4).alias("a"), F.round("r.b", 4).alias("b"), "r.side")


@query(f"""SELECT c_custkey AS k, round({C_LAT}, 5) AS lat, round({C_LON}, 5) AS lon FROM customer""")
def coord_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    lon, lat = key_point(k)
    pasted = F.when(k % 3 == 0, F.format_string("lon: %.5f, lat=%.5f", -lon, lat)).when(k % 3 == 1, F.format_string("(%.5f, %.5f)", -lat, lon)).otherwise(F.format_string("%.5f %.5f", lat, lon))
    read = c.select(k.alias("k"), parse.coordinate_paste(pasted).alias("p"))
    fixed = parse.sign_fixed(F.col("p.lat"), F.col("p.lon"), (52.5, -2.6, 53.1, -1.9))
    return read.select("k", F.round(fixed["lat"], 5).alias("lat"), F.round(fixed["lon"], 5).alias("lon"))


@query("""SELECT n_nationkey AS node, half, lead_half AS following FROM (SELECT *, coalesce(lead(half) OVER w, first_value(half) OVER (PARTITION BY n_nationkey ORDER BY bearing, half)) AS lead_half
FROM (SELECT s_nationkey AS n_nationkey, s_suppkey AS half, (s_suppkey * 37 % 360)::DOUBLE AS bearing FROM supplier) WINDOW w AS (PARTITION BY n_nationkey ORDER BY bearing, half))""")
def rotation_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    halves = s.select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("half"), (F.col("s_suppkey") * 37 % 360).cast("double").alias("bearing"))
    return spatial.next_in_rotation(halves).select("node", "half", "following")


@query("""WITH o AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def sample_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.runs(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), ("user_id",), "event_id", ("event_type",)).withColumn("run", F.col("run").cast("long"))


@query(f"""WITH {ROADS_SQL}, s AS (SELECT *, 1e2 + (k % 50)::DOUBLE AS total, (k % 40)::DOUBLE AS done, (k % 20)::DOUBLE AS half FROM road),
l AS (SELECT ward, k, residences * CASE status WHEN 'Complete' THEN 0e0 WHEN 'In_Progress' THEN (total - done - half / 2e0) / total ELSE 1e0 END AS leftover, status FROM s)
SELECT ward, count(*) AS roads, round(sum(leftover), 4) AS residences_left, count(*) FILTER (WHERE status <> 'Complete' AND leftover > 0) AS eligible FROM l GROUP BY ward""")
def road_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid_roads(spark, sf_dir)
    share = roads.remaining_share(F.col("status"), 100.0 + (F.col("k") % 50).cast("double"), (F.col("k") % 40).cast("double"), (F.col("k") % 20).cast("double"))
    left = r.withColumn("leftover", F.col("residences") * share)
    return left.groupBy("ward").agg(F.count("*").alias("roads"), F.round(F.sum("leftover"), 4).alias("residences_left"), F.count_if(roads.eligible(F.col("status"), F.col("leftover"))).alias("eligible"))


@query("""WITH p AS (SELECT p_partkey, p_partkey AS n FROM part)
SELECT p_partkey, CASE WHEN n < 26 THEN chr((65 + n)::INTEGER) WHEN n < 702 THEN chr((64 + n // 26)::INTEGER) || chr((65 + n % 26)::INTEGER)
  WHEN n >= 18278 THEN chr((65 + (n - 18278) // 17576)::INTEGER) || chr((65 + ((n - 18278) // 676) % 26)::INTEGER) || chr((65 + ((n - 18278) // 26) % 26)::INTEGER) || chr((65 + n % 26)::INTEGER)
  ELSE chr((65 + (n - 702) // 676)::INTEGER) || chr((65 + ((n - 702) // 26) % 26)::INTEGER) || chr((65 + n % 26)::INTEGER) END AS route_id FROM p""")
def route_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", text.letters_id(F.col("p_partkey")).alias("route_id"))


@query(f"""WITH b AS (SELECT c_custkey AS k, ({metres_sql('0e0', '0e0', '1e-3', '1e-3', '528e-1')}) AS unused, degrees(atan2((((c_custkey * 13) % 200)::DOUBLE - 1e2) * (111320e0 * cos(radians(528e-1))), ((((c_custkey * 29) % 190)::DOUBLE - 95e0) * 110540e0))) + 36e1 AS d FROM customer),
m AS (SELECT k, d - floor(d / 36e1) * 36e1 AS d FROM b)
SELECT k, round(d, 4) AS bearing, list_extract(['N','NE','E','SE','S','SW','W','NW'], (floor(d / 45e0 + 5e-1)::BIGINT % 8 + 1)) AS compass FROM m""")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    d = geo.bearing(F.lit(0.0), F.lit(0.0), ((k * 13) % 200).cast("double") - 100.0, ((k * 29) % 190).cast("double") - 95.0, F.lit(LAT0))
    return c.select(k.alias("k"), d.alias("d")).select("k", F.round("d", 4).alias("bearing"), geo.compass(F.col("d")).alias("compass"))


@query("""SELECT 'summary' AS what, count(DISTINCT o_custkey) AS routes, count(*) AS roads, count(*) FILTER (WHERE o_orderstatus = 'F') AS walk, count(*) FILTER (WHERE o_orderstatus = 'P') AS hybrid, count(*) FILTER (WHERE o_orderstatus = 'O') AS drive, round(sum(o_totalprice), 2) AS residences FROM orders""")
def summary_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roads of their customers' routes, whose kind is their status."""
    kind = F.when(F.col("o_orderstatus") == "F", "walk").when(F.col("o_orderstatus") == "O", "drive").otherwise("hybrid")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice").select(F.col("o_custkey").alias("route"), kind.alias("kind"), F.col("o_totalprice").alias("residences"))
    return payload.summary_tiles(o).select(F.lit("summary").alias("what"), "routes", "roads", "walk", "hybrid", "drive", F.round("residences", 2).alias("residences"))


def _cluster_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid_roads(spark, sf_dir)
    order = Window.partitionBy("ward").orderBy("k")
    names = F.filter(F.array(F.lag("road").over(order), F.lead("road").over(order)), lambda x: x.isNotNull())
    start = F.min("k").over(Window.partitionBy("ward"))
    left = F.when(F.col("status") != "Complete", F.col("residences")).otherwise(0).cast("double")
    return r.select(F.col("ward").cast("string").alias("ward"), F.col("k").alias("ord"), "road", left.alias("residences"), left.alias("size"), ((F.col("k") - start) * 5).cast("double").alias("dist_m"), F.col("lon0").alias("lon"), F.col("lat0").alias("lat"), names.alias("neighbours"))


MEMBERS_SQL = f"member AS (SELECT c_nationkey * 10 + c_custkey // 30 % 7 AS cluster, c_custkey AS road, (c_custkey % 60)::INTEGER AS residences FROM customer), link AS (SELECT src, dst FROM pair UNION SELECT dst, src FROM pair), {EDGES_SQL}"


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, edges = _ward_edges(spark, sf_dir)
    return r.select((F.col("ward") * 10 + F.floor(F.col("k") / 30) % 7).alias("cluster"), F.col("k").alias("road"), F.col("k").alias("seq"), "residences"), edges


@query(f"""WITH {EDGES_SQL}, {MEMBERS_SQL.split(', pair AS')[0]}, e AS (SELECT a.cluster, count(*) AS n FROM pair JOIN member a ON src = a.road JOIN member b ON dst = b.road AND a.cluster = b.cluster GROUP BY 1)
SELECT m.cluster, count(*) AS roads, coalesce(max(n), 0) AS edges, CASE WHEN coalesce(max(n), 0) >= count(*) THEN 'loop' ELSE 'out-and-back' END AS shape FROM member m LEFT JOIN e ON m.cluster = e.cluster GROUP BY 1""")
def cluster_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.cluster_shapes(*_members(spark, sf_dir))


@query(f"""WITH {EDGES_SQL}, {MEMBERS_SQL.split(', pair AS')[0]}, d AS (SELECT a.cluster, a.road, count(*) AS n FROM link JOIN member a ON src = a.road JOIN member b ON dst = b.road AND a.cluster = b.cluster GROUP BY 1, 2)
SELECT m.cluster, m.road AS parking FROM member m LEFT JOIN d ON m.cluster = d.cluster AND m.road = d.road QUALIFY row_number() OVER (PARTITION BY m.cluster ORDER BY coalesce(n, 0) DESC, residences DESC, m.road) = 1""")
def parking_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.parking_roads(*_members(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's road as a straight line east of 100 metres and more, positions in metres."""
    c = table(spark, sf_dir, "customer", "c_custkey").withColumn("idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    pos = F.col("idx") * (F.lit(50.0) + (F.col("c_custkey") % 100).cast("double"))
    return c.select(F.col("c_custkey").alias("road"), F.lit(0).alias("frag"), "idx", (F.lit(-2.0) + pos / 1000.0).alias("lon"), F.lit(52.0).alias("lat"), pos.alias("pos"))


@query("""WITH r AS (SELECT c_custkey AS road, 2e0 * (5e1 + (c_custkey % 100)::DOUBLE) AS len, (c_custkey % 37)::DOUBLE AS a FROM customer),
f AS (SELECT road, 0e0 AS a, a AS b FROM r WHERE a >= 5 UNION ALL SELECT road, a + 4e1, len FROM r WHERE len - a - 4e1 >= 5)
SELECT road, round(a, 3) AS a, round(b, 3) AS b, round(-2e0 + a / 1e3, 6) AS lon_a, round(-2e0 + b / 1e3, 6) AS lon_b FROM f""")
def remaining_subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("c_custkey") % 37).cast("double")
    done = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("road"), F.lit(0).alias("frag"), a.alias("a"), (a + 40.0).alias("b"))
    out = splits.remaining_paths(_lines(spark, sf_dir), done)
    return out.groupBy("road", "part").agg(F.round(F.first("a"), 3).alias("a"), F.round(F.first("b"), 3).alias("b"), F.round(F.min("lon"), 6).alias("lon_a"), F.round(F.max("lon"), 6).alias("lon_b")).drop("part")


@query("""WITH r AS (SELECT c_custkey AS road, 2e0 * (5e1 + (c_custkey % 100)::DOUBLE) AS len, ceil((c_custkey % 60)::DOUBLE / 15e0)::INTEGER AS k FROM customer WHERE c_custkey % 60 > 15)
SELECT road, part::INTEGER AS part, round(part * len / k, 3) AS a, round((part + 1) * len / k, 3) AS b FROM r, range(4) AS p(part) WHERE part < k""")
def effort_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    needed = grid_roads(spark, sf_dir).select(F.col("k").alias("road"), splits.parts_needed(F.col("residences").cast("double"), 15.0).alias("k")).filter("k >= 2")
    out = splits.split_evenly(_lines(spark, sf_dir), needed, 52.0)
    # which end of a straight road the chain begins at is a tie of the two ends' distances: count from the west
    back = out.join(needed, "road").join(splits.lengths(_lines(spark, sf_dir)), ["road", "frag"])
    place = F.floor(F.col("a") * F.col("k") / F.col("length_m") + 0.5).cast("int")
    return back.select("road", place.alias("part"), F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


@query("""WITH p AS (SELECT p_partkey, p_size AS n, ((p_size - 8) * 618033988749895e-15) % 1 AS h, 48e-2 * 165e-2 AS q FROM part), t AS (SELECT *, 2 * 48e-2 - q AS p, [(h + 1 / 3e0) % 1, h, (h + 2 / 3e0) % 1] AS ts FROM p),
c AS (SELECT p_partkey, n, list_transform(ts, lambda x: lpad(lower(to_hex(floor(255 * CASE WHEN x < 1 / 6e0 THEN p + (q - p) * 6 * x WHEN x < 5e-1 THEN q WHEN x < 2 / 3e0 THEN p + (q - p) * (2 / 3e0 - x) * 6 ELSE p END + 5e-1)::BIGINT)), 2, '0')) AS c FROM t)
SELECT p_partkey, CASE WHEN n < 8 THEN list_extract(['#2a78d6', '#eb6834', '#1baf7a', '#eda100', '#e87ba4', '#008300', '#4a3aa7', '#e34948'], n + 1) ELSE '#' || c[1] || c[2] || c[3] END AS colour FROM c""")
def route_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as routes at the place of their size, beyond the eight fixed colours too."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", payload.route_colour(F.col("p_size")).alias("colour"))


@query()
def export_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clusters.cluster_roads(_cluster_input(spark, sf_dir))
    routes = members.groupBy("ward", F.col("cluster").cast("string").alias("route")).agg(F.first("kind").alias("kind"), F.sum("residences").alias("residences")).withColumn("name", F.concat(F.lit("Route "), "route"))
    roads_of = members.join(grid_roads(spark, sf_dir).select("road", "status", F.array(geo.point(F.col("lon0"), F.col("lat0")), geo.point(F.col("lon0") + 0.002, F.col("lat0"))).alias("points")), "road")
    return payload.exported(routes, roads_of.select("ward", F.col("cluster").cast("string").alias("route"), "seq", F.col("road").alias("street"), "status", "residences", "points"))


@query()
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_roads(_cluster_input(spark, sf_dir))


@query()
def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.find_settlements(_cluster_input(spark, sf_dir))


@query()
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    minutes = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)).cast("double")
    fixes = e.select(F.col("user_id").alias("walker"), F.col("ts").cast("timestamp").alias("ts"), (minutes * 0.4 + (F.col("event_id") % 90)).alias("pos"), (F.col("event_id") % 37).cast("double").alias("off_m"), F.lit(15.0).alias("accuracy"))
    return progress.progress_batch(fixes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ward's centroid and box with its nearest points of interest."""
    return ward_centroid_bbox(spark, sf_dir).join(poi_topk(spark, sf_dir), "ward")
