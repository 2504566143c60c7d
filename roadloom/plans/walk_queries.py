"""Queries of homes, tracks, marks and routes over the driver's tables, each with its SQL.

A customer is a road of two segments, or a straight one where its row is read from text; an order is a home on its
customer's road; a supplier is a step of its nation's track; an event is a position fix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions import geo, intervals, parse, text
from roadloom.operators import homes, marks, payload, poi, roads, routes, tracks, walks
from roadloom.operators.network import Rounds
from roadloom.plans.driver_queries import LAT0, RANGES_SQL, ROADS_SQL, S_LAT, S_LON, event_ranges, grid_roads, grid_vertices, key_point, query, table
from roadloom.streaming import progress, ranges

KX = "(111320e0 * cos(radians(528e-1)))"
STEP_SQL = f"sqrt((b_lon - a_lon) * {KX} * ((b_lon - a_lon) * {KX}) + (b_lat - a_lat) * 110540e0 * ((b_lat - a_lat) * 110540e0))"


def near_sql(rows: str) -> str:
    """CTEs q (t) and z (t, d) of rows with lon, lat and a segment, in metres of walking."""
    return f"""q AS (SELECT *, (b_lon - a_lon) * {KX} AS bx, (b_lat - a_lat) * 110540e0 AS dy, (lon - a_lon) * {KX} AS px, (lat - a_lat) * 110540e0 AS py FROM {rows}),
z AS (SELECT *, t * sqrt(bx * bx + dy * dy) AS s, sqrt((px - bx * t) * (px - bx * t) + (py - dy * t) * (py - dy * t)) AS d, (bx * (py - dy * t) - dy * (px - bx * t)) / sqrt(bx * bx + dy * dy) AS side
FROM (SELECT *, least(greatest((px * bx + py * dy) / (bx * bx + dy * dy), 0e0), 1e0) AS t FROM q))"""


SEG_SQL = f"""{ROADS_SQL}, seg0 AS (SELECT a.k, a.ward, a.residences, a.idx AS seq, a.lon AS a_lon, a.lat AS a_lat, b.lon AS b_lon, b.lat AS b_lat FROM vertex a JOIN vertex b ON a.k = b.k AND b.idx = a.idx + 1),
seg AS (SELECT *, {STEP_SQL} AS len FROM seg0),
home AS (SELECT o_orderkey AS pt, o_custkey AS hk, lon, lat FROM (SELECT o_orderkey, o_custkey, o_orderkey % 2 AS hs, 5e-2 + 9e-1 * (((o_orderkey * 7) % 97)::DOUBLE + 5e-1) / 97e0 AS u FROM orders) o
  JOIN (SELECT k, seq, a_lon, a_lat, b_lon, b_lat FROM seg) g ON k = o_custkey AND seq = hs, LATERAL (SELECT a_lon + (b_lon - a_lon) * u AS lon, a_lat + (b_lat - a_lat) * u + (o_orderkey % 5)::DOUBLE * 1e-5 AS lat))"""


def grid_net(k: Column) -> Column:
    """Which time round the grid a customer's road lies on it: it begins again after 16000."""
    return F.floor(k / 16000)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, seq, a_lon, a_lat, b_lon, b_lat, len of the two segments of each customer's road."""
    order = Window.partitionBy("k").orderBy("idx")
    v = grid_vertices(spark, sf_dir).withColumns({"b_lon": F.lead("lon").over(order), "b_lat": F.lead("lat").over(order)}).filter("b_lon is not null")
    len_ = geo.metres(F.col("lon"), F.col("lat"), F.col("b_lon"), F.col("b_lat"), F.lit(LAT0), geo.Y_WALK)
    return v.select("k", F.col("idx").alias("seq"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "b_lon", "b_lat", len_.alias("len"))


def order_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road, pt, lon, lat: a home for each order, up to five metres off its customer's road."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 2).cast("int").alias("seq"), (F.lit(0.05) + F.lit(0.9) * (((F.col("o_orderkey") * 7) % 97).cast("double") + 0.5) / 97.0).alias("u"))
    met = o.join(segments(spark, sf_dir), ["k", "seq"])
    lon = F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("u")
    lat = F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("u") + (F.col("o_orderkey") % 5).cast("double") * 0.00001
    return met.select(F.col("k").alias("road"), F.col("o_orderkey").alias("pt"), lon.alias("lon"), lat.alias("lat"))


def _fracs(k: Column) -> Column:
    return F.when(k % 3 != 0, F.array(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: ((j * 37 + k) % 100 + 0.5) / 100.0)))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road sheet's row of each customer, as text."""
    r = grid_roads(spark, sf_dir)
    # digits behind those of the grid keep the lines apart that lie on each other
    lat = F.col("lat0") + grid_net(F.col("k")) * 1e-9
    wkt = F.format_string("LINESTRING(%.6f %.9f, %.6f %.9f)", F.col("lon0"), lat, F.col("lon0") + 0.002, lat)
    a = (F.col("k") % 4) / 10.0
    return r.select(
        F.col("k").alias("row_index"), F.col("ward").cast("string").alias("ward_name"), F.format_string("Road %d", F.col("k") % 5000).alias("street"), "status", "residences", wkt.alias("road_geometry"),
        F.format_string("seg0:%.4f-%.4f:B|seg0:0.6000-0.8000:S", a, a + 0.2).alias("partial_geometry"),
    )


@query(f"""WITH r AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS ward_name, 'Road ' || c_custkey % 5000 AS street, (c_custkey % 60) AS res,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Complete' WHEN 'AUTOMOBILE' THEN 'In_Progress' ELSE 'Not_Started' END AS status FROM customer),
one AS (SELECT * FROM r WHERE NOT (regexp_matches(street, '\\s\\d{{1,4}}$') AND res <= 5 AND status <> 'Complete') QUALIFY row_number() OVER (PARTITION BY ward_name, street ORDER BY k DESC) = 1),
h AS (SELECT k, (k % 4) / 10e0 AS a, ((j * 37 + k) % 100 + 5e-1) / 100e0 AS f FROM one, range(10) AS j(j) WHERE k % 3 <> 0),
c AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE f >= a AND f <= a + 2e-1) AS done, count(*) FILTER (WHERE f >= 6e-1 - 2 / (2e-3 * {KX}) AND f <= 8e-1 + 2 / (2e-3 * {KX})) AS half FROM h GROUP BY k)
SELECT ward_name, street, k AS row_index, round(2e-3 * {KX}, 3) AS length_m, round(2e-3 * {KX} * 2e-1, 3) AS done_m, round(2e-3 * {KX} * 2e-1, 3) AS half_m,
  round(CASE status WHEN 'Complete' THEN 0e0 WHEN 'In_Progress' THEN CASE WHEN n > 0 THEN res * (n - done - half / 2e0) / n ELSE res * 7e-1 END ELSE res::DOUBLE END, 4) AS residences_left FROM one LEFT JOIN c USING (k)""")
def load_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_rows(spark, sf_dir).withColumn("home_fracs", _fracs(F.col("row_index")))
    loaded = homes.load_roads(rows, LAT0, exclude_features=True)
    return loaded.select("ward_name", "street", "row_index", *[F.round(c, 3).alias(c) for c in ("length_m", "done_m", "half_m")], F.round("residences_left", 4).alias("residences_left"))


@query("""SELECT c_nationkey::VARCHAR AS ward_name, count(*) FILTER (WHERE c_custkey % 60 > 0) AS with_homes, count(*) FILTER (WHERE c_custkey % 60 > 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0) AS matched FROM customer GROUP BY 1""")
def attach_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_rows(spark, sf_dir)
    # the index was made of an older geometry of every seventh row
    old = F.when(F.col("row_index") % 7 == 0, F.concat("road_geometry", F.lit("|LINESTRING(0 0, 1 1)"))).otherwise(F.col("road_geometry"))
    index = rows.filter("row_index % 3 <> 0").select(text.row_key(F.col("street"), F.col("ward_name"), old).alias("row_key"), F.array(F.array(F.lit(250), F.lit(750))).alias("positions")).distinct()
    return homes.match_stats(homes.attach_homes(rows, index), "ward_name")


@query(f"""WITH {SEG_SQL}, near AS (SELECT * FROM home JOIN seg ON hk = k), {near_sql('near')}, best AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY pt ORDER BY d, seq) = 1),
c AS (SELECT k, seq, count(*) AS n FROM best WHERE d <= 2e0 GROUP BY k, seq), p AS (SELECT seg.k, seg.seq, residences, coalesce(n, 0) AS n FROM seg LEFT JOIN c ON c.k = seg.k AND c.seq = seg.seq)
SELECT k AS road, seq AS piece, n AS homes, round(CASE WHEN sum(n) OVER (PARTITION BY k) > 0 THEN residences * n / sum(n) OVER (PARTITION BY k) END, 4) AS residences FROM p""")
def distribute_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    pieces = s.join(grid_roads(spark, sf_dir).select("k", F.col("residences").cast("double").alias("remaining")), "k").select(F.col("k").alias("road"), F.col("seq").alias("piece"), "remaining")
    placed = homes.nearest_pieces(order_homes(spark, sf_dir), s.select(F.col("k").alias("road"), F.col("seq").alias("piece"), F.lit(0).alias("seq"), "a_lon", "a_lat", "b_lon", "b_lat", F.lit(0.0).alias("from_m")), LAT0)
    return homes.shared_residences(placed, pieces).select("road", "piece", "homes", F.round("residences", 4).alias("residences"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    before = F.when(F.col("seq") == 0, 0.0).otherwise(F.first("len").over(Window.partitionBy("k").orderBy("seq")))
    return s.select(F.col("k").alias("road"), F.lit(0).alias("piece"), "seq", "a_lon", "a_lat", "b_lon", "b_lat", before.alias("from_m"), F.sum("len").over(Window.partitionBy("k")).alias("frag_m"))


@query(f"""WITH {SEG_SQL}, run AS (SELECT *, CASE WHEN seq = 0 THEN 0e0 ELSE first_value(len) OVER (PARTITION BY k ORDER BY seq) END AS from_m FROM seg), near AS (SELECT * FROM home JOIN run ON hk = k), {near_sql('near')},
best AS (SELECT k, pt, from_m + s AS along, d FROM z QUALIFY row_number() OVER (PARTITION BY pt ORDER BY d, seq) = 1)
SELECT k AS road, row_number() OVER (PARTITION BY k ORDER BY along) - 1 AS place, round(along, 3) AS at_m FROM best WHERE d <= 2e0""")
def positions_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = homes.nearest_pieces(order_homes(spark, sf_dir), _lines(spark, sf_dir).drop("frag_m"), LAT0)
    return homes.positions_along(placed).select("road", F.posexplode("positions").alias("place", "at_m")).select("road", F.col("place").cast("long").alias("place"), F.round("at_m", 3).alias("at_m"))


@query("""WITH h AS (SELECT o_custkey AS road, 1e2 * ((o_orderkey * 7919) % 10007)::DOUBLE / 10007e0 AS pos FROM orders), r AS (SELECT c_custkey AS road, 1 + c_custkey % 4 AS k FROM customer),
n AS (SELECT road, pos, row_number() OVER (PARTITION BY road ORDER BY pos) AS n, lead(pos) OVER (PARTITION BY road ORDER BY pos) AS nx, count(*) OVER (PARTITION BY road) AS al FROM h),
p AS (SELECT road, k, i FROM r, range(1, 5) AS g(i) WHERE i <= k), e AS (SELECT p.road, i, CASE WHEN i = k THEN 1e2 ELSE coalesce((pos + nx) / 2, 1e2 * i / k) END AS to_m
  FROM p LEFT JOIN n ON n.road = p.road AND i < k AND al >= k AND n.n = floor(i * al / k::DOUBLE + 5e-1))
SELECT road, i AS part, round(coalesce(lag(to_m) OVER (PARTITION BY road ORDER BY i), 0e0), 4) AS from_m, round(to_m, 4) AS to_m FROM e""")
def split_halfway(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("road"), (F.lit(100.0) * ((F.col("o_orderkey") * 7919) % 10007).cast("double") / 10007.0).alias("pos"))
    r = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("road"), (1 + F.col("c_custkey") % 4).cast("int").alias("k"), F.lit(100.0).alias("length"))
    return homes.halfway_parts(h, r).select("road", "part", F.round("from_m", 4).alias("from_m"), F.round("to_m", 4).alias("to_m"))


@query(f"""WITH {SEG_SQL}, run AS (SELECT *, CASE WHEN seq = 0 THEN 0e0 ELSE first_value(len) OVER (PARTITION BY k ORDER BY seq) END AS from_m, sum(len) OVER (PARTITION BY k) AS total FROM seg),
f AS (SELECT c_custkey AS k, j, ((j * 37 + c_custkey) % 100 + 5e-1) / 100e0 AS f FROM customer, range(10) AS g(j) WHERE c_custkey % 3 <> 0)
SELECT k AS road, j AS place, round(a_lon + (b_lon - a_lon) * (f * total - from_m) / len, 7) AS lon, round(a_lat + (b_lat - a_lat) * (f * total - from_m) / len, 7) AS lat
FROM f JOIN run USING (k) WHERE f * total > from_m AND f * total <= from_m + len""")
def points_on_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = grid_vertices(spark, sf_dir).groupBy("k").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda v: geo.point(v["lon"], v["lat"]))).alias("fragments"))
    made = homes.points_on_lines(lines.withColumn("home_fracs", _fracs(F.col("k"))), F.lit(LAT0)).filter("points is not null")
    return made.select(F.col("k").alias("road"), F.posexplode("points").alias("place", "p")).select("road", F.col("place").cast("long").alias("place"), F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order reports half of a fragment of its customer's road, on one side or both, or takes it back."""
    k = F.col("o_orderkey")
    action = F.when((F.col("o_orderstatus") == "F") & (k % 3 == 0), "remove").otherwise("add")
    side = F.element_at(F.array(F.lit("B"), F.lit("S"), F.lit("F")), (1 + k % 3).cast("int"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return reported(o.select(F.col("o_custkey").alias("row_index"), F.floor(k / 2).alias("moment"), action.alias("action"), (k % 5 % (1 + F.col("o_custkey") % 2)).alias("f"), (k % 2).alias("i"), side.alias("s"), (k % 37 == 0).alias("complete")))


def order_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("row_index"), F.explode(F.sequence(F.lit(0), (k % 2).cast("int"))).alias("frag"), (150.0 + k % 900).alias("length_m"))


TRACK_SQL = f"""leg0 AS (SELECT s_nationkey AS track, s_suppkey AS seq, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey END AS n, CASE s_suppkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'both' END AS pavement, {S_LON} AS a_lon, {S_LAT} AS a_lat FROM supplier),
leg1 AS (SELECT *, a_lon + 1e-3 AS b_lon, a_lat + 5e-4 AS b_lat FROM leg0), leg2 AS (SELECT *, {STEP_SQL} AS len FROM leg1), leg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start_m FROM leg2)"""


def track_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    lon, lat = key_point(k)
    legs = s.select(F.col("s_nationkey").alias("track"), k.alias("seq"), F.when(k % 7 != 0, k).alias("n"), F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), (k % 3 + 1).cast("int")).alias("pavement"), lon.alias("a_lon"), lat.alias("a_lat"))
    legs = legs.withColumns({"b_lon": F.col("a_lon") + 0.001, "b_lat": F.col("a_lat") + 0.0005})
    return tracks.built_track(legs.withColumn("length_m", geo.metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(LAT0), geo.Y_WALK)))


@query(f"""WITH {TRACK_SQL}, fix AS (SELECT event_id AS fix, track AS ft, a_lon + 5e-4 + ((event_id * 13) % 21 - 10)::DOUBLE * 2e-5 AS lon, a_lat + 25e-5 + ((event_id * 17) % 21 - 10)::DOUBLE * 2e-5 AS lat,
  greatest(0e0, start_m - (event_id % 80)::DOUBLE) AS from_pos, CASE WHEN event_id % 4 <> 0 THEN (event_id % 600)::DOUBLE END AS el, (5 + event_id % 20)::DOUBLE AS acc FROM events JOIN leg ON seq = 1 + event_id % 9),
near AS (SELECT * FROM fix JOIN leg ON ft = track AND n IS NOT NULL), {near_sql('near')},
w AS (SELECT *, greatest(3e1, acc * 2) AS nr, start_m + s AS pos, CASE WHEN el IS NULL THEN from_pos ELSE from_pos + el * 45e-2 END AS ex, CASE WHEN el IS NULL THEN 4e2 ELSE greatest(12e1, el * 45e-2 * 6e-1) END AS sp,
  CASE pavement WHEN 'right' THEN -5e0 WHEN 'left' THEN 5e0 ELSE 0e0 END AS us FROM z),
c AS (SELECT fix, n, pos, d / nr * (d / nr) + (side - us) / (acc + 6) * ((side - us) / (acc + 6)) + (pos - ex) / sp * ((pos - ex) / sp) + greatest(0e0, pos - ex) / sp * 5e-1 AS score FROM w
  WHERE d <= nr AND pos >= from_pos - 40 AND (el IS NULL OR pos <= from_pos + el * 45e-2 * 25e-1 + 150)),
r AS (SELECT *, row_number() OVER (PARTITION BY fix ORDER BY score, n) AS rank FROM c) SELECT fix, rank::INTEGER AS rank, n, round(pos, 3) AS pos, round(score, 4) AS score FROM r WHERE rank <= 4""")
def progress_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = track_legs(spark, sf_dir)
    e = F.col("event_id")
    at = table(spark, sf_dir, "events", "event_id").join(legs, F.col("seq") == 1 + e % 9)
    fixes = at.select(
        e.alias("fix"), "track", (F.col("a_lon") + 0.0005 + ((e * 13) % 21 - 10).cast("double") * 0.00002).alias("lon"), (F.col("a_lat") + 0.00025 + ((e * 17) % 21 - 10).cast("double") * 0.00002).alias("lat"),
        F.greatest(F.lit(0.0), F.col("start_m") - (e % 80).cast("double")).alias("from_pos"), F.when(e % 4 != 0, (e % 600).cast("double")).alias("elapsed_s"), (5 + e % 20).cast("double").alias("accuracy"),
    )
    found = tracks.located(fixes, legs.withColumn("from_m", F.lit(0.0)), LAT0)
    return found.select("fix", "rank", "n", F.round("pos", 3).alias("pos"), F.round("score", 4).alias("score"))


#: An event is a fix of one of 200 walkers, who go from step to step of their nation's track, a step in about a minute.
FOLD_SQL = f"""{TRACK_SQL}, at_ AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY seq) - 1 AS j, count(*) OVER (PARTITION BY track) AS js FROM leg),
fx AS (SELECT event_id AS fix, event_id % 200 AS walker, event_id // 200 AS i, (event_id // 200) * 60 + event_id % 30 AS moment, event_id % 200 % 25 AS track, (5 + event_id % 20)::DOUBLE AS acc FROM events),
pt AS (SELECT fx.*, a_lon + 5e-4 + ((fix * 13) % 21 - 10)::DOUBLE * 2e-5 AS lon, a_lat + 25e-5 + ((fix * 17) % 21 - 10)::DOUBLE * 2e-5 AS lat FROM fx JOIN at_ ON at_.track = fx.track AND j = (i + i // 7) % js),
near AS (SELECT pt.*, leg.seq, leg.n, leg.pavement, leg.start_m, a_lon, a_lat, b_lon, b_lat FROM pt JOIN leg USING (track) WHERE n IS NOT NULL), {near_sql('near')},
hit AS (SELECT fix, n, start_m + s AS pos, d, acc, side - CASE pavement WHEN 'right' THEN -5e0 WHEN 'left' THEN 5e0 ELSE 0e0 END AS off FROM z WHERE d <= greatest(3e1, acc * 2)),
r(walker, i, fix, pos, t, best) AS (SELECT walker, -1::BIGINT, NULL::BIGINT, 0e0, NULL::BIGINT, NULL::STRUCT(score DOUBLE, n BIGINT, pos DOUBLE) FROM (SELECT DISTINCT walker FROM pt)
  UNION ALL SELECT walker, i, fix, coalesce(best.pos, pos), CASE WHEN best IS NOT NULL THEN now_ ELSE t END, best FROM (
    SELECT r.walker, pt.i, pt.fix, r.pos, r.t, pt.moment AS now_, min({{'score': (d / greatest(3e1, hit.acc * 2)) ** 2 + (off / (hit.acc + 6)) ** 2 + ((hit.pos - r.pos - coalesce(pt.moment - r.t, 0) * 45e-2) / CASE WHEN r.t IS NULL THEN 4e2 ELSE greatest(12e1, (pt.moment - r.t) * 27e-2) END) ** 2
      + greatest(0e0, hit.pos - r.pos - coalesce(pt.moment - r.t, 0) * 45e-2) / CASE WHEN r.t IS NULL THEN 4e2 ELSE greatest(12e1, (pt.moment - r.t) * 27e-2) END * 5e-1, 'n': n::BIGINT, 'pos': hit.pos}})
      FILTER (WHERE hit.fix IS NOT NULL AND hit.pos >= r.pos - 40 AND (r.t IS NULL OR hit.pos <= r.pos + (pt.moment - r.t) * 1125e-3 + 150)) AS best
    FROM r JOIN pt ON pt.walker = r.walker AND pt.i = r.i + 1 LEFT JOIN hit ON hit.fix = pt.fix GROUP BY ALL))"""
FOLDED_SQL = f"""WITH RECURSIVE {FOLD_SQL} SELECT walker, fix, best.n AS n, round(best.pos, 3) AS pos, round(best.score, 4) AS score FROM r WHERE fix IS NOT NULL"""


def walker_fixes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fixes (walker, fix, ts, track, lon, lat, accuracy) and the segments of their tracks."""
    legs = track_legs(spark, sf_dir).withColumn("from_m", F.lit(0.0))
    placed = legs.select(F.col("track").alias("_t"), (F.row_number().over(Window.partitionBy("track").orderBy("seq")) - 1).cast("long").alias("_j"), "a_lon", "a_lat")
    counts = legs.groupBy(F.col("track").alias("_k")).agg(F.count("*").alias("_js"))
    e = F.col("event_id")
    i = F.floor(e / 200)
    fixes = table(spark, sf_dir, "events", "event_id").select(e.alias("fix"), (e % 200).alias("walker"), (e % 200 % 25).cast("int").alias("track"), i.alias("i"), F.timestamp_seconds(i * 60 + e % 30 + 1_700_000_000).alias("ts"), (5 + e % 20).cast("double").alias("accuracy"))
    # the place is known before the legs are met, so a fix meets one leg and not all of its track
    aimed = fixes.join(counts, F.col("track") == F.col("_k")).withColumn("_at", (F.col("i") + F.floor(F.col("i") / 7)) % F.col("_js"))
    met = aimed.join(placed, (F.col("track") == F.col("_t")) & (F.col("_at") == F.col("_j")))
    f = F.col("fix")
    return met.select("walker", "fix", "ts", "track", (F.col("a_lon") + 0.0005 + ((f * 13) % 21 - 10).cast("double") * 0.00002).alias("lon"), (F.col("a_lat") + 0.00025 + ((f * 17) % 21 - 10).cast("double") * 0.00002).alias("lat"), "accuracy"), legs


@query(FOLDED_SQL)
def progress_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = progress.scored_batch(*walker_fixes(spark, sf_dir), LAT0)
    return done.select("walker", "fix", "n", F.round("pos", 3).alias("pos"), F.round("score", 4).alias("score"))


@query(FOLDED_SQL)
def progress_scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fixes as a stream of files in no order, one file a batch; a fix long after all others lets the last ones out."""
    fixes, legs = walker_fixes(spark, sf_dir)
    rounds = Rounds(fixes)
    legs = rounds.write(legs)
    closing = fixes.limit(1).withColumns({"walker": F.lit(-1).cast("long"), "ts": F.lit("2099-01-01").cast("timestamp")})
    fixes.union(closing).repartition(6, F.xxhash64("fix", "walker")).write.parquet(f"{rounds.base}/fixes")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(fixes.schema).option("maxFilesPerTrigger", 3).parquet(f"{rounds.base}/fixes")
        scored = progress.scored_stream(stream, legs, LAT0, "3650 days")
        scored.writeStream.format("parquet").option("path", f"{rounds.base}/out").option("checkpointLocation", f"{rounds.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    done = spark.read.schema(progress.SCORED).parquet(f"{rounds.base}/out").filter("walker >= 0")
    return done.select("walker", "fix", "n", F.round("pos", 3).alias("pos"), F.round("score", 4).alias("score"))


@query(f"""WITH {TRACK_SQL}, tot AS (SELECT track, sum(len) AS total FROM leg GROUP BY 1), p AS (SELECT event_id AS fix, track, (event_id % 997)::DOUBLE * 13e-1 AS pos, total FROM events JOIN tot ON track = event_id % 25),
m AS (SELECT fix, least(pos, total) AS g, leg.* FROM p JOIN leg USING (track)), r AS (SELECT * FROM m WHERE g >= start_m AND g <= start_m + len QUALIFY row_number() OVER (PARTITION BY fix ORDER BY seq) = 1)
SELECT fix, n, round(g - start_m, 3) AS into_m, round(start_m + len - g, 3) AS left_m FROM r""")
def track_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id").select(F.col("event_id").alias("fix"), (F.col("event_id") % 25).cast("int").alias("track"), ((F.col("event_id") % 997).cast("double") * 1.3).alias("pos"))
    return tracks.at_positions(e, track_legs(spark, sf_dir)).select("fix", "n", F.round("into_m", 3).alias("into_m"), F.round("left_m", 3).alias("left_m"))


@query(f"""WITH {SEG_SQL}, run AS (SELECT *, CASE WHEN seq = 0 THEN 0e0 ELSE first_value(len) OVER (PARTITION BY k ORDER BY seq) END AS from_m, sum(len) OVER (PARTITION BY k) AS total FROM seg),
l AS (SELECT k AS step, seq AS ls, a_lon + CASE WHEN seq = 0 THEN 1e-4 ELSE 0e0 END AS la, a_lat + 1e-5 + CASE WHEN seq = 0 THEN 2e-5 ELSE 0e0 END AS lb, b_lon - CASE WHEN seq = 1 THEN 1e-4 ELSE 0e0 END AS lc, b_lat + 1e-5 + CASE WHEN seq = 1 THEN 2e-5 ELSE 0e0 END AS ld FROM seg),
m AS (SELECT *, sqrt((lc - la) * {KX} * ((lc - la) * {KX}) + (ld - lb) * 110540e0 * ((ld - lb) * 110540e0)) AS ll FROM l),
p AS (SELECT *, la + (lc - la) * i / greatest(1, ceil(ll / 3)) AS lon, lb + (ld - lb) * i / greatest(1, ceil(ll / 3)) AS lat FROM m, range(40) AS g(i) WHERE i <= greatest(1, ceil(ll / 3))),
near AS (SELECT * FROM p JOIN run ON run.k = step AND seq = ls), {near_sql('near')}
SELECT step, k AS row_index, printf('seg0:%.4f-%.4f:%s', min((from_m + s) / total), max((from_m + s) / total), CASE step % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'S' ELSE 'F' END) AS token FROM z GROUP BY step, k""")
def step_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    cut = lambda at, by: F.when(F.col("seq") == at, by).otherwise(0.0)
    # each road is walked from a tenth behind its beginning to a tenth before its end, a metre beside its line
    walk = s.select(
        F.col("k").alias("step"), grid_net(F.col("k")).alias("net"), "seq", F.element_at(F.array(F.lit("both"), F.lit("right"), F.lit("left")), (F.col("k") % 3 + 1).cast("int")).alias("pavement"), (F.col("a_lon") + cut(0, 0.0001)).alias("a_lon"),
        (F.col("a_lat") + 0.00001 + cut(0, 0.00002)).alias("a_lat"), (F.col("b_lon") - cut(1, 0.0001)).alias("b_lon"), (F.col("b_lat") + 0.00001 + cut(1, 0.00002)).alias("b_lat"),
    )
    rows = _lines(spark, sf_dir).withColumnRenamed("road", "row_index").withColumnRenamed("piece", "frag").withColumn("net", grid_net(F.col("row_index")))
    return marks.step_tokens(walk, rows, LAT0).select("step", "row_index", "token")


def status_sql(reports: str) -> str:
    """The rows after reports (row_index, moment, action, f, i, s, complete) on halves of fragments; odd rows have two."""
    return f"""WITH t AS ({reports}), gone AS (SELECT row_index, f, i, s, max(moment) AS m FROM t WHERE action = 'remove' GROUP BY ALL),
l AS (SELECT t.row_index, t.f, t.i, t.s, min(moment) AS since FROM t LEFT JOIN gone g ON g.row_index = t.row_index AND g.f = t.f AND g.i = t.i AND g.s = t.s WHERE action = 'add' AND (g.m IS NULL OR moment > g.m) GROUP BY ALL),
cells AS (SELECT row_index, f, i FROM l GROUP BY ALL HAVING bool_or(s = 'B') OR (bool_or(s = 'S') AND bool_or(s = 'F'))), whole AS (SELECT row_index FROM cells GROUP BY 1 HAVING count(*) = 2 * (1 + row_index % 2)),
g AS (SELECT row_index, string_agg(printf('seg%d:%.4f-%.4f:%s', f, i / 2e0, (i + 1) / 2e0, s), '|' ORDER BY since, printf('seg%d:%.4f-%.4f:%s', f, i / 2e0, (i + 1) / 2e0, s)) AS tokens FROM l GROUP BY 1),
told AS (SELECT row_index, max(moment) FILTER (WHERE action = 'add' AND complete) AS c, max(moment) FILTER (WHERE action = 'remove') AS r FROM t GROUP BY 1)
SELECT told.row_index, coalesce(tokens, '-') AS partial_geometry, CASE WHEN w.row_index IS NOT NULL OR (c IS NOT NULL AND (r IS NULL OR c > r)) THEN 'Complete' WHEN tokens IS NOT NULL THEN 'In_Progress' ELSE 'Not_Started' END AS status
FROM told LEFT JOIN g ON g.row_index = told.row_index LEFT JOIN whole w ON w.row_index = told.row_index"""


def reported(rows: DataFrame) -> DataFrame:
    """Reports of rows (row_index, moment, action, f, i, s, complete) with their tokens."""
    token = F.format_string("seg%d:%.4f-%.4f:%s", "f", F.col("i") / 2.0, (F.col("i") + 1) / 2.0, "s")
    return rows.select("row_index", F.col("moment").alias("at"), "action", token.alias("token"), "complete")


@query(status_sql("""SELECT o_custkey AS row_index, o_orderkey // 2 AS moment, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'remove' ELSE 'add' END AS action, o_orderkey % 2 AS i,
  o_orderkey % 5 % (1 + o_custkey % 2) AS f, ['B', 'S', 'F'][1 + o_orderkey % 3] AS s, o_orderkey % 37 = 0 AS complete FROM orders"""))
def range_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.accumulated(order_changes(spark, sf_dir), order_fragments(spark, sf_dir))


@query(status_sql("""SELECT k // 40 AS row_index, (k * 7919) % 10007 AS moment, CASE WHEN h % 7 = 0 THEN 'remove' ELSE 'add' END AS action, h % 2 AS i, h // 6 % (1 + k // 40 % 2) AS f, ['B', 'S', 'F'][1 + h // 2 % 3] AS s, k % 37 = 0 AS complete
  FROM (SELECT c_custkey AS k, (c_custkey * 7907) % 101 AS h FROM customer)"""))
def range_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports on rows, forty on each, as a stream of files in no order, in several batches."""
    k, h = F.col("c_custkey"), (F.col("c_custkey") * 7907) % 101
    row = F.floor(k / 40)
    customers = table(spark, sf_dir, "customer", "c_custkey").select(
        row.alias("row_index"), ((k * 7919) % 10007).alias("moment"), F.when(h % 7 == 0, "remove").otherwise("add").alias("action"), (F.floor(h / 6) % (1 + row % 2)).alias("f"), (h % 2).alias("i"),
        F.element_at(F.array(F.lit("B"), F.lit("S"), F.lit("F")), (1 + F.floor(h / 2) % 3).cast("int")).alias("s"), (k % 37 == 0).alias("complete"),
    )
    rounds = Rounds(customers)
    # dealt by a hash, so that no file holds a span of time
    reported(customers).repartition(6, F.xxhash64("token", "at")).write.parquet(f"{rounds.base}/reports")
    stream = spark.readStream.schema("row_index long, at long, action string, token string, complete boolean").option("maxFilesPerTrigger", 2).parquet(f"{rounds.base}/reports")
    ledger = ranges.Ledger(f"{rounds.base}/ledger", ranges.CHANGES)
    ranges.token_changes(stream).writeStream.foreachBatch(ledger).option("checkpointLocation", f"{rounds.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    fragments = customers.select("row_index", F.explode(F.sequence(F.lit(0), (F.col("row_index") % 2).cast("int"))).alias("frag"), F.lit(None).cast("double").alias("length_m")).distinct()
    return ranges.recorded_rows(ledger.read(spark), fragments)


@query("""SELECT p_partkey AS row_index, CASE p_partkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a|b|c' WHEN 2 THEN '-' ELSE 'b|c|a' END AS tokens FROM (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 2)
UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '-' ELSE 'c' END FROM part WHERE p_partkey % 4 = 2""")
def token_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k = F.col("p_partkey") % 4
    have = F.when(k == 0, "a|b").when(k == 1, "a|b").when(k == 3, "b|c")
    new = F.when(k == 0, F.array(F.lit("b"))).when(k == 1, F.array(F.lit("b"), F.lit("c"))).when(k == 3, F.array(F.lit("a"), F.lit("c"))).when(F.col("p_size") % 2 == 1, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.col("p_partkey").alias("row_index"), marks.token_union(have, new).alias("tokens"))


@query("""SELECT o_custkey AS route, bool_and(o_orderstatus <> 'P') AS ok, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded, count(*) AS total,
coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'P'), '') AS errors FROM orders GROUP BY 1""")
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return marks.write_summary(o.select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "P").alias("ok"), F.col("o_orderpriority").alias("error")), "route")


@query(f"""WITH h AS (SELECT s_nationkey AS ward, s_suppkey AS seq, 'Inn ' || s_suppkey % 3 AS label, -2e0 + (s_suppkey % 5)::DOUBLE * 15e-3 AS lon, 528e-1 AS lat FROM supplier),
f AS (SELECT *, abs(lon - first_value(lon) OVER (PARTITION BY ward, label ORDER BY seq)) * {KX} > 2e3 AS far FROM h),
n AS (SELECT *, sum(far::INTEGER) OVER (PARTITION BY ward, label ORDER BY seq) AS i FROM f), g AS (SELECT ward, CASE WHEN far THEN label || ' #' || (i + 1) ELSE label END AS label, min(seq) AS seq, count(*) AS hubs, string_agg(seq, ',' ORDER BY seq) AS clusters FROM n GROUP BY 1, 2)
SELECT ward, 'H' || row_number() OVER (PARTITION BY ward ORDER BY seq) AS id, label, hubs, clusters FROM g""")
def merged_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), F.col("s_suppkey")
    hubs = s.select(F.col("s_nationkey").alias("ward"), k.alias("seq"), F.format_string("Inn %d", k % 3).alias("label"), (F.lit(-2.0) + (k % 5).cast("double") * 0.015).alias("lon"), F.lit(52.8).alias("lat"), F.array(k.cast("string")).alias("clusters"))
    return routes.merged_hubs(hubs, LAT0).withColumn("clusters", F.array_join("clusters", ","))


@query(f"""WITH {ROADS_SQL}, c AS (SELECT ward * 100 + k % 3 AS cluster, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM vertex GROUP BY 1),
r AS (SELECT ward * 100 + k % 3 AS cluster, min(k)::DOUBLE * 20 AS dist, count(*) * 14e-2 AS km, sum(residences)::DOUBLE AS res FROM road GROUP BY 1)
SELECT cluster, round(sqrt((x1 - x0) * {KX} * ((x1 - x0) * {KX}) + (y1 - y0) * 111320e0 * ((y1 - y0) * 111320e0)) / 1000, 4) AS spread_km,
  CASE WHEN (km > 2 AND res / km < 30) OR sqrt((x1 - x0) * {KX} * ((x1 - x0) * {KX}) + (y1 - y0) * 111320e0 * ((y1 - y0) * 111320e0)) / 1000 > 15e-1 THEN 'drive' WHEN dist <= 700 THEN 'walk' WHEN dist <= 1100 THEN 'hybrid' ELSE 'drive' END AS kind FROM c JOIN r USING (cluster)""")
def route_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = (F.col("ward") * 100 + F.col("k") % 3).alias("cluster")
    box = routes.bounds(grid_vertices(spark, sf_dir).select(cluster, "lon", "lat"), "cluster")
    facts = grid_roads(spark, sf_dir).select(cluster, "k", "residences").groupBy("cluster").agg((F.min("k").cast("double") * 20).alias("min_dist_m"), (F.count("*") * 0.14).alias("km"), F.sum("residences").cast("double").alias("residences"))
    return routes.route_kinds(box.join(facts, "cluster"), LAT0, by_effort=True).select("cluster", F.round("spread_km", 4).alias("spread_km"), "kind")


@query(f"""WITH {SEG_SQL}, pm AS (SELECT *, sqrt((b_lon - a_lon) * {KX} * ((b_lon - a_lon) * {KX}) + (b_lat - a_lat) * 111320e0 * ((b_lat - a_lat) * 111320e0)) AS pl FROM seg), e AS (SELECT pt, hk, lon, lat FROM home),
m AS (SELECT e.*, pm.*, (b_lon - a_lon) AS dx, (b_lat - a_lat) AS ey FROM e JOIN pm ON hk = k), t AS (SELECT *, least(greatest(((lon - a_lon) * dx + (lat - a_lat) * ey) / (dx * dx + ey * ey), 0e0), 1e0) AS t FROM m),
d AS (SELECT *, sqrt((lon - a_lon - dx * t) * {KX} * ((lon - a_lon - dx * t) * {KX}) + (lat - a_lat - ey * t) * 111320e0 * ((lat - a_lat - ey * t) * 111320e0)) AS d FROM t)
SELECT pt, k AS road, seq AS frag, round(t, 4) AS frac, round(d, 3) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY pt ORDER BY d, seq) = 1""")
def best_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select(F.col("k").alias("road"), F.col("seq").alias("frag"), F.lit(0).alias("seq"), "a_lon", "a_lat", "b_lon", "b_lat", F.lit(0.0).alias("from_m"), geo.metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(LAT0)).alias("frag_m"))
    return routes.best_fractions(order_homes(spark, sf_dir), s, LAT0).select("pt", "road", "frag", F.round("frac", 4).alias("frac"), F.round("dist", 3).alias("dist"))


@query("""SELECT c_custkey AS part, c_custkey AS road, CASE c_custkey % 3 WHEN 0 THEN 'seg0:0.2500-0.7500' WHEN 1 THEN 'seg0:0.2500-1.0000|seg1:0.0000-0.5000' ELSE 'seg1:0.2500-0.7500' END AS ranges FROM customer""")
def part_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    rows = s.select(F.col("k").alias("road"), F.col("seq").alias("frag"), F.lit(0).alias("seq"), "a_lon", "a_lat", "b_lon", "b_lat", F.lit(0.0).alias("from_m"), geo.metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(LAT0)).alias("frag_m"))
    at = lambda seq, t, c: F.max(F.when(F.col("seq") == seq, F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * t))
    which = F.col("k") % 3
    ends = s.groupBy("k").agg(*[at(seq, t, c).alias(f"{c}{seq}_{int(100 * t)}") for seq in (0, 1) for t in (0.25, 0.5, 0.75) for c in ("lon", "lat")])
    pick = lambda c, x, y, z: F.when(which == 0, F.col(f"{c}{x}")).when(which == 1, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{z}"))
    parts = ends.select(F.col("k").alias("part"), F.col("k").alias("road"), *[pick(c, "0_25", "0_25", "1_25").alias(f"a_{c}") for c in ("lon", "lat")], *[pick(c, "0_75", "1_50", "1_75").alias(f"b_{c}") for c in ("lon", "lat")])
    shown = F.array_join(F.transform("ranges", lambda r: F.format_string("seg%d:%.4f-%.4f", r["frag"], r["a"], r["b"])), "|")
    return routes.part_ranges(parts, rows, LAT0).select("part", "road", shown.alias("ranges"))


@query(f"""WITH {ROADS_SQL}, b AS (SELECT ward, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM vertex WHERE k % 50 = 0 GROUP BY 1)
SELECT DISTINCT k AS row_index FROM vertex v JOIN b ON v.ward = b.ward WHERE lon > x0 - 24e-3 AND lon < x1 + 24e-3 AND lat > y0 - 15e-3 AND lat < y1 + 15e-3""")
def rows_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = grid_vertices(spark, sf_dir)
    rows = v.groupBy("k", "ward").agg(F.array(F.collect_list(geo.point(F.col("lon"), F.col("lat")))).alias("fragments"))
    return routes.rows_near(rows, routes.bounds(v.filter("k % 50 = 0"), "ward"), "ward").select(F.col("k").alias("row_index"))


@query("""SELECT n_name AS ward_name, min(c_custkey) AS first_row, count(*) AS rows, round(avg(526e-1 + ((c_custkey // 40) % 400)::DOUBLE * 1e-3), 6) AS mean_lat FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def wards_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = grid_roads(spark, sf_dir).join(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("ward") == F.col("n_nationkey"), "left")
    return routes.wards_seen(r.select(F.col("n_name").alias("ward_name"), F.col("k").alias("row_index"), F.col("lat0").alias("lat"))).withColumn("mean_lat", F.round("mean_lat", 6))


@query("""WITH p AS (SELECT o_custkey AS route, o_orderkey AS seq, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS street, lag(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT route, string_agg(street, ' > ' ORDER BY seq) AS streets FROM p WHERE street IS NOT NULL AND street IS DISTINCT FROM b GROUP BY 1""")
def streets_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return routes.streets_in_order(o.select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("street")))


@query("""SELECT c_custkey AS road, 2 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS points FROM customer""")
def vertex_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of six points, of which some are no more than 0.3 m from the last one kept."""
    k = F.col("c_custkey")
    at = lambda m: geo.point(F.lit(-2.0), F.lit(52.8) + m / F.lit(geo.Y_WALK))
    steps = F.array(at(F.lit(0.0)), at(F.lit(0.2)), at(F.when(k % 2 == 0, 0.4).otherwise(0.25)), at(F.when(k % 2 == 0, 0.6).otherwise(0.1)), at(F.lit(50.0)), at(F.when(k % 3 == 0, 50.4).otherwise(50.2)))
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("road"), F.size(routes.without_near_vertices(steps, 0.3, F.lit(LAT0), geo.Y_WALK)).alias("points"))


@query("""SELECT o_custkey AS route, count(*) FILTER (WHERE o_orderstatus <> 'P') AS legs, coalesce(sum(o_orderkey % 9) FILTER (WHERE o_orderstatus <> 'P'), 0)::BIGINT AS homes, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'P'), 0e0), 2) AS walk_m,
round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0e0), 2) AS transfer_m, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS crossings FROM orders GROUP BY 1""")
def direction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    legs = o.select(F.col("o_custkey").alias("route"), F.when(F.col("o_orderstatus") == "P", "transfer").otherwise("leg").alias("type"), (k % 9).alias("homes"), F.col("o_totalprice").alias("length_m"), (k % 4 == 0).alias("crosses"))
    return routes.direction_stats(legs).withColumns({c: F.round(c, 2) for c in ("walk_m", "transfer_m")})


@query("""SELECT o_orderkey AS route, o_custkey AS seq, NULLIF(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, '') AS street, o_orderpriority AS cue, floor((o_orderkey % 97)::DOUBLE / 7e0 * 1e1 + 5e-1) / 1e1 AS homes, floor((o_orderkey % 89)::DOUBLE / 3e0 + 5e-1)::BIGINT AS len,
floor((-25e-1 + (o_custkey % 997)::DOUBLE / 997e0 * 5e-1) * 1e6 + 5e-1) / 1e6 AS lon, floor((526e-1 + ((o_custkey * 7919) % 991)::DOUBLE / 991e0 * 4e-1) * 1e6 + 5e-1) / 1e6 AS lat FROM orders""")
def compact_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), F.col("o_orderkey")
    lon, lat = key_point(F.col("o_custkey"))
    return routes.compact_legs(o.select(k.alias("route"), F.col("o_custkey").alias("seq"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("street"), F.col("o_orderpriority").alias("cue"), ((k % 97).cast("double") / 7.0).alias("homes"), ((k % 89).cast("double") / 3.0).alias("length_m"), lon.alias("lon"), lat.alias("lat")))


@query("""SELECT c_nationkey AS route, min(((c_custkey * 31) % 1009)::DOUBLE) AS dist_m FROM customer GROUP BY 1""")
def route_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return routes.least_by_route(c.select(F.col("c_custkey").alias("road"), ((F.col("c_custkey") * 31) % 1009).cast("double").alias("dist_m")), c.select(F.col("c_nationkey").alias("route"), F.col("c_custkey").alias("road")))


@query(f"""WITH b AS (SELECT {S_LON} AS x, {S_LAT} AS y FROM supplier ORDER BY s_suppkey DESC LIMIT 300), r AS (SELECT c_custkey AS request, -25e-1 + (c_custkey % 997)::DOUBLE / 997e0 * 5e-1 AS x, 526e-1 + ((c_custkey * 7919) % 991)::DOUBLE / 991e0 * 4e-1 AS y, CASE WHEN c_custkey % 10 = 0 THEN 8e-1 ELSE 1e-2 END AS w FROM customer)
SELECT request FROM r WHERE w <= 6e-1 AND NOT EXISTS (SELECT 1 FROM b WHERE r.x >= b.x - 2e-2 AND r.y >= b.y - 2e-2 AND r.x + w <= b.x + 3e-2 AND r.y + w <= b.y + 3e-2)""")
def uncovered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    def box(key: str, before: Column, after: Column) -> list[Column]:
        lon, lat = key_point(F.col(key))
        return [(lon - before).alias("min_lon"), (lat - before).alias("min_lat"), (lon + after).alias("max_lon"), (lat + after).alias("max_lat")]

    wide = F.when(F.col("c_custkey") % 10 == 0, 0.8).otherwise(0.01)
    asked = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("request"), *box("c_custkey", F.lit(0.0), wide))
    have = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("seq"), *box("s_suppkey", F.lit(0.02), F.lit(0.03)))
    return routes.uncovered_requests(asked, have).select("request")


@query("""SELECT c_custkey AS road, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN 'parking' WHEN c_custkey % 5 = 0 THEN 'hub' ELSE 'spot' END AS start FROM customer""")
def start_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "walk").otherwise("drive")
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("road"), routes.start_place(kind, F.when(k % 2 == 0, "parking"), F.when(k % 5 != 0, "spot"), F.lit("hub")).alias("start"))


@query("""SELECT p_partkey AS part, regexp_replace('Lane ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' (part 1) (part 2.1)' WHEN p_partkey % 3 = 1 THEN ' (part 7)' ELSE '' END, '^(.*) \\(part .*$', '\\1') AS base,
p_partkey % 3 = 2 AND p_size < 10000 AND p_size % 9 <= 5 OR p_partkey % 11 = 0 AS feature, replace(replace(p_name, '&', '&amp;'), '<', '&lt;') AS shown FROM part""")
def road_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_name"), F.col("p_partkey")
    plain = F.format_string("Lane %d", F.col("p_size"))
    name = F.concat(plain, F.when(k % 3 == 0, " (part 1) (part 2.1)").when(k % 3 == 1, " (part 7)").otherwise(""))
    feature = text.non_residential(F.when(k % 11 == 0, F.concat(F.lit("Footpath by "), name)).otherwise(name), F.col("p_size") % 9)
    return p.select(k.alias("part"), text.base_name(name).alias("base"), feature.alias("feature"), text.escaped(F.col("p_name")).alias("shown"))


@query("""WITH k AS (SELECT c_custkey AS road, (c_custkey % 3) * 2e-2 AS x FROM customer)
SELECT road, round(x, 4) AS a, round(2e-1 + x, 4) AS b, 'done' AS kind FROM k UNION ALL SELECT road, round(5e-1 + x, 4), round(6e-1 + x, 4), 'done' FROM k
UNION ALL SELECT road, round(3e-1 + x, 4), round(5e-1 + x, 4), 'one' FROM k UNION ALL SELECT road, round(6e-1 + x, 4), round(9e-1 + x, 4), 'other' FROM k""")
def done_and_half_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches done on both sides, and on one: both 0 to 0.2, one side 0.3 to 0.6, the other 0.5 to 0.9, moved by x, with 1 m that is too short."""
    x, length = (F.col("c_custkey") % 3) * 0.02, F.lit(1000.0)
    span = lambda a, b: F.array(intervals.interval(x + a, x + b))
    both, one, other = F.concat(span(0.0, 0.2), span(0.7, 0.701)), span(0.3, 0.6), span(0.5, 0.9)
    done = intervals.done(both, one, other, length)
    half = lambda side, d: intervals.half_done(side, d, length)
    listed = intervals.let(done, lambda d: F.array(*[F.struct(F.lit(kind).alias("kind"), x.alias("x")) for kind, x in (("done", d), ("one", half(one, d)), ("other", half(other, d)))]))
    # the file may be one task's, and stretches are far dearer than keys
    dealt = table(spark, sf_dir, "customer", "c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    found = dealt.select(F.col("c_custkey").alias("road"), F.explode(listed).alias("l")).select("road", "l.kind", F.explode("l.x").alias("x"))
    return found.select("road", F.round("x.a", 4).alias("a"), F.round("x.b", 4).alias("b"), "kind")


@query("""WITH s AS (SELECT c_nationkey AS route, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS streets, sum(c_custkey % 60)::BIGINT AS residences FROM customer GROUP BY 1) SELECT * FROM s""")
def sheet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    return payload.sheet_facts(c.select(F.col("c_nationkey").alias("route"), F.col("c_mktsegment").alias("street"), (F.col("c_custkey") % 60).alias("residences")))


@query("""SELECT s_suppkey AS pub, s_name AS name, row_number() OVER (ORDER BY s_name, s_acctbal, s_suppkey) AS place FROM supplier""")
def poi_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_acctbal").select(F.col("s_suppkey").alias("pub"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("lat"))
    return poi.listed(s).select("pub", "name", "place")


@query("""SELECT c_custkey AS route, CASE c_custkey % 3 WHEN 0 THEN 'Hall (event start point)' WHEN 1 THEN 'Drive to Elm Row and park there (suggested — please use your own discretion), then walk the route' ELSE 'Park on Elm Row (suggested — please use your own discretion)' END AS hint FROM customer""")
def start_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("route"), payload.start_hint(F.when(k == 0, "walk").when(k == 1, "hybrid").otherwise("drive"), F.lit("Hall"), F.lit("Elm Row")).alias("hint"))


@query("""SELECT c_custkey AS row_index, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 0 END AS tolerant, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 0 END AS whole, CASE c_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS kept FROM customer""")
def parse_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that the tolerant, all-or-nothing and index-keeping readers find in good and in malformed geometries."""
    k = F.col("c_custkey") % 4
    wkt = F.when(k == 0, "LINESTRING(0 1,  2 3)|LINESTRING(bad)").when(k == 1, "-").when(k == 2, "linestring (0 1, 2 3)|LINESTRING(4 5, 6 7, 8 9)").otherwise("POINT(1 2)")
    return table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("row_index"), *[F.size(parse.linestrings(wkt, mode)).alias(name) for mode, name in (("tolerant", "tolerant"), ("all_or_nothing", "whole"), ("keep_index", "kept"))])


@query(f"""WITH {RANGES_SQL}, x AS (SELECT user_id, a + 2e-3 AS a, b + 3e-3 AS b FROM rng WHERE (a * 1e3)::BIGINT % 3 = 0), p AS (SELECT user_id, a AS at_ FROM rng UNION SELECT user_id, b FROM rng UNION SELECT user_id, a FROM x UNION SELECT user_id, b FROM x),
e AS (SELECT user_id, at_ AS a, lead(at_) OVER (PARTITION BY user_id ORDER BY at_) AS b FROM p),
i AS (SELECT e.*, EXISTS (SELECT 1 FROM x WHERE x.user_id = e.user_id AND x.a <= e.a AND x.b >= e.b) AS twice FROM e WHERE EXISTS (SELECT 1 FROM rng WHERE rng.user_id = e.user_id AND rng.a <= e.a AND rng.b >= e.b))
SELECT user_id, round(coalesce(sum(b - a) FILTER (WHERE NOT twice), 0e0), 6) AS alone, round(coalesce(sum(b - a) FILTER (WHERE twice), 0e0), 6) AS shared FROM i GROUP BY 1""")
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = event_ranges(spark, sf_dir)
    right = left.filter((F.col("a") * 1000).cast("decimal(20,0)").cast("long") % 3 == 0).select("user_id", (F.col("a") + 0.002).alias("a"), (F.col("b") + 0.003).alias("b"))
    total = lambda test: F.round(F.coalesce(F.sum(F.when(test, F.col("b") - F.col("a"))), F.lit(0.0)), 6)
    return roads.swept(left, right, ("user_id",)).groupBy("user_id").agg(total(~F.col("both")).alias("alone"), total(F.col("both")).alias("shared"))


LINK_NODES_SQL = f"""node AS (SELECT c_custkey AS node, -25e-1 + (c_custkey % 40)::DOUBLE * 12e-4 + (c_custkey % 7)::DOUBLE * 1e-4 AS lon, 526e-1 + (c_custkey // 40)::DOUBLE * 9e-4 AS lat FROM customer),
edge AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 3 = 1 AND c_custkey < (SELECT max(c_custkey) FROM customer)),
part AS (SELECT a AS node, a AS part FROM edge UNION ALL SELECT b, a FROM edge), placed AS (SELECT node, part, lon, lat FROM node JOIN part USING (node))"""


@query(f"""WITH {LINK_NODES_SQL}, d AS (SELECT p.part AS p1, q.part AS p2, least(p.node, q.node) AS a, greatest(p.node, q.node) AS b, sqrt((p.lon - q.lon) * {KX} * ((p.lon - q.lon) * {KX}) + (p.lat - q.lat) * 110540e0 * ((p.lat - q.lat) * 110540e0)) AS m
  FROM placed p JOIN placed q ON p.part < q.part AND abs(p.lat - q.lat) < 11e-4 AND abs(p.lon - q.lon) < 2e-3)
SELECT a, b, round(m, 4) AS length_m FROM d WHERE m <= 12e1 QUALIFY row_number() OVER (PARTITION BY p1, p2 ORDER BY m, a, b) = 1""")
def gap_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("node"))
    c = F.col("node")
    nodes = k.select("node", (F.lit(-2.5) + (c % 40).cast("double") * 0.0012 + (c % 7).cast("double") * 0.0001).alias("lon"), (F.lit(52.6) + F.floor(c / 40).cast("double") * 0.0009).alias("lat"))
    edges = k.filter("node % 3 = 1").select(c.alias("a"), (c + 1).alias("b")).join(k.select(c.alias("b")), "b")
    return walks.gap_links(nodes, edges, LAT0).select("a", "b", F.round("length_m", 4).alias("length_m"))


@query("""WITH RECURSIVE w AS (SELECT 0 AS walk, 1::BIGINT AS node, 0e0 AS dist_m, []::VARCHAR[] AS streets UNION ALL
  SELECT walk, s_suppkey, dist_m + (1 + s_suppkey % 7)::DOUBLE, CASE WHEN s_suppkey % 5 = 0 OR streets[-1] = 'Road ' || s_suppkey % 3 THEN streets ELSE list_append(streets, 'Road ' || s_suppkey % 3) END FROM w JOIN supplier ON s_suppkey // 2 = node AND s_suppkey > 1)
SELECT node, dist_m, array_to_string(streets, ' > ') AS streets FROM w""")
def shortest_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier", "s_suppkey").filter("s_suppkey > 1")
    street = F.when(k % 5 != 0, F.concat(F.lit("Road "), (k % 3).cast("string")))
    short = s.select(F.floor(k / 2).alias("a"), k.alias("b"), (1 + k % 7).cast("double").alias("length_m"), street.alias("street"))
    long = short.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("length_m") + 0.5).alias("length_m"), F.lit("Byway").alias("street"))
    starts = spark.range(1).select(F.lit(0).alias("walk"), F.lit(1).cast("long").alias("node"), F.lit(0.0).alias("dist_m"))
    return walks.shortest_walks(short.union(long), starts).select("node", "dist_m", F.array_join("streets", " > ").alias("streets"))


def ladder_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the streets of ladders: a rung, then two rails and a rung for each block; twenty streets are a route."""
    r = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("edge"), F.floor(F.col("c_custkey") / 20).alias("route"), (F.col("c_custkey") % 20).alias("i"))
    block, kind = F.floor((F.col("i") + 2) / 3), F.col("i") % 3  # kinds: rung, lower and upper rail
    ends = {"ax": F.when(kind == 0, block).otherwise(block - 1), "ay": (kind == 2).cast("int"), "bx": block, "by": (kind != 1).cast("int")}
    both = r.withColumns(ends).withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))
    pick = lambda one, two: F.when(F.col("forward"), F.col(one)).otherwise(F.col(two))
    both = both.withColumns({"tx": pick("ax", "bx"), "ty": pick("ay", "by"), "hx": pick("bx", "ax"), "hy": pick("by", "ay")})
    name = lambda c: F.col("route") * 100 + F.col(f"{c}x") * 2 + F.col(f"{c}y")
    bearing = F.pmod(F.degrees(F.atan2((F.col("hx") - F.col("tx")).cast("double"), (F.col("hy") - F.col("ty")).cast("double"))) + 360.0, F.lit(360.0))
    none = F.lit(None).cast("double")
    return both.select("route", "edge", "forward", name("t").alias("tail"), name("h").alias("head"), bearing.alias("bearing"), F.concat(F.lit("Road "), (F.col("i") % 5).cast("string")).alias("street"), F.lit(1).alias("homes"), (F.lit(-2.0) + F.col("tx") * 0.001).alias("lon"), (F.lit(52.8) + F.col("ty") * 0.001).alias("lat"), none.alias("start_lon"), none.alias("start_lat"))


@query()
def walk_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.tours(ladder_halves(spark, sf_dir), LAT0)


@query("""WITH r AS (SELECT (c_custkey // 20)::VARCHAR AS route, count(*) AS e FROM customer GROUP BY 1)
SELECT route, 2 * e AS walked, 2 * e AS pavements, 2 * ((e - 1) // 3) AS crossings, (e - 1) // 3 AS back, 1::BIGINT AS parts FROM r""")
def tour_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each block of a ladder is a face, crossed into and back from the face around all
    steps = walks.tours(ladder_halves(spark, sf_dir), LAT0)
    walk, cross = F.col("type") == "walk", F.col("type") == "cross"
    return steps.groupBy("route").agg(F.count_if(walk).alias("walked"), F.countDistinct(F.when(walk, F.struct("edge", "forward"))).alias("pavements"), F.count_if(cross).alias("crossings"), F.count_if(cross & F.col("back")).alias("back"), F.count_if(F.col("type") == "approach").alias("parts"))


@query("""WITH k AS (SELECT o_custkey AS route, o_orderkey AS k FROM orders), s AS (SELECT route, k, CASE WHEN k % 5 = 0 THEN 'cross' WHEN k % 13 = 0 THEN 'approach' ELSE 'walk' END AS type FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY route, type ORDER BY k) = 1 AS first_, sum(CASE WHEN type = 'walk' THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY k) + CASE WHEN type = 'walk' THEN 0 ELSE 1 END AS w FROM s),
u AS (SELECT route, w, k, CASE WHEN type = 'cross' THEN CASE WHEN k % 2 = 0 THEN 'Cross back over ' ELSE 'Cross over ' END || 'Road ' || k % 3 || ' / Mill Lane.'
  WHEN k % 60 > 25 THEN 'Walk to the corner of Road ' || k % 3 || ' and Mill Lane (about ' || (floor((k % 60) / 1e1 + 5e-1) * 10)::BIGINT || ' m, nothing to deliver on the way).' WHEN first_ THEN 'Start at the corner of Road ' || k % 3 || ' and Mill Lane.' END AS said FROM t WHERE type <> 'walk'),
p AS (SELECT route, w, coalesce(string_agg(said, ' ' ORDER BY k), '') AS pre FROM u GROUP BY 1, 2),
a AS (SELECT t.route, k, coalesce(pre, '') AS pre, pre IS NOT NULL AS apart, 'Road ' || k // 2 % 3 AS street, CASE k // 8 % 4 WHEN 0 THEN 'side' WHEN 1 THEN 'both' WHEN 2 THEN 'back' ELSE 'sidedone' END AS pass, (k * 37 % 360)::DOUBLE AS out_, (k * 53 % 360)::DOUBLE AS in_, 2 + k % 3 AS degree, k % 11 = 0 AS uturn FROM t LEFT JOIN p ON p.route = t.route AND p.w = t.w WHERE type = 'walk'),
b AS (SELECT *, lag(street) OVER o AS s0, lag(pass) OVER o AS p0, lag(in_) OVER o AS i0 FROM a WINDOW o AS (PARTITION BY route ORDER BY k)),
c AS (SELECT *, (out_ - i0 + 54e1 + 36e1) % 36e1 - 18e1 AS turn FROM b), d AS (SELECT *, s0 IS NULL OR apart AS fresh, coalesce(s0 = street AND degree >= 3 AND abs(turn) >= 5e1, false) AS fork FROM c),
e AS (SELECT *, sum(CASE WHEN fresh OR (NOT (pass = 'back' AND p0 = 'back') AND (s0 <> street OR uturn OR fork OR p0 <> pass)) THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY k) AS n FROM d),
f AS (SELECT route, n, arg_min(street, k) AS street, arg_min(pass, k) AS pass, arg_min(pre, k) AS pre, arg_min(uturn, k) AS uturn, arg_min(coalesce(s0, ''), k) AS s0, arg_min(coalesce(turn, 999), k) AS turn, arg_min(fork, k) AS fork, arg_min(fresh, k) AS fresh,
  arg_max((k + 5) % 17, k)::DOUBLE * 1e1 - arg_min(k % 13, k)::DOUBLE * 1e1 AS dx, arg_max((k + 3) % 11, k)::DOUBLE * 1e1 - arg_min(k % 7, k)::DOUBLE * 1e1 AS dy, sum((1e1 + k % 50)::DOUBLE) AS length_m,
  sum(CASE pass WHEN 'side' THEN (k % 4) / 2e0 WHEN 'both' THEN (k % 4)::DOUBLE ELSE 0e0 END) AS homes, list(street ORDER BY k) AS all_ FROM e GROUP BY 1, 2),
g AS (SELECT *, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS seen, CASE WHEN sqrt(dx * dx + dy * dy) > greatest(2e1, length_m * 25e-2) THEN (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor(((degrees(atan2(dx, dy)) + 36e1) % 36e1) / 45e0 + 5e-1)::INTEGER % 8) + 1] END AS dir,
  CASE WHEN abs(turn) < 35 THEN 'straight' WHEN abs(turn) > 150 THEN 'round' WHEN turn < 0 THEN 'left' ELSE 'right' END AS way FROM f),
h AS (SELECT *, coalesce(CASE dir WHEN 'N' THEN 'north' WHEN 'NE' THEN 'north-east' WHEN 'E' THEN 'east' WHEN 'SE' THEN 'south-east' WHEN 'S' THEN 'south' WHEN 'SW' THEN 'south-west' WHEN 'W' THEN 'west' WHEN 'NW' THEN 'north-west' END || ' along ' || street, 'round ' || street) AS along,
  CASE WHEN len(seen) = 1 THEN street WHEN len(seen) = 2 THEN seen[1] || ', then ' || seen[2] ELSE seen[1] || ', then ' || seen[2] || ' and ' || seen[3] END AS via FROM g)
SELECT route, n::BIGINT AS n, street, dir, round(homes, 2) AS homes, round(length_m, 2) AS length_m, trim(CASE WHEN pre = '' THEN '' ELSE pre || ' ' END || CASE WHEN pass = 'back' THEN CASE WHEN uturn AND NOT fresh THEN 'At the end of ' || s0 || ', turn round and head back along ' || via || '. Both sides are already done.' ELSE 'Head back along ' || via || ' (already done).' END ELSE
  CASE WHEN fresh AND pre <> '' THEN 'Then ' || CASE pass WHEN 'side' THEN 'walk ' ELSE 'drive ' END || along || '.' WHEN fresh THEN CASE pass WHEN 'side' THEN 'Walk ' ELSE 'Drive ' END || along || '.' WHEN uturn THEN 'At the end of ' || s0 || ', cross over and come back down the other side.'
  WHEN fork AND way = 'straight' THEN 'Carry straight on, staying on ' || street || '.' WHEN fork THEN 'Turn ' || way || ' to stay on ' || street || ' (it branches here).' WHEN way = 'straight' THEN 'Carry straight on into ' || street || '.' WHEN way = 'round' THEN 'Turn round into ' || street || '.' ELSE 'Turn ' || way || ' into ' || street || '.' END
  || CASE pass WHEN 'both' THEN ' Deliver both sides as you go.' WHEN 'sidedone' THEN ' This side''s already been done, so nothing to deliver.' ELSE '' END END) AS cue FROM h""")
def walk_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seq")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seq"))
    kind = F.when(k % 5 == 0, "cross").when(k % 13 == 0, "approach").otherwise("walk")
    num = lambda c: c.cast("double")
    steps = o.select(
        "route", "seq", kind.alias("type"), F.array(F.concat(F.lit("Road "), (k % 3).cast("string")), F.lit("Mill Lane")).alias("streets"), (k % 2 == 0).alias("back"), (k % 11 == 0).alias("uturn"), num(k % 60).alias("dist_m"),
        F.concat(F.lit("Road "), (F.floor(k / 2) % 3).cast("string")).alias("street"), F.element_at(F.array(*map(F.lit, ("side", "both", "back", "sidedone"))), (F.floor(k / 8) % 4 + 1).cast("int")).alias("pass"), num(k % 4).alias("homes"), num(10 + k % 50).alias("length_m"),
        num(k * 37 % 360).alias("out_bearing"), num(k * 53 % 360).alias("in_bearing"), (2 + k % 3).alias("degree"), (num(k % 13) * 10).alias("a_x"), (num(k % 7) * 10).alias("a_y"), (num((k + 5) % 17) * 10).alias("b_x"), (num((k + 3) % 11) * 10).alias("b_y"),
    )
    return walks.walk_legs(steps).select("route", "n", "street", "dir", F.round("homes", 2).alias("homes"), F.round("length_m", 2).alias("length_m"), "cue")
