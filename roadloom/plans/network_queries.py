"""Queries of the road network with attributes, of lineage and of walks over the driver's tables, each with its SQL.

A customer has a main street of 400 m, which every other one walks westwards, a side street that begins 5 m beside it, and
every fifth one a sliver of 2 m that can be no edge. Orders are homes; a stretch of the main street is done on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_WALK
from roadloom.operators import boxes, directions, edges, events, junctions, lineage, linear, network, paths, tracks
from roadloom.operators.network import Rounds, large
from roadloom.plans.driver_queries import EDGES_SQL, LAT0, _ward_edges, query, table
from roadloom.plans.event_queries import GIVEN_SQL, _given
from roadloom.plans.walk_queries import KX, SEG_SQL, TRACK_SQL, ladder_halves, segments, track_legs


def _lon(x: Column) -> Column:
    """Degrees of longitude of so many metres."""
    return x / (F.lit(X_DEGREE) * F.cos(F.radians(F.lit(LAT0))))


def _spot(k: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A place in metres from a customer's own corner; corners are kilometres apart."""
    return (F.lit(-3.0) + (k % 40) * 0.05 + _lon(x), F.lit(52.0) + F.floor(k / 40) * 0.02 + y / F.lit(Y_WALK))


def street_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road, street, residences, of customer k: 3k the main street, 3k + 1 the side street, 3k + 2 the sliver."""
    k = F.col("c_custkey")
    rows = F.array(
        F.struct((3 * k).alias("road"), F.format_string("Main %d (part 2)", k).alias("street"), (k % 60).cast("double").alias("residences")),
        F.struct((3 * k + 1).alias("road"), F.format_string("Side %d", k).alias("street"), (k % 37).cast("double").alias("residences")),
        F.struct((3 * k + 2).alias("road"), F.format_string("Sliver %d", k).alias("street"), F.when(k % 5 == 0, 1.0 + k % 7).otherwise(0.0).alias("residences")),
    )
    return table(spark, sf_dir, "customer", "c_custkey").select(F.inline(rows))


def street_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road, line, idx, lon, lat."""
    k = F.col("c_custkey")
    at = lambda r, i, x, y: F.struct((3 * k + r).alias("road"), F.lit(i).alias("idx"), x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    main = [at(0, i, F.when(k % 2 == 0, F.lit(100 * i)).otherwise(F.lit(400 - 100 * i)), 0) for i in range(5)]
    side = [at(1, i, 60 + 10 * (k % 25), y) for i, y in enumerate((5, 125))]
    sliver = [F.when(k % 5 == 0, at(2, i, F.lit(200 + 2 * i), 33)) for i in range(2)]
    made = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(F.filter(F.array(*main, *side, *sliver), lambda p: p.isNotNull())).alias("p"))
    lon, lat = _spot(F.col("c_custkey"), F.col("p.x"), F.col("p.y"))
    return made.select("p.road", F.col("p.road").alias("line"), "p.idx", lon.alias("lon"), lat.alias("lat"))


def street_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road, pt, lon, lat: an order's home on its customer's main street, some of them too far off to count."""
    o = F.col("o_orderkey")
    lon, lat = _spot(F.col("o_custkey"), (5 + 10 * ((o * 7919) % 40)).cast("double"), F.when(o % 9 == 0, 40.0).otherwise((o % 4).cast("double")))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((3 * F.col("o_custkey")).alias("road"), o.alias("pt"), lon.alias("lon"), lat.alias("lat"))


def street_half_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """road, piece, side, idx, lon, lat: 131 m of the main street done on one side, seen from either end."""
    k = F.col("c_custkey")
    start = 7 + 40 * (k % 7)
    x = lambda i: (F.when(k % 3 == 0, start + 131 * (1 - i)).otherwise(start + 131 * i)).cast("double")
    made = table(spark, sf_dir, "customer", "c_custkey").select("c_custkey", F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), x(i).alias("x")) for i in range(2)])).alias("p"))
    lon, lat = _spot(F.col("c_custkey"), F.col("p.x"), F.lit(1.0))
    return made.select((3 * F.col("c_custkey")).alias("road"), F.lit(0).alias("piece"), F.when(F.floor(F.col("c_custkey") / 2) % 2 == 0, "S").otherwise("F").alias("side"), "p.idx", lon.alias("lon"), lat.alias("lat"))


#: Of each customer: where the side street meets the main street, and the edges of both, seen from the west.
_STREETS = """c AS (SELECT c_custkey AS k, 60 + 10 * (c_custkey % 25) AS s FROM customer),
home AS (SELECT o_custkey AS k, 5 + 10 * ((o_orderkey * 7919) % 40) AS x FROM orders WHERE o_orderkey % 9 <> 0),
n AS (SELECT k, count(*) FILTER (WHERE x < s) AS west, count(*) AS total FROM home JOIN c USING (k) GROUP BY 1),
e AS (SELECT k, s, 0 AS r, 'w' AS wing, s AS len, s / 2e0 AS mid FROM c UNION ALL SELECT k, s, 0, 'e', 400 - s, (s + 400) / 2e0 FROM c UNION ALL SELECT k, s, 1, 's', 120, NULL FROM c)"""


@query(f"""WITH {_STREETS}, p AS (SELECT *, abs(s - 200) < 33 AS beside, k % 2 = 0 AS east, k % 3 <> 0 AS done_east, (k // 2) % 2 = 0 AS south, 7 + 40 * (k % 7) AS u FROM e),
m AS (SELECT *, r = 0 AND mid >= u - 3 AND mid <= u + 134 AS hit, south = (east = done_east) AS at_right, (r = 1 AND beside) OR (r = 0 AND NOT beside AND (wing = 'w') = (s > 200)) AS takes FROM p)
SELECT 3 * k + r AS road, CASE r WHEN 0 THEN 'Main ' || k ELSE 'Side ' || k END AS street, CASE WHEN (wing = 'w') = east OR r = 1 THEN 0 ELSE 1 END AS place, len::DOUBLE AS length_m,
round(CASE WHEN r = 1 THEN (k % 37)::DOUBLE WHEN n.total > 0 THEN (k % 60) * (CASE wing WHEN 'w' THEN west ELSE n.total - west END) / n.total::DOUBLE ELSE (k % 60) * len / 4e2 END + CASE WHEN k % 5 = 0 AND takes THEN 1 + k % 7 ELSE 0 END, 4) AS residences,
round(CASE r WHEN 0 THEN (k % 60) / 4e-1 ELSE (k % 37) / 12e-2 END, 4) AS per_km, hit AND NOT at_right AS done_left, hit AND at_right AS done_right, CASE WHEN k % 5 = 0 AND takes THEN 'Sliver ' || k ELSE '' END AS includes
FROM m LEFT JOIN n USING (k)""")
def network_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = edges.build_network(street_roads(spark, sf_dir), street_vertices(spark, sf_dir), LAT0, street_homes(spark, sf_dir), street_half_done(spark, sf_dir))
    place = F.when(F.col("a_pos") == 0, 0).otherwise(1)
    return made.edges.select("road", "street", place.alias("place"), F.round("length_m", 2).alias("length_m"), F.round("residences", 4).alias("residences"), F.round("per_km", 4).alias("per_km"), "done_left", "done_right", F.array_join("includes", ", ").alias("includes"))


#: An order is a piece of line, cut from an order of the same customer before it: every other customer's form a chain, the others' a tree.
_CUTS = """n AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
cut AS (SELECT n.k AS line, coalesce(p.k, -n.c) AS parent, n.c, CASE WHEN n.k % 3 = 0 THEN y ELSE x END AS a, CASE WHEN n.k % 3 = 0 THEN x ELSE y END AS b
  FROM (SELECT *, (k % 10) / 41e0 AS x, (k % 10) / 41e0 + 5e-1 + (k % 7) / 29e0 AS y FROM n) n LEFT JOIN n p ON p.c = n.c AND p.i = CASE WHEN n.c % 2 = 0 THEN n.i - 1 ELSE n.i // 2 END),
up(line, root, a, b, cuts) AS (SELECT line, parent, a, b, 1::BIGINT FROM cut UNION ALL SELECT up.line, cut.parent, cut.a + (cut.b - cut.a) * up.a, cut.a + (cut.b - cut.a) * up.b, cuts + 1 FROM up JOIN cut ON cut.line = up.root),
origin AS (SELECT * FROM up WHERE root < 0)"""


def order_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, parent, a, b; the first orders are cut from their customers' own lines, which have negative numbers."""
    k = F.col("k")
    n = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")).withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("k")))
    before = n.select(F.col("c").alias("_c"), F.col("i").alias("_i"), F.col("k").alias("_k"))
    wanted = F.when(F.col("c") % 2 == 0, F.col("i") - 1).otherwise(F.floor(F.col("i") / 2))
    met = n.join(before, (F.col("c") == F.col("_c")) & (wanted == F.col("_i")), "left")
    x, y = (k % 10) / 41.0, (k % 10) / 41.0 + 0.5 + (k % 7) / 29.0
    turned = k % 3 == 0
    return met.select(k.alias("line"), F.coalesce("_k", -F.col("c")).alias("parent"), F.when(turned, y).otherwise(x).alias("a"), F.when(turned, x).otherwise(y).alias("b"))


@query(f"""WITH RECURSIVE {_CUTS} SELECT line, -root AS root, round(a, 9) AS a, round(b, 9) AS b, cuts FROM origin""")
def part_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lineage.origins(order_cuts(spark, sf_dir))
    return made.select("line", (-F.col("root")).alias("root"), F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), "cuts")


@query(f"""WITH RECURSIVE {GIVEN_SQL}, {_CUTS}, piece AS (SELECT -root AS k, line, least(a, b) AS lo, greatest(a, b) AS hi FROM origin WHERE line % 3 = 1),
text AS (SELECT k, string_agg(printf('seg0:%.4f-%.4f:B', lo, hi), '|' ORDER BY line) AS tokens, count(*) AS pieces FROM piece GROUP BY 1)
SELECT m.ward::VARCHAR AS ward, route, m.k::VARCHAR AS road, CASE WHEN pieces IS NULL THEN m.k ELSE m.k + 1000000 END AS row_index, CASE WHEN pieces IS NOT NULL THEN 'Row ' || m.k END AS root_name,
coalesce(tokens, '') AS tokens, CASE WHEN pieces IS NOT NULL THEN CASE WHEN m.k % 4 = 0 THEN '-' ELSE 'seg0:0.1000-0.2000:B' END END AS current_partial FROM m LEFT JOIN text ON text.k = m.k""")
def record_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of given clusters whose roads are parts: a road is made of every third piece of its customer's line."""
    members, links, hubs = _given(spark, sf_dir)
    made = lineage.origins(order_cuts(spark, sf_dir))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer", "c_custkey").select(F.format_string("Row %d", k).alias("road"), (k + 1000000).alias("row_index"), F.array(F.lit("")).alias("fragments"), F.when(k % 4 > 0, "seg0:0.1000-0.2000:B").alias("partial_geometry"), k)
    kept = lineage.captured(rows).withColumns({"line": -(F.col("row_index") - 1000000), "frag": F.lit(0)})
    parts = made.filter("line % 3 = 1").select("line", (-F.col("root")).cast("string").alias("road"), F.col("line").alias("place"))
    full = events.with_extras(members, lineage.part_lineage(parts, made, kept))
    each = events.route_records(full, links, hubs).select("ward", "route", F.explode("roads").alias("r"))
    tokens = F.array_join(lineage.range_tokens(F.coalesce("r.original_ranges", F.array().cast(lineage.RANGES))), "|")
    return each.select("ward", "route", F.col("r.name").alias("road"), "r.row_index", "r.root_name", tokens.alias("tokens"), "r.current_partial")


@query("""WITH f AS (SELECT c_custkey AS root, i AS frag FROM customer, range(7) AS g(i) WHERE i < 1 + c_custkey % 7),
p AS (SELECT o_custkey AS root, o_orderkey AS part, o_orderkey % 5 AS frag, (o_orderkey % 17) / 2e1 AS a, (o_orderkey % 17) / 2e1 + 5e-2 AS b FROM orders WHERE o_orderkey % 5 < 1 + o_custkey % 7 AND o_orderkey % 3 = 0),
one AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY root, frag, a ORDER BY part) = 1),
w AS (SELECT *, lag(b) OVER o AS bb, lead(a) OVER o AS aa FROM one WINDOW o AS (PARTITION BY root, frag ORDER BY a, b, part)),
m AS (SELECT root, part, frag, CASE WHEN bb IS NULL THEN 0e0 WHEN a > bb THEN (bb + a) / 2 ELSE a END AS a, CASE WHEN aa IS NULL THEN 1e0 WHEN aa > b THEN (b + aa) / 2 ELSE b END AS b FROM w),
h AS (SELECT root, frag, min(part) AS owner FROM one GROUP BY ALL), lone AS (SELECT f.root, f.frag FROM f LEFT JOIN h ON h.root = f.root AND h.frag = f.frag WHERE owner IS NULL),
n AS (SELECT lone.root, owner AS part, lone.frag, row_number() OVER (PARTITION BY lone.root, lone.frag ORDER BY abs(lone.frag - h.frag), h.frag) AS r FROM lone JOIN h ON h.root = lone.root)
SELECT root, part, frag::INTEGER AS frag, round(a, 6) AS a, round(b, 6) AS b FROM m UNION ALL SELECT root, part, frag, 0e0, 1e0 FROM n WHERE r = 1""")
def reported_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of rows with up to seven fragments, some of which no part touches; of parts that begin at one place the first counts."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    fragments = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("root"), F.explode(F.sequence(F.lit(0), (k % 7).cast("int"))).alias("frag"))
    a = (o % 17) / 20.0
    ranges = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").filter((o % 3 == 0) & (o % 5 < 1 + F.col("o_custkey") % 7)).groupBy(F.col("o_custkey").alias("root"), (o % 5).cast("int").alias("frag"), a.alias("a"), (a + 0.05).alias("b")).agg(F.min("o_orderkey").alias("part"))
    return lineage.reported_ranges(ranges, fragments).select("root", "part", "frag", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


#: Blocks of twenty-five customers are grids of streets of their own: a row's streets bend by h metres in the middle, a column's are straight.
_GRID = f"""kx AS (SELECT 111320e0 * cos(radians(528e-1)) AS kx), c AS (SELECT c_custkey AS k, c_custkey // 25 AS g, c_custkey % 5 AS x, c_custkey % 25 // 5 AS y, (c_custkey * 31) % 16 AS h FROM customer),
full_ AS (SELECT * FROM c WHERE g IN (SELECT g FROM c GROUP BY 1 HAVING count(*) = 25)),
edge AS (SELECT 2 * k AS edge, g, k AS a, k + 1 AS b, 'Row ' || y AS street, 2 * sqrt(2500e0 + h * h) AS len, h FROM full_ WHERE x < 4 UNION ALL SELECT 2 * k + 1, g, k, k + 5, 'Column ' || x, 1e2 + 10 * ((k * 7) % 13), NULL FROM full_ WHERE y < 4),
both_ AS (SELECT edge, a, b, len FROM edge UNION ALL SELECT edge, b, a, len FROM edge UNION ALL SELECT NULL, k, k, 0e0 FROM full_),
walk AS (SELECT edge.*, g AS walk, (2 + g % 7) / 1e1 * len / 2 AS s FROM edge WHERE edge % 50 = 2 * (g % 4)),
target AS (SELECT edge.*, edge % 50 AS target, (9 - (edge + g) % 8) / 1e1 * len / 2 AS s FROM edge WHERE h IS NOT NULL AND edge % 6 = 0),
r(i, walk, node, d) AS (SELECT 0, walk, k, min(d) FROM (SELECT walk, a AS k, 5 + s AS d FROM walk UNION ALL SELECT walk, b, 5 + len - s FROM walk) GROUP BY ALL UNION ALL SELECT i + 1, walk, b, min(d + len) FROM r JOIN both_ ON a = node WHERE i < 24 GROUP BY ALL),
far AS (SELECT walk, node, min(d) AS d FROM r WHERE i = 24 GROUP BY ALL),
prev AS (SELECT f.walk, f.node, arg_min(p.node, p.d + len) AS up, arg_min(e.edge, p.d + len) AS via, min(p.d + len) AS d FROM far f JOIN both_ e ON e.b = f.node AND e.edge IS NOT NULL JOIN far p ON p.walk = f.walk AND p.node = e.a GROUP BY ALL),
tree AS (SELECT p.* FROM prev p JOIN far f ON f.walk = p.walk AND f.node = p.node AND abs(f.d - p.d) < 1e-7)"""


def _grids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """edges (edge, grid, a, b, street, h) and shapes (edge, idx, lon, lat) of the grids; a column's street makes a detour to be as long as it is."""
    c = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), ((F.col("c_custkey") * 31) % 16).cast("double").alias("h")).withColumns({"g": F.floor(F.col("k") / 25), "x": F.col("k") % 5, "y": F.floor(F.col("k") % 25 / 5)})
    c = c.join(large(c.groupBy("g").count().filter("count = 25").select("g")), "g")
    k, x, y = F.col("k"), F.col("x") * 100.0, F.col("y") * 100.0
    at = lambda px, py: F.struct(px.cast("double").alias("px"), py.cast("double").alias("py"))
    # a detour to one side and back adds twice its depth
    deep = 5.0 * ((k * 7) % 13)
    row = F.struct((2 * k).alias("edge"), (k + 1).alias("b"), F.concat(F.lit("Row "), F.col("y").cast("string")).alias("street"), F.col("h").alias("bend"), F.array(at(x, y), at(x + 50, y + F.col("h")), at(x + 100, y)).alias("p"))
    column = F.struct((2 * k + 1).alias("edge"), (k + 5).alias("b"), F.concat(F.lit("Column "), F.col("x").cast("string")).alias("street"), F.lit(None).cast("double").alias("bend"), F.array(at(x, y), at(x, y + 50), at(x - deep, y + 50), at(x, y + 50), at(x, y + 100)).alias("p"))
    made = c.select("g", F.col("k").alias("a"), F.explode(F.filter(F.array(F.when(F.col("x") < 4, row), F.when(F.col("y") < 4, column)), lambda e: e.isNotNull())).alias("e")).select("g", "a", "e.*")
    vertices = made.select("g", "edge", F.posexplode("p").alias("idx", "v"))
    lon, lat = _grid_spot(F.col("g"), F.col("v.px"), F.col("v.py"))
    return made.select("edge", F.col("g").alias("grid"), "a", "b", "street", "bend"), vertices.select("edge", "idx", lon.alias("lon"), lat.alias("lat"))


def _grid_spot(g: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return (F.lit(-3.0) + (g % 40) * 0.02 + _lon(x), F.lit(52.0) + F.floor(g / 40) * 0.02 + y / F.lit(Y_WALK))


def _beside(edges_: DataFrame, share: Column) -> DataFrame:
    """edges with lon, lat of a point five metres beside the first half of a row's street, at a share of it."""
    k, g = F.col("a"), F.col("grid")
    size = F.sqrt(2500.0 + F.col("bend") * F.col("bend"))
    px = (k % 5) * 100.0 + 50.0 * share - F.col("bend") / size * 5.0
    py = F.floor(k % 25 / 5) * 100.0 + F.col("bend") * share + 50.0 / size * 5.0
    lon, lat = _grid_spot(g, px, py)
    return edges_.withColumns({"lon": lon, "lat": lat})


def grid_walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """edges, shapes, starts, targets and what the walks reach: a start for each grid, and a target beside every third of its rows' streets."""
    rounds = Rounds(spark.range(1))
    known, vertices = _grids(spark, sf_dir)
    known, shapes = rounds.write(known), rounds.write(linear.with_places(vertices, ("edge",), LAT0))
    place = F.col("edge") % 50
    starts = _beside(known.filter(place == 2 * (F.col("grid") % 4)), (2 + F.col("grid") % 7) / 10.0).select(F.struct(F.col("grid").alias("walk"), F.lit(-1).cast("long").alias("target")).alias("pt"), "lon", "lat")
    targets = _beside(known.filter("bend is not null and edge % 6 = 0"), (9 - (F.col("edge") + F.col("grid")) % 8) / 10.0).select(F.struct(F.col("grid").alias("walk"), place.alias("target")).alias("pt"), "lon", "lat")
    asked = rounds.write(starts.union(targets))
    met = paths.located(asked, known, shapes, LAT0).withColumnsRenamed({"lon": "on_lon", "lat": "on_lat"}).join(large(asked.withColumnsRenamed({"pt": "_pt", "lon": "p_lon", "lat": "p_lat"})), F.col("pt") == F.col("_pt"))
    placed = rounds.write(met.select("pt.walk", "pt.target", "edge", "a", "b", "street", "s", "length_m", "d", "p_lon", "p_lat"))
    begun = placed.filter("target = -1").drop("target")
    sized = known.join(large(shapes.groupBy("edge").agg(F.max("pos").alias("length_m"))), "edge")
    return known, shapes, begun, placed.filter("target <> -1"), rounds.write(paths.shortest(sized, paths.start_nodes(begun)))


@query(f"""WITH RECURSIVE {_GRID}, w AS (SELECT t.walk, t.target, t.street AS ts, t.s, t.len, f.d AS da, f2.d AS db, f.d + t.s <= f2.d + t.len - t.s AS from_a, t.a, t.b, t.edge, x.edge AS se, x.a AS sa, x.street AS ss, x.s AS s_s FROM (SELECT *, g AS walk FROM target) t JOIN walk x ON x.walk = t.walk
  JOIN far f ON f.walk = t.walk AND f.node = t.a JOIN far f2 ON f2.walk = t.walk AND f2.node = t.b),
way(walk, target, node, streets) AS (SELECT walk, target, CASE WHEN from_a THEN a ELSE b END, [ts] FROM w WHERE edge <> se
  UNION ALL SELECT way.walk, way.target, up, CASE WHEN edge.street = streets[1] THEN streets ELSE list_prepend(edge.street, streets) END FROM way JOIN tree ON tree.walk = way.walk AND tree.node = way.node JOIN edge ON edge.edge = via),
done AS (SELECT way.* FROM way LEFT JOIN tree ON tree.walk = way.walk AND tree.node = way.node WHERE tree.node IS NULL)
SELECT w.walk, w.target, round(CASE WHEN edge = se THEN 10 + abs(s_s - s) ELSE least(da + s, db + len - s) + 5 END, 3) AS dist_m,
  array_to_string(CASE WHEN edge = se THEN [ts] WHEN streets[1] = ss THEN streets ELSE list_prepend(ss, streets) END, ' > ') AS streets, round(CASE WHEN edge = se THEN 10 + abs(s_s - s) ELSE least(da + s, db + len - s) + 5 END, 3) AS line_m FROM w LEFT JOIN done ON done.walk = w.walk AND done.target = w.target""")
def network_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks in grids of streets with cycles: their lengths, their streets, and the lengths of the lines that are drawn."""
    known, shapes, starts, targets, reached = grid_walks(spark, sf_dir)
    ways, pieces = paths.ways_to(starts, targets, known, shapes, reached)
    pieces = Rounds(pieces).write(pieces)
    lines = linear.with_places(paths.way_lines(pieces, shapes, starts, targets).withColumnRenamed("place", "idx"), ("walk", "target"), LAT0).groupBy("walk", "target").agg(F.round(F.max("pos"), 3).alias("line_m"))
    return ways.join(large(paths.way_streets(pieces)), ["walk", "target"]).join(large(lines), ["walk", "target"]).select("walk", "target", F.round("dist_m", 3).alias("dist_m"), F.array_join("streets", " > ").alias("streets"), "line_m")


@query(f"""WITH RECURSIVE {_GRID}, e AS (SELECT g AS walk, edge % 7 AS route, a, b, edge FROM edge WHERE edge % 7 < 4)
SELECT walk, route, round(min(d), 3) AS dist_m FROM (SELECT e.walk, route, d FROM e JOIN far ON far.walk = e.walk AND far.node IN (e.a, e.b) UNION ALL SELECT e.walk, route, 5e0 FROM e JOIN walk ON walk.edge = e.edge) GROUP BY ALL""")
def network_route_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances over the network from each grid's start to four routes of its streets."""
    known, _, starts, _, reached = grid_walks(spark, sf_dir)
    route = F.col("edge") % 7
    return paths.route_distances(known.withColumn("route", F.when(route < 4, route)), starts, reached).select("walk", "route", F.round("dist_m", 3).alias("dist_m"))


#: Orders are covered boxes and customers requests, of sizes from some hundred metres to half a degree, at places that repeat.
_BOXES = """cov AS (SELECT o_orderkey AS id, x - w AS min_lon, y - w AS min_lat, x + w AS max_lon, y + w AS max_lat FROM (SELECT o_orderkey, (o_orderkey * 7919) % 1009 / 1e2 - 5 AS x, 50 + (o_orderkey * 104729) % 887 / 1e2 AS y, 1e-3 * pow(2, o_orderkey % 9) AS w FROM orders)),
req AS (SELECT c_custkey AS id, x - w AS min_lon, y - w AS min_lat, x + w * CASE WHEN c_custkey % 23 = 0 THEN -1 ELSE 1 END AS max_lon, y + w AS max_lat FROM (SELECT c_custkey, (c_custkey * 7919) % 1009 / 1e2 - 5 + (c_custkey % 3) * 1e-4 AS x, 50 + (c_custkey * 104729) % 887 / 1e2 AS y, 5e-4 * pow(2, c_custkey % 11) AS w FROM customer))"""


def _order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x, y, w = (k * 7919) % 1009 / 100.0 - 5, 50 + (k * 104729) % 887 / 100.0, F.lit(0.001) * F.pow(F.lit(2.0), k % 9)
    return table(spark, sf_dir, "orders", "o_orderkey").select(k.alias("id"), (x - w).alias("min_lon"), (y - w).alias("min_lat"), (x + w).alias("max_lon"), (y + w).alias("max_lat"))


def _customer_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y, w = (k * 7919) % 1009 / 100.0 - 5 + (k % 3) * 0.0001, 50 + (k * 104729) % 887 / 100.0, F.lit(0.0005) * F.pow(F.lit(2.0), k % 11)
    return table(spark, sf_dir, "customer", "c_custkey").select(k.alias("id"), (x - w).alias("min_lon"), (y - w).alias("min_lat"), (x + w * F.when(k % 23 == 0, -1).otherwise(1)).alias("max_lon"), (y + w).alias("max_lat"))


@query(f"""WITH {_BOXES} SELECT r.id AS request, count(*) AS boxes, min(c.id) AS least FROM req r JOIN cov c ON c.min_lat <= r.min_lat AND c.min_lon <= r.min_lon AND c.max_lat >= r.max_lat AND c.max_lon >= r.max_lon WHERE r.id % 23 <> 0 GROUP BY 1""")
def boxes_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = boxes.containing(_customer_boxes(spark, sf_dir).filter("id % 23 <> 0"), _order_boxes(spark, sf_dir))
    return met.groupBy(F.col("inner_id").alias("request")).agg(F.count("*").alias("boxes"), F.min("outer_id").alias("least"))


@query(f"""WITH {_BOXES}, poi AS (SELECT s_suppkey AS k, (s_suppkey * 7919) % 1009 / 1e2 - 5 AS lon, 50 + (s_suppkey * 104729) % 887 / 1e2 AS lat FROM supplier),
half AS (SELECT * FROM cov WHERE id % 16 < 4), ok AS (SELECT DISTINCT r.id FROM req r JOIN half c ON c.min_lat <= r.min_lat AND c.min_lon <= r.min_lon AND c.max_lat >= r.max_lat AND c.max_lon >= r.max_lon WHERE r.id % 23 <> 0),
rest AS (SELECT r.*, CASE WHEN min_lon >= max_lon THEN 'bbox out of range' WHEN max_lat - min_lat > 6e-1 OR max_lon - min_lon > 6e-1 THEN 'bbox larger than 0.6 degrees' END AS reason FROM req r WHERE id NOT IN (SELECT id FROM ok)),
ask AS (SELECT * FROM rest WHERE reason IS NULL), sw AS (SELECT DISTINCT i.id FROM ask i JOIN ask o ON i.id <> o.id AND o.min_lat <= i.min_lat AND o.min_lon <= i.min_lon AND o.max_lat >= i.max_lat AND o.max_lon >= i.max_lon
  AND (o.id < i.id OR NOT (i.min_lat <= o.min_lat AND i.min_lon <= o.min_lon AND i.max_lat >= o.max_lat AND i.max_lon >= o.max_lon)))
SELECT r.id AS request, 'answer ' || k AS what FROM req r JOIN ok ON ok.id = r.id JOIN poi ON lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon
UNION ALL SELECT id, 'fetch' FROM ask WHERE id NOT IN (SELECT id FROM sw) UNION ALL SELECT id, reason FROM rest WHERE reason IS NOT NULL""")
def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against a cache that covers a quarter of the boxes, suppliers as its points."""
    k = F.col("s_suppkey")
    pois = table(spark, sf_dir, "supplier", "s_suppkey").select(k.cast("string").alias("name"), ((k * 7919) % 1009 / 100.0 - 5).alias("lon"), (50 + (k * 104729) % 887 / 100.0).alias("lat"))
    answers, fetch, refused = boxes.read_through(_customer_boxes(spark, sf_dir), _order_boxes(spark, sf_dir).filter("id % 16 < 4"), pois)
    out = answers.select(F.col("box").alias("request"), F.concat(F.lit("answer "), "name").alias("what"))
    return out.union(fetch.select("id", F.lit("fetch"))).union(refused.select("id", "reason"))


@query("""SELECT s_suppkey AS route, CASE s_suppkey % 10 WHEN 3 THEN 'geometry: a point without a place' WHEN 7 THEN 'network: no street is long enough' WHEN 9 THEN 'start: no place to start from' ELSE 'planned' END AS what,
CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN round((s_suppkey % 60 + s_suppkey % 37)::DOUBLE, 3) END AS homes, CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN 1040e0 END AS walk_m, CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN 30e0 END AS transfer_m,
CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN 520e0 END AS road_m, CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN 1::BIGINT END AS junctions, CASE WHEN s_suppkey % 10 NOT IN (3, 7, 9) THEN 1::BIGINT END AS components FROM supplier""")
def route_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as routes of a main street and a side street; one in ten has a broken line, one only a sliver, one no start."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier", "s_suppkey")
    lon, lat = _spot(k, F.lit(0.0), F.lit(-30.0))
    known = k % 10 != 9
    routes = s.select(k.alias("route"), F.lit("walk").alias("kind"), F.when(known, lon).alias("start_lon"), F.when(known, lat).alias("start_lat"), F.lit("Inn").alias("start_label"), F.lit("hub").alias("start_kind"))
    roads = s.select(k.alias("route"), F.inline(F.array(F.struct((2 * k).alias("road"), F.lit("Main Street").alias("street"), (k % 60).cast("double").alias("residences")), F.struct((2 * k + 1).alias("road"), F.lit("Side Street").alias("street"), (k % 37).cast("double").alias("residences")))))
    size = F.when(k % 10 == 7, 0.005).otherwise(1.0)
    at = lambda r, i, x, y: F.struct((2 * k + r).alias("road"), F.lit(i).alias("idx"), (x * size).alias("x"), F.when((k % 10 == 3) & F.lit(i == 1), float("nan")).otherwise(y * size).alias("y"))
    points = [at(0, i, F.lit(100.0 * i), F.lit(0.0)) for i in range(5)] + [at(1, i, 60.0 + 10.0 * (k % 25), F.lit(float(y))) for i, y in enumerate((5, 125))]
    made = s.select(k.alias("route"), F.explode(F.array(*points)).alias("p"))
    lon, lat = _spot(F.col("route"), F.col("p.x"), F.col("p.y"))
    vertices = made.select("route", "p.road", F.col("p.road").alias("line"), "p.idx", lon.alias("lon"), lat.alias("lat"))
    done = directions.add_directions(routes, roads, vertices, LAT0)
    planned = done.stats.select("route", F.lit("planned").alias("what"), F.round("homes", 3).alias("homes"), *[F.round(c, 1).alias(c) for c in ("walk_m", "transfer_m", "road_m")], "junctions", "components")
    return planned.unionByName(done.errors.select("route", F.concat_ws(": ", "stage", "reason").alias("what")), allowMissingColumns=True)


@query(f"""WITH RECURSIVE {SEG_SQL}, {EDGES_SQL}, hub AS (SELECT ward, min(a_lon) - 1e-3 - (ward % 3) * 5e-3 AS lon, min(a_lat) AS lat FROM seg WHERE k % 4 = 1 GROUP BY 1),
q AS (SELECT k, seg.ward, a_lon, a_lat, b_lon - a_lon AS dx, b_lat - a_lat AS dy, lon, lat FROM seg JOIN hub ON hub.ward = seg.ward WHERE k % 4 > 0),
p AS (SELECT *, least(greatest(((lon - a_lon) * dx + (lat - a_lat) * dy) / (dx * dx + dy * dy), 0e0), 1e0) AS t FROM q),
crow AS (SELECT k, ward, min(sqrt(((lon - a_lon - dx * t) * {KX}) ** 2 + ((lat - a_lat - dy * t) * 111320e0) ** 2)) AS d FROM p GROUP BY 1, 2),
entry AS (SELECT k, d FROM crow WHERE d <= 25e1 UNION ALL SELECT k, d FROM crow WHERE ward NOT IN (SELECT ward FROM crow WHERE d <= 25e1) QUALIFY row_number() OVER (PARTITION BY ward ORDER BY d, k) = 1),
hop AS (SELECT src, dst, 1e0 + dst % 60 AS len FROM (SELECT src, dst FROM pair UNION SELECT dst, src FROM pair) WHERE src % 4 > 0 AND dst % 4 > 0 UNION ALL SELECT k, k, 0e0 FROM crow),
r(i, k, d) AS (SELECT 0, k, d FROM entry UNION ALL SELECT i + 1, dst, min(d + len) FROM r JOIN hop ON src = k WHERE i < 40 GROUP BY ALL), far AS (SELECT k, min(d) AS d FROM r GROUP BY 1)
SELECT crow.k AS road, ward AS hub, round(coalesce(far.d, crow.d), 3) AS dist_m FROM crow LEFT JOIN far ON far.k = crow.k""")
def hub_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of a nation from a hub near its western ones, or, every third, half a kilometre and more away from all; every fourth road is missing."""
    r, links = _ward_edges(spark, sf_dir)
    lines = segments(spark, sf_dir).filter("k % 4 > 0")
    of = r.filter("k % 4 > 0").select(F.col("k").alias("road"), F.col("ward").alias("hub"), (1.0 + F.col("k") % 60).alias("length_m"))
    first = lines.filter("k % 4 = 1").join(of, F.col("k") == F.col("road")).groupBy("hub").agg(F.min("a_lon").alias("_x"), F.min("a_lat").alias("lat"))
    hubs = first.select("hub", (F.col("_x") - 0.001 - (F.col("hub") % 3) * 0.005).alias("lon"), "lat")
    made = network.hub_distances(of, lines.withColumnRenamed("k", "road").select("road", "a_lon", "a_lat", "b_lon", "b_lat"), links, hubs, LAT0)
    return made.select("road", "hub", F.round("dist_m", 3).alias("dist_m"))


@query(f"""WITH {TRACK_SQL}, w AS (SELECT event_id AS q, event_id % 25 AS track, (event_id % 997)::DOUBLE * 4e-1 AS a, (event_id % 997)::DOUBLE * 4e-1 + (event_id % 61)::DOUBLE * 5e0 AS b FROM events WHERE event_id % 7 = 0),
m AS (SELECT q, leg.seq, n, greatest(a, start_m) - start_m AS x, least(b, start_m + len) - start_m AS y, len, a_lon, a_lat, b_lon, b_lat, a <= start_m AS whole, lag(b_lon) OVER o AS p_lon, lag(b_lat) OVER o AS p_lat
  FROM (SELECT * FROM (SELECT *, lag(seq) OVER (PARTITION BY track ORDER BY seq) AS before FROM leg)) leg JOIN w ON w.track = leg.track WINDOW o AS (PARTITION BY q ORDER BY leg.seq))
SELECT q, seq, n, round(CASE WHEN whole AND p_lon IS NOT NULL THEN p_lon ELSE a_lon + (b_lon - a_lon) * x / len END, 7) AS from_lon, round(CASE WHEN whole AND p_lat IS NOT NULL THEN p_lat ELSE a_lat + (b_lat - a_lat) * x / len END, 7) AS from_lat,
round(a_lon + (b_lon - a_lon) * y / len, 7) AS to_lon, round(a_lat + (b_lat - a_lat) * y / len, 7) AS to_lat FROM m WHERE y > x""")
def track_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of tracks between two positions, a line for each piece; a piece that is covered from its beginning starts where the one before ended."""
    e = F.col("event_id")
    start = (e % 997).cast("double") * 0.4
    wanted = table(spark, sf_dir, "events", "event_id").filter(e % 7 == 0).select(e.alias("q"), (e % 25).cast("int").alias("track"), start.alias("from_m"), (start + (e % 61).cast("double") * 5.0).alias("to_m"))
    legs = track_legs(spark, sf_dir)
    vertices = legs.select("track", "seq", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit(0.0).alias("pos"), F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat")), F.struct(F.lit(1).alias("idx"), F.col("length_m").alias("pos"), F.col("b_lon").alias("lon"), F.col("b_lat").alias("lat")))).alias("v")).select("track", "seq", "v.*")
    lines = tracks.slices(wanted, legs, vertices)
    end = lambda f, c: f(F.struct("place", c))[c]
    out = lines.groupBy("q", "seq", "n").agg(*[F.round(end(f, c), 7).alias(f"{name}_{c}") for name, f in (("from", F.min), ("to", F.max)) for c in ("lon", "lat")])
    return out.select("q", "seq", "n", "from_lon", "from_lat", "to_lon", "to_lat")


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS edge, c_custkey // 20 AS route, (c_custkey % 20 + 2) // 3 AS block, c_custkey % 20 % 3 AS kind FROM customer),
e AS (SELECT edge, route, CASE kind WHEN 0 THEN block ELSE block - 1 END AS ax, (kind = 2)::INTEGER AS ay, block AS bx, (kind <> 1)::INTEGER AS by_ FROM r),
h AS (SELECT edge, true AS f, route, ax AS tx, ay AS ty, bx AS hx, by_ AS hy FROM e UNION ALL SELECT edge, false, route, bx, by_, ax, ay FROM e),
b AS (SELECT *, (degrees(atan2((hx - tx)::DOUBLE, (hy - ty)::DOUBLE)) + 36e1) % 36e1 AS turn FROM h),
o AS (SELECT *, coalesce(lead([edge, f::INTEGER]) OVER w, first_value([edge, f::INTEGER]) OVER w) AS nx FROM b WINDOW w AS (PARTITION BY route, tx, ty ORDER BY turn)),
n AS (SELECT route, [edge, (NOT f)::INTEGER] AS half, nx FROM o), walk(route, start, half, n) AS (SELECT route, half, nx, 1 FROM n UNION ALL SELECT walk.route, start, n.nx, walk.n + 1 FROM walk JOIN n ON n.half = walk.half WHERE walk.half <> start),
size AS (SELECT route, n FROM walk WHERE half = start) SELECT route, n::BIGINT AS halves, (count(*) // n)::BIGINT AS faces FROM size GROUP BY route, n""")
def face_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many faces of each size the ladders of ``ladder_halves`` have."""
    halves = ladder_halves(spark, sf_dir)
    found = junctions.faces(halves).join(halves.select("edge", "route").distinct(), "edge")
    return found.groupBy("route", "face").agg(F.count("*").alias("halves")).groupBy("route", "halves").agg(F.count("*").alias("faces"))
