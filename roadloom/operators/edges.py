"""The road network with what its roads carry: homes left, sides already done, and roads too short to be edges.

Edges are ranges of the roads' lines. Homes are points and stretches done on one side are lines of their own along the
same roads: both are referred to the edges through grid cells of their own road, and sides are turned by
the sign of the two directions of travel. Nothing gathers a network, and no road is compared edge by edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo, text
from roadloom.operators import junctions, linear
from roadloom.operators.network import Rounds, large
from roadloom.operators.routes import without_near_vertices

#: Vertices nearer than this to the last one go; lines shorter than the least edge are none.
VERTEX_M = 0.3
#: A home counts on the edge it is within so many metres of; a stretch is beside an edge within so many of its middle.
HOME_M, SIDE_M, LOOK_M = 15.0, 3.0, 2.0


@dataclass(frozen=True)
class Network:
    """edges: edge, road, street, line, a, b, a_pos, b_pos, length_m, residences, per_km, done_left, done_right, includes.

    shapes: edge, road, line, idx, pos, lon, lat, the vertices from junction to junction. nodes: node, lon, lat. lost: road, street
    of roads with homes that have no vertex to find an edge by.
    """

    nodes: DataFrame
    edges: DataFrame
    shapes: DataFrame
    lost: DataFrame


def network_lines(vertices: DataFrame, lat0: float) -> DataFrame:
    """road, line, idx, pos, lon, lat of vertices (road, line, idx, lon, lat) without repeated vertices and very short lines."""
    keys = [c for c in ("net", "road", "line") if c in vertices.columns]
    points = vertices.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda v: geo.point(v["lon"], v["lat"])).alias("_p"))
    thinned = points.select(*keys, F.posexplode(without_near_vertices(F.col("_p"), VERTEX_M, F.lit(lat0), geo.Y_WALK)).alias("idx", "_v")).select(*keys, "idx", "_v.lon", "_v.lat")
    placed = linear.with_places(thinned, ("road", "line"), lat0)
    total = F.max("pos").over(Window.partitionBy("road", "line"))
    return placed.withColumn("_t", total).filter(F.col("_t") >= junctions.LEAST_EDGE_M).select(*keys, "idx", "pos", "lon", "lat")


def edge_shapes(edges: DataFrame, lines: DataFrame, nodes: DataFrame, lat0: float) -> DataFrame:
    """edge, idx, pos, lon, lat: every edge from one junction's point over its line's vertices to the other's."""
    inner = linear.inner_vertices(edges.select("line", "edge", "a_pos", "b_pos"), lines.select("line", "pos", "lon", "lat"), ("line",), "edge")
    ends = edges.select("edge", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a_pos").alias("at")), F.struct(F.col("b").alias("node"), F.col("b_pos").alias("at")))).alias("e")).select("edge", "e.node", "e.at")
    met = ends.join(large(nodes), "node").select("edge", F.col("at").alias("pos"), "lon", "lat")
    order = Window.partitionBy("edge").orderBy("pos")
    numbered = met.unionByName(inner).select("edge", (F.row_number().over(order) - 1).alias("idx"), "lon", "lat")
    return linear.with_places(numbered, ("edge",), lat0)


def by_length(edges: DataFrame, roads: DataFrame) -> DataFrame:
    """Adds residences and per_km: a road's homes (road, residences) spread by length over the edges that it has."""
    kept = F.sum("length_m").over(Window.partitionBy("road"))
    return edges.join(large(roads.select("road", F.col("residences").alias("_all"))), "road").withColumns({"residences": F.col("_all") * F.col("length_m") / kept, "per_km": F.col("_all") / kept * 1000}).drop("_all")


def by_homes(edges: DataFrame, segments: DataFrame, homes: DataFrame, roads: DataFrame, lat0: float) -> DataFrame:
    """edges with residences by the homes that stand on each edge of their road, where any does.

    homes: road, pt, lon, lat. A home between two edges is on the first.
    """
    hits = linear.nearest_of_own(homes, segments, ("road",), lat0, HOME_M)
    counts = hits.groupBy(F.col("seg.edge").alias("_e")).agg(F.count("*").alias("_n"))
    counted = edges.join(large(counts), F.col("edge") == F.col("_e"), "left").join(large(roads.select("road", F.col("residences").alias("_all"))), "road").withColumn("_n", F.coalesce("_n", F.lit(0)))
    total = F.sum("_n").over(Window.partitionBy("road"))
    return counted.withColumn("_total", total).withColumn("residences", F.when(F.col("_total") > 0, F.col("_all") * F.col("_n") / F.col("_total")).otherwise(F.col("residences"))).drop("_e", "_n", "_all", "_total")


def done_sides(shapes: DataFrame, half_done: DataFrame, lat0: float) -> DataFrame:
    """edge, done_left, done_right: sides, as seen along an edge, that a stretch beside the edge's middle was done on.

    shapes: road, edge, idx, pos, lon, lat. half_done: road, piece, side (S is right of the stretch's direction, others left), idx, lon, lat.
    """
    middle = shapes.groupBy("road", "edge").agg(F.max("pos").alias("_l"))
    asked = middle.select("road", "edge", F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), F.least(F.col("_l"), F.col("_l") / 2 + by).alias("pos")) for n, by in (("mid", 0.0), ("on", LOOK_M))])).alias("a")).select("road", "edge", "a.*")
    spots = linear.points_at(asked, shapes.select("road", "edge", "idx", "pos", "lon", "lat"), ("road", "edge"))
    spot = lambda n: F.max(F.when(F.col("_n") == n, F.struct("lon", "lat")))
    mids = spots.groupBy("road", "edge").agg(spot("mid").alias("mid"), spot("on").alias("on"))

    placed = linear.with_places(half_done, ("road", "piece", "side"), lat0)
    pieces = linear.segments_of(placed, ("road", "piece", "side")).withColumn("seg", F.struct("seq"))
    hits = linear.nearest_of_own(mids.select("road", F.col("edge").alias("pt"), "mid.lon", "mid.lat"), pieces, ("road",), lat0, SIDE_M, ("piece", "side"))
    around = hits.select("road", "piece", "side", F.col("pt").alias("edge"), F.explode(F.array(*[F.struct(F.lit(n).alias("_n"), (F.col("at_m") + by).alias("pos")) for n, by in (("from", -LOOK_M), ("to", LOOK_M))])).alias("a")).select("road", "piece", "side", "edge", "a.*")
    seen = linear.points_at(around, placed.select("road", "piece", "side", "idx", "pos", "lon", "lat"), ("road", "piece", "side"))
    ways = seen.groupBy("road", "piece", "side", "edge").agg(spot("from").alias("p"), spot("to").alias("q"))

    met = ways.join(large(mids), ["road", "edge"])
    ux, uy = linear.metre_vector(F.col("mid.lon"), F.col("mid.lat"), F.col("on.lon"), F.col("on.lat"), lat0)
    vx, vy = linear.metre_vector(F.col("p.lon"), F.col("p.lat"), F.col("q.lon"), F.col("q.lat"), lat0)
    right = (F.col("side") == "S") == (ux * vx + uy * vy >= 0)
    return met.groupBy("edge").agg(F.bool_or(~right).alias("done_left"), F.bool_or(right).alias("done_right"))


def handed_on(roads: DataFrame, vertices: DataFrame, edges: DataFrame, segments: DataFrame, lat0: float) -> tuple[DataFrame, DataFrame]:
    """Homes of roads without an edge for the edge nearest to their first vertex: (edge, residences, includes), and lost roads (road, street)."""
    alone = roads.filter("residences > 0").join(large(edges.select("road").distinct()), "road", "left_anti")
    first = vertices.groupBy("road").agg(F.min(F.struct("line", "idx", "lon", "lat")).alias("v"))
    net = ["net"] if "net" in roads.columns else []
    placed = Rounds(roads).write(alone.join(large(first), "road", "left").select("road", "street", "residences", "v.lon", "v.lat", *net))
    seen = placed.filter("lon is not null")
    asked = segments.join(large(roads.select("road", "net")), "road") if net else segments
    hits = linear.nearest_of_any(seen.select(F.col("road").alias("pt"), "lon", "lat", *net), asked.drop("road"), lat0, bool(net))
    given = hits.join(large(seen), F.col("pt") == F.col("road")).groupBy(F.col("seg.edge").alias("edge")).agg(F.sum("residences").alias("more"), F.array_sort(F.collect_list(F.struct("road", "street"))).alias("_s"))
    named = given.select("edge", "more", F.transform("_s", lambda s: text.base_name(s["street"])).alias("includes"))
    return named, placed.filter("lon is null").select("road", "street")


def edge_halves(network: Network, lat0: float) -> DataFrame:
    """edge, forward, tail, head, bearing, lon, lat (of the tail), head_lon, head_lat: every edge both ways, with its bearing over the first 15 metres (at most half of it)."""
    shape = network.shapes.select("edge", "idx", "pos", "lon", "lat")
    size = shape.groupBy("edge").agg(F.max("pos").alias("_l"))
    reach = F.least(F.lit(junctions.BEARING_M), F.col("_l") / 2)
    asked = size.select("edge", F.explode(F.array(*[F.struct(F.lit(f).alias("forward"), F.lit(n).alias("_n"), at.alias("pos")) for f, n, at in ((True, "s", F.lit(0.0)), (True, "t", reach), (False, "s", F.col("_l")), (False, "t", F.col("_l") - reach))])).alias("q")).select("edge", "q.*")
    spots = linear.points_at(asked, shape, ("edge",))
    spot = lambda f, n: F.max(F.when((F.col("forward") == f) & (F.col("_n") == n), F.struct("lon", "lat")))
    both = spots.groupBy("edge").agg(*[spot(f, n).alias(f"{n}_{f}") for f in (True, False) for n in "st"]).join(large(network.edges.select("edge", "a", "b")), "edge")
    half = lambda f, tail, head: F.struct(F.lit(f).alias("forward"), F.col(tail).alias("tail"), F.col(head).alias("head"), F.col(f"s_{f}").alias("s"), F.col(f"t_{f}").alias("t"), F.col(f"s_{not f}").alias("h"))
    met = both.select("edge", F.explode(F.array(half(True, "a", "b"), half(False, "b", "a"))).alias("x")).select("edge", "x.*")
    turn = geo.bearing(F.col("s.lon"), F.col("s.lat"), F.col("t.lon"), F.col("t.lat"), F.lit(lat0))
    return met.select("edge", "forward", "tail", "head", turn.alias("bearing"), "s.lon", "s.lat", F.col("h.lon").alias("head_lon"), F.col("h.lat").alias("head_lat"))


def build_network(roads: DataFrame, vertices: DataFrame, lat0: float, homes: DataFrame | None = None, half_done: DataFrame | None = None) -> Network:
    """The network of roads (road, street, residences) and their vertices (road, line, idx, lon, lat; a line is of one road).

    Residences of a road are spread over its edges by length, or by its known homes; roads with homes that have no edge
    give them to the edge nearest to them. The sum over edges is that of the roads, but for the lost ones. If roads and vertices have a
    column net, each of its values is a network of its own.
    """
    rounds = Rounds(roads)
    lines = rounds.write(network_lines(vertices, lat0))
    placed = rounds.write(junctions.junctions(lines.drop("road"), lat0))
    owner = lines.select("line", "road").distinct()
    cut = rounds.write(junctions.network_edges(placed).join(large(owner), "line"))
    nodes = placed.select("node", "lon", "lat").distinct()
    shapes = rounds.write(edge_shapes(cut, lines, nodes, lat0).join(large(cut.select("edge", "road", "line", "a_pos")), "edge"))
    segments = rounds.write(linear.segments_of(shapes, ("road", "edge", "line", "a_pos")).select("road", F.struct("line", "a_pos", "seq", "edge").alias("seg"), "from_m", "a_lon", "a_lat", "b_lon", "b_lat"))
    edges = by_length(cut, roads)
    if homes is not None:
        edges = by_homes(edges, segments, homes, roads, lat0)
    if half_done is not None:
        edges = edges.join(large(done_sides(shapes, half_done, lat0)), "edge", "left")
    else:
        edges = edges.withColumns({"done_left": F.lit(False), "done_right": F.lit(False)})
    given, lost = handed_on(roads, vertices, cut, segments, lat0)
    full = edges.join(large(given), "edge", "left").join(large(roads.select("road", text.base_name(F.col("street")).alias("street"))), "road")
    out = full.select(
        "edge", "road", "street", "line", "a", "b", "a_pos", "b_pos", "length_m", (F.col("residences") + F.coalesce("more", F.lit(0.0))).alias("residences"), "per_km",
        F.coalesce("done_left", F.lit(False)).alias("done_left"), F.coalesce("done_right", F.lit(False)).alias("done_right"), F.coalesce("includes", F.array().cast("array<string>")).alias("includes"),
    )
    # without any edge nobody takes the homes of the others, and they are not lost but unplanned
    return Network(nodes, out, shapes, lost)
