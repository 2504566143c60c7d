"""Directions of all routes of a payload: each route's own streets as a network, the tour of its pavements, its legs and their sentences.

A route that can't be planned has no directions, and that is all: every stage sends what it can't use to a second table with
the route, the stage and the reason, and no row raises. Routes never meet, however near their streets are to each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_WALK, metres
from roadloom.operators import edges, paths, walks
from roadloom.operators.network import Rounds

#: Drive routes: below so many homes a kilometre both sides are delivered in one pass.
SPARSE_PER_KM = 30.0


@dataclass(frozen=True)
class Directions:
    """legs: route, n, type (leg or transfer), and for legs street, cue, homes, length_m, dir, side, pavement, already_done, end_cue.

    stats: route, steps, homes, walk_m, transfer_m, road_m, crossings, junctions, components. errors: route, stage, reason.
    steps: route, seq, type, edge, forward, … as of ``walks.tours``. network: of all routes, see ``edges.build_network``.
    """

    legs: DataFrame
    stats: DataFrame
    errors: DataFrame
    steps: DataFrame
    network: edges.Network


def _usable(routes: DataFrame, roads: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """routes that have a start and streets of numbers, and why the others don't."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    placed = vertices.groupBy("route").agg(F.count_if(~(number("lon") & number("lat"))).alias("_bad"))
    lines = vertices.groupBy("route", "line").agg(F.count("*").alias("_n")).filter("_n > 1").select("route").distinct().withColumn("_line", F.lit(True))
    many = roads.groupBy("route").agg(F.count("*").alias("_roads"))
    met = routes.join(many, "route", "left").join(placed, "route", "left").join(lines, "route", "left")
    started = F.coalesce(number("start_lon") & number("start_lat"), F.lit(False))
    reason = (
        F.when(F.col("_roads").isNull(), F.struct(F.lit("roads").alias("stage"), F.lit("no roads").alias("reason")))
        .when(F.col("_line").isNull(), F.struct(F.lit("geometry").alias("stage"), F.lit("no line of two points").alias("reason")))
        .when(F.col("_bad") > 0, F.struct(F.lit("geometry").alias("stage"), F.lit("a point without a place").alias("reason")))
        .when(~started, F.struct(F.lit("start").alias("stage"), F.lit("no place to start from").alias("reason")))
    )
    judged = met.withColumn("_why", reason)
    return judged.filter("_why is null").select(routes.columns), judged.filter("_why is not null").select("route", "_why.stage", "_why.reason")


def with_walk_ins(toured: DataFrame, halves: DataFrame, routes: DataFrame, around: edges.Network, lat0: float) -> DataFrame:
    """toured with the ways to each part of a route over the streets around: their lengths as dist_m, and their streets as via.

    A way goes from the route's start, or from where the part before began. One that is absurdly longer than the straight line, or none at all, leaves that.
    """
    rounds = Rounds(toured)
    place = halves.groupBy("route", F.col("tail").alias("node")).agg(F.min(F.struct("lon", "lat")).alias("to"))
    parts = toured.filter("type = 'approach'").select("route", "seq", "node").join(place, ["route", "node"]).join(routes.select("route", F.struct(F.col("start_lon").alias("lon"), F.col("start_lat").alias("lat")).alias("_s")), "route")
    before = F.lag("to").over(Window.partitionBy("route").orderBy("seq"))
    asked = rounds.write(parts.select(F.struct("route", "seq").alias("walk"), F.coalesce(before, F.col("_s")).alias("from"), "to"))
    straight = metres(F.col("from.lon"), F.col("from.lat"), F.col("to.lon"), F.col("to.lat"), F.lit(lat0), Y_WALK)
    limits = asked.select("walk", straight.alias("straight_m"), (3 * straight + 300).alias("most_m"))
    ways, shapes = paths.walking_network(around, lat0)
    points = asked.select("walk", F.explode(F.array(*[F.struct(F.lit(n).cast("long").alias("target"), F.col(c).alias("p")) for n, c in ((-1, "from"), (0, "to"))])).alias("x"))
    placed = rounds.write(paths.located(points.select(F.struct("walk", "x.target").alias("pt"), "x.p.lon", "x.p.lat"), ways, shapes, lat0).select("pt.walk", "pt.target", "edge", "a", "b", "street", "s", "length_m", "d"))
    begun, ended = placed.filter("target = -1").drop("target"), placed.filter("target = 0")
    reached = rounds.write(paths.shortest(ways, paths.start_nodes(begun), limits))
    found, pieces = paths.ways_to(begun, ended, ways, shapes, reached)
    walked = found.join(paths.way_streets(pieces), ["walk", "target"], "left").join(limits, "walk").filter("dist_m <= most_m")
    better = walked.select(F.col("walk.route").alias("_r"), F.col("walk.seq").alias("_q"), F.col("dist_m").alias("_d"), F.col("streets").alias("_via"))
    met = toured.join(better, (F.col("route") == F.col("_r")) & (F.col("seq") == F.col("_q")), "left")
    return met.withColumns({"dist_m": F.coalesce("_d", "dist_m"), "via": F.coalesce("_via", F.array().cast("array<string>"))}).drop("_r", "_q", "_d", "_via")


def add_directions(routes: DataFrame, roads: DataFrame, vertices: DataFrame, lat0: float, homes: DataFrame | None = None, half_done: DataFrame | None = None, around: edges.Network | None = None) -> Directions:
    """Directions of routes (route, kind, start_lon, start_lat, start_label, start_kind: parking, spot, hub or me).

    roads: route, road (unique), street, residences; vertices: route, road, line (unique), idx, lon, lat of the roads' lines; homes: road, pt, lon,
    lat; half_done: road, piece, side, idx, lon, lat; around: the network of all streets near, over which walks to a route's parts go. A route of kind drive delivers both sides of sparse roads in one pass.
    """
    rounds = Rounds(routes)
    sound, broken = _usable(routes, roads, vertices)
    sound = rounds.write(sound)
    own = lambda frame: frame.join(sound.select("route"), "route", "left_semi").withColumn("net", F.col("route"))
    lines, streets = own(vertices).drop("route"), rounds.write(own(roads))
    network = edges.build_network(streets.drop("route"), lines, lat0, homes, half_done)
    network = edges.Network(network.nodes, rounds.write(network.edges), network.shapes, network.lost)
    route_of = streets.select("road", "route")
    known = network.edges.join(route_of, "road").join(sound.select("route", (F.col("kind") == "drive").alias("drive")), "route")
    flat = sound.join(known.select("route").distinct(), "route", "left_anti").select("route", F.lit("network").alias("stage"), F.lit("no street is long enough").alias("reason"))
    known = rounds.write(known.withColumn("sparse", F.col("drive") & (F.col("per_km") < SPARSE_PER_KM)))

    halves = edges.edge_halves(network, lat0).join(known.select("route", "edge", "street", F.col("residences").alias("homes")), "edge")
    halves = rounds.write(halves.join(sound.select("route", "start_lon", "start_lat"), "route"))
    toured = rounds.write(walks.tours(halves, lat0))
    if around is not None:
        toured = rounds.write(with_walk_ins(toured, halves, sound, around, lat0))
    steps = _told(toured, halves, known, sound, lat0)
    steps = rounds.write(steps)
    walk = walks.walk_legs(steps)
    far = steps.filter((F.col("type") == "approach") & (F.col("dist_m") > walks.NEAR_START_M))
    legs = walk.withColumn("type", F.lit("leg")).unionByName(far.select("route", F.lit("transfer").alias("type"), F.col("dist_m").alias("length_m")), allowMissingColumns=True)
    return Directions(legs, _stats(legs, steps, known), broken.unionByName(flat), steps, network)


def _told(toured: DataFrame, halves: DataFrame, known: DataFrame, routes: DataFrame, lat0: float) -> DataFrame:
    """Steps with all that their sentences need."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    sized = halves.withColumn("degree", F.count("*").over(Window.partitionBy("route", "tail")))
    # one arrives the way one would set out back
    turned = F.sum("bearing").over(Window.partitionBy("edge")) - F.col("bearing")
    places = {"a_x": F.col("lon") * x, "a_y": F.col("lat") * Y_WALK, "b_x": F.col("head_lon") * x, "b_y": F.col("head_lat") * Y_WALK}
    ways = sized.withColumn("in_bearing", F.pmod(turned + 180, F.lit(360.0))).withColumns(places).select(F.col("edge").alias("_e"), F.col("forward").alias("_f"), F.col("bearing").alias("out_bearing"), "in_bearing", "degree", *places)
    attributes = known.select(F.col("edge").alias("_k"), "street", "sparse", "done_left", "done_right", "includes", "length_m", F.col("residences").alias("homes"))
    met = toured.join(ways, (F.col("edge") == F.col("_e")) & (F.col("forward") == F.col("_f")), "left").join(attributes, F.col("edge") == F.col("_k"), "left")
    # tours with the road on the left walk the pavement on the right of travel
    right_done = F.when(F.col("forward"), F.col("done_right")).otherwise(F.col("done_left"))
    met = walks.passes(met.withColumn("right", F.lit(True)), F.coalesce("sparse", F.lit(False)), F.coalesce(right_done, F.lit(False)))
    quiet = known.groupBy("route", "street").agg(F.bool_and("sparse").alias("_quiet")).filter("_quiet").groupBy(F.col("route").alias("_r")).agg(F.collect_set("street").alias("_streets"))
    parts = toured.filter("type = 'approach'").groupBy(F.col("route").alias("_p")).agg(F.count("*").cast("int").alias("parts"))
    of = routes.select(F.col("route").alias("_o"), (F.col("kind") == "drive").alias("drive"), F.col("start_label").alias("label"), "start_kind")
    full = met.join(quiet, F.col("route") == F.col("_r"), "left").join(parts, F.col("route") == F.col("_p"), "left").join(of, F.col("route") == F.col("_o"))
    silent = F.coalesce(F.size(F.array_except("streets", "_streets")) == 0, F.lit(False))
    return full.withColumns({"quiet": silent, "one_sided": F.coalesce(F.col("done_left") | F.col("done_right"), F.lit(False)), "includes": F.coalesce("includes", F.array().cast("array<string>"))}).drop("_e", "_f", "_k", "_r", "_p", "_o", "_streets", "sparse", "done_left", "done_right")


def _stats(legs: DataFrame, steps: DataFrame, known: DataFrame) -> DataFrame:
    leg = F.col("type") == "leg"
    told = legs.groupBy("route").agg(F.count_if(leg).alias("steps"), F.sum(F.when(leg, F.col("homes"))).alias("homes"), F.sum(F.when(leg, F.col("length_m"))).alias("walk_m"), F.coalesce(F.sum(F.when(~leg, F.col("length_m"))), F.lit(0.0)).alias("transfer_m"))
    turns = F.col("uturn") & (F.col("pass") == "side") & ~F.coalesce("_after", F.lit(True))
    # turning round at an end crosses the road, unless a crossing or a walk-in has just been told
    before = F.lag(F.col("type") != "walk").over(Window.partitionBy("route").orderBy("seq"))
    crossed = steps.filter("type <> 'cross' or not quiet").withColumn("_after", before).groupBy("route").agg(F.count_if((F.col("type") == "cross") | turns).alias("crossings"), F.count_if(F.col("type") == "approach").alias("components"))
    ends = known.select("route", "length_m", F.explode(F.array("a", "b")).alias("node"))
    roads = known.groupBy("route").agg(F.sum("length_m").alias("road_m"))
    busy = ends.groupBy("route", "node").agg(F.count("*").alias("_n")).groupBy("route").agg(F.count_if(F.col("_n") > 2).alias("junctions"))
    return told.join(crossed, "route").join(roads, "route").join(busy, "route").select("route", "steps", "homes", "walk_m", "transfer_m", "road_m", "crossings", "junctions", "components")
