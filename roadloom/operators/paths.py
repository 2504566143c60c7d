"""Walks between places on a network: where a place joins it, the shortest way, its line and its streets.

A network is edges (edge, a, b, street) and shapes (edge, idx, pos, lon, lat), as ``edges.build_network`` makes them; links over gaps
are edges without a street. Distances relax in rounds that write only what came nearer; a way is read off the relation of what
came before by doubling pointers, so that takes rounds by the logarithm of the longest way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import linear
from roadloom.operators.edges import Network
from roadloom.operators.network import Rounds, large, relaxed
from roadloom.operators.walks import gap_links

def located(points: DataFrame, edges: DataFrame, shapes: DataFrame, lat0: float) -> DataFrame:
    """pt, edge, a, b, street, s, length_m, d, lon, lat: each point (pt, lon, lat) on the edge nearest to it, s metres from a; ties go to the least edge."""
    parts = linear.segments_of(shapes.select("edge", "idx", "pos", "lon", "lat"), ("edge",)).withColumn("seg", F.struct("edge", "seq"))
    hits = linear.nearest_of_any(points, parts.select("seg", "a_lon", "a_lat", "b_lon", "b_lat"), lat0)
    met = hits.select("pt", "t", F.col("dist").alias("d"), F.col("seg.edge").alias("_e"), F.col("seg.seq").alias("_q")).join(large(parts), (F.col("_e") == F.col("edge")) & (F.col("_q") == F.col("seq")))
    length = shapes.groupBy(F.col("edge").alias("_l")).agg(F.max("pos").alias("length_m"))
    on = lambda c: F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("t")
    placed = met.select("pt", "edge", (F.col("from_m") + (F.col("to_m") - F.col("from_m")) * F.col("t")).alias("s"), "d", on("lon").alias("lon"), on("lat").alias("lat"))
    return placed.join(large(length), F.col("edge") == F.col("_l")).drop("_l").join(large(edges.select("edge", "a", "b", "street")), "edge")


def walking_network(network: Network, lat0: float) -> tuple[DataFrame, DataFrame]:
    """edges (edge, a, b, street, length_m) and shapes of a network whose parts are joined over short gaps; the links have no street."""
    rounds = Rounds(network.edges)
    known = network.edges.select("edge", "a", "b", "street")
    links = rounds.write(gap_links(network.nodes, known, lat0).select(F.xxhash64(F.lit("link"), "a", "b").alias("edge"), "a", "b"))
    ends = links.select("edge", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.col("a").alias("node")), F.struct(F.lit(1).alias("idx"), F.col("b").alias("node")))).alias("e")).select("edge", "e.*").join(large(network.nodes), "node")
    drawn = linear.with_places(ends.select("edge", "idx", "lon", "lat"), ("edge",), lat0).select("edge", "idx", "pos", "lon", "lat")
    shapes = rounds.write(network.shapes.select("edge", "idx", "pos", "lon", "lat").union(drawn))
    every = known.unionByName(links.withColumn("street", F.lit(None).cast("string")))
    return rounds.write(every.join(large(shapes.groupBy("edge").agg(F.max("pos").alias("length_m"))), "edge")), shapes


def shortest(edges: DataFrame, starts: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """walk, node, dist_m, prev, edge: the shortest way to every junction a walk reaches, and the junction and edge that it came by.

    edges: edge, a, b, length_m, walked both ways. starts: walk, node, dist_m; there prev and edge are null. Ties go to the least edge.
    See ``network.relaxed``.
    """
    there = edges.select("edge", F.col("a").alias("src"), F.col("b").alias("dst"), "length_m")
    return relaxed(there.union(there.select("edge", "dst", "src", "length_m")), starts, limits=limits)


def chains(ends: DataFrame, reached: DataFrame) -> DataFrame:
    """walk, target, back, node, prev, edge: for each end (walk, target, node) the junctions of its way, back steps before the end, to where it began.

    Ancestors twice as far away are found from those half as far; then every junction of a way brings in the one a power of two
    before it, from the greatest power down, so the rows are those of the ways and no more.
    """
    rounds = Rounds(ends)
    jumps = [rounds.write(reached.filter("prev is not null").select("walk", "node", F.col("prev").alias("up")))]
    while True:
        further = jumps[-1].select(F.col("walk").alias("_w"), F.col("node").alias("_n"), F.col("up").alias("_u"))
        longer = rounds.write(jumps[-1].join(large(further), (F.col("walk") == F.col("_w")) & (F.col("up") == F.col("_n"))).select("walk", "node", F.col("_u").alias("up")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    found = ends.select("walk", "target", F.lit(0).cast("long").alias("back"), "node")
    for k in reversed(range(len(jumps))):
        up = jumps[k].select(F.col("walk").alias("_w"), F.col("node").alias("_n"), F.col("up").alias("_u"))
        more = found.join(large(up), (F.col("walk") == F.col("_w")) & (F.col("node") == F.col("_n"))).select("walk", "target", (F.col("back") + 2**k).alias("back"), F.col("_u").alias("node"))
        found = rounds.write(found.union(more))
    return found.join(large(reached.select("walk", "node", "prev", "edge")), ["walk", "node"])


def ways_to(starts: DataFrame, targets: DataFrame, edges: DataFrame, shapes: DataFrame, reached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ways from each walk's start to its targets: (walk, target, dist_m) and their pieces.

    starts: walk and columns of ``located``; targets: walk, target and those columns; reached: as of ``shortest`` from both ends of
    the start's edge. Pieces: walk, target, seq, edge, street, from_m, to_m (from_m > to_m against the edge's direction). Targets
    that cannot be reached have no rows.
    """
    s = starts.select("walk", *[F.col(c).alias(f"s_{c}") for c in ("edge", "a", "b", "street", "s", "length_m", "d")])
    met = targets.join(large(s), "walk")
    same = met.filter("edge = s_edge")
    direct = same.select("walk", "target", (F.col("s_d") + F.abs(F.col("s_s") - F.col("s")) + F.col("d")).alias("dist_m"))
    other = met.filter("edge <> s_edge")
    end = lambda c, n: reached.select(F.col("walk").alias(f"_w{n}"), F.col("node").alias(f"_n{n}"), F.col("dist_m").alias(n))
    via = other.join(large(end("a", "da")), (F.col("walk") == F.col("_wda")) & (F.col("a") == F.col("_nda"))).join(large(end("b", "db")), (F.col("walk") == F.col("_wdb")) & (F.col("b") == F.col("_ndb")))
    by_a, by_b = F.col("da") + F.col("s"), F.col("db") + F.col("length_m") - F.col("s")
    ended = Rounds(targets).write(via.withColumns({"from_a": by_a <= by_b, "dist_m": F.least(by_a, by_b) + F.col("d")}).drop("_wda", "_nda", "_wdb", "_ndb"))
    chain = chains(ended.select("walk", "target", F.when(F.col("from_a"), F.col("a")).otherwise(F.col("b")).alias("node")), reached)

    length = shapes.groupBy(F.col("edge").alias("_l")).agg(F.max("pos").alias("_m"))
    between = chain.filter("prev is not null").join(large(edges.select("edge", "a", "street")), "edge").join(large(length), F.col("edge") == F.col("_l"))
    forward = F.col("prev") == F.col("a")
    middle = between.select("walk", "target", (-F.col("back")).alias("seq"), "edge", "street", F.when(forward, 0.0).otherwise(F.col("_m")).alias("from_m"), F.when(forward, F.col("_m")).otherwise(0.0).alias("to_m"))
    # where the way leaves the start's edge
    begun = chain.filter("prev is null").select("walk", "target", F.col("node").alias("_first"), (-F.col("back") - 1).alias("seq")).join(large(s), "walk")
    begin = begun.select("walk", "target", "seq", F.col("s_edge").alias("edge"), F.col("s_street").alias("street"), F.col("s_s").alias("from_m"), F.when(F.col("_first") == F.col("s_a"), 0.0).otherwise(F.col("s_length_m")).alias("to_m"))
    last = ended.select("walk", "target", F.lit(1).cast("long").alias("seq"), "edge", "street", F.when(F.col("from_a"), 0.0).otherwise(F.col("length_m")).alias("from_m"), F.col("s").alias("to_m"))
    alone = same.select("walk", "target", F.lit(0).cast("long").alias("seq"), "edge", "street", F.col("s_s").alias("from_m"), F.col("s").alias("to_m"))
    return direct.union(ended.select("walk", "target", "dist_m")), begin.unionByName(middle).unionByName(last).unionByName(alone)


def way_lines(pieces: DataFrame, shapes: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """walk, target, place, lon, lat: the line of each way, from the start over the network to the target.

    starts: walk, and targets: walk, target, with the given point (p_lon, p_lat). A place met twice in a row stands once.
    """
    marked = pieces.withColumn("piece", F.struct("walk", "target", "seq"))
    ends = marked.select("edge", "piece", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("from_m").alias("pos")), F.struct(F.lit(1).alias("k"), F.col("to_m").alias("pos")))).alias("e")).select("edge", "piece", "e.k", F.col("e.pos").alias("pos"))
    cut = linear.points_at(ends, shapes.select("edge", "idx", "pos", "lon", "lat"), ("edge",)).select("piece", F.struct(F.col("k").cast("double").alias("k"), F.lit(0.0).alias("along")).alias("o"), "lon", "lat")
    vertices = shapes.select(F.col("edge").alias("_e"), "pos", "lon", "lat")
    inside = marked.join(large(vertices), F.col("edge") == F.col("_e")).filter((F.col("pos") > F.least("from_m", "to_m")) & (F.col("pos") < F.greatest("from_m", "to_m")))
    inner = inside.select("piece", F.struct(F.lit(0.5).alias("k"), F.when(F.col("to_m") >= F.col("from_m"), F.col("pos")).otherwise(-F.col("pos")).alias("along")).alias("o"), "lon", "lat")
    on = cut.union(inner).select("piece.walk", "piece.target", "piece.seq", "o", "lon", "lat")
    outer = lambda frame, seq, c: frame.select("walk", c, F.lit(seq).cast("long").alias("seq"), F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("along")).alias("o"), F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"))
    known = pieces.select("walk", "target").distinct()
    first = known.join(large(starts.select("walk", "p_lon", "p_lat")), "walk")
    final = known.join(large(targets.select("walk", "target", "p_lon", "p_lat")), ["walk", "target"])
    rows = on.unionByName(outer(first, -(1 << 62), "target")).unionByName(outer(final, 1 << 62, "target"))
    lists = rows.groupBy("walk", "target").agg(F.array_sort(F.collect_list(F.struct("seq", "o", "lon", "lat"))).alias("_p"))
    points = F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    once = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    return lists.select("walk", "target", F.posexplode(once).alias("place", "p")).select("walk", "target", "place", "p.lon", "p.lat")


def way_streets(pieces: DataFrame) -> DataFrame:
    """walk, target, streets: the streets of each way in order, those that follow each other once, links over gaps unnamed."""
    lists = pieces.filter("street is not null").groupBy("walk", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "street"))), lambda x: x["street"]).alias("_s"))
    return lists.select("walk", "target", F.filter("_s", lambda x, i: (i == 0) | (x != F.get(F.col("_s"), i - 1))).alias("streets"))


def start_nodes(starts: DataFrame) -> DataFrame:
    """walk, node, dist_m: both ends of the edge that a walk's start is on."""
    ends = F.array(F.struct(F.col("a").alias("node"), (F.col("d") + F.col("s")).alias("dist_m")), F.struct(F.col("b").alias("node"), (F.col("d") + F.col("length_m") - F.col("s")).alias("dist_m")))
    return starts.select("walk", F.inline(ends))


def route_distances(edges: DataFrame, starts: DataFrame, reached: DataFrame) -> DataFrame:
    """walk, route, dist_m: from each walk's start to the nearest bit of each route. edges: edge, a, b, route (null for other streets)."""
    some = edges.filter("route is not null")
    ends = some.select("edge", "route", F.explode(F.array("a", "b")).alias("node"))
    far = ends.join(large(reached), "node").select("walk", "route", "dist_m")
    own = starts.join(large(some.select("edge", "route")), "edge").select("walk", "route", F.col("d").alias("dist_m"))
    return far.union(own).groupBy("walk", "route").agg(F.min("dist_m").alias("dist_m"))
