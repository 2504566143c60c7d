"""The junction graph of a road network, and the faces that its streets enclose.

Lines are vertex rows (line, idx, lon, lat, pos), and net where lines of several networks must not meet. All steps are joins on grid
cells, windows over one line or one junction, and rounds of joins; nothing gathers a network in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_WALK, bearing, metres, on_segment
from roadloom.operators.linear import points_at
from roadloom.operators.network import Rounds, connected, large
from roadloom.operators.spatial import segment_cells

SAME_M, TOUCH_M, UNION_M = 1.5, 20.0, 12.0
LEAST_EDGE_M, LEAST_LOOP_M = 3.0, 36.0
NEAR_CUT_M, SAME_NODE_M = 0.5, 24.0
BEARING_M = 15.0


def _grid(lon: Column, lat: Column, lat0: float, size_m: float) -> tuple[Column, Column]:
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    return F.floor(lon * x / size_m).cast("long"), F.floor(lat * F.lit(Y_WALK) / size_m).cast("long")


def _around(frame: DataFrame, lat0: float, size_m: float) -> DataFrame:
    cx, cy = _grid(F.col("lon"), F.col("lat"), lat0, size_m)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return frame.withColumn("_o", F.explode(steps)).withColumn("_cx", cx + F.col("_o.i")).withColumn("_cy", cy + F.col("_o.j")).drop("_o")


def _netted(vertices: DataFrame) -> DataFrame:
    return vertices if "net" in vertices.columns else vertices.withColumn("net", F.lit(0))


def line_ends(vertices: DataFrame) -> DataFrame:
    """line, pos, lon, lat of the first and the last vertex of each line."""
    both = vertices.groupBy("line").agg(*[f(F.struct("idx", "pos", "lon", "lat")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
    return both.select("line", F.explode(F.array("a", "b")).alias("e")).select("line", "e.pos", "e.lon", "e.lat")


def shared_vertices(vertices: DataFrame, lat0: float) -> DataFrame:
    """line, pos, lon, lat, spot: vertices in a cell of 1.5 m where two or more lines have one, the first of each line."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    cell = F.struct(F.round(F.col("lon") * x / SAME_M).alias("x"), F.round(F.col("lat") * F.lit(Y_WALK) / SAME_M).alias("y"))
    first = _netted(vertices).withColumn("spot", F.struct("net", cell.alias("cell"))).groupBy("spot", "line").agg(F.min(F.struct("idx", "pos", "lon", "lat")).alias("m"))
    several = first.groupBy("spot").agg(F.count("*").alias("_n")).filter("_n > 1")
    return first.join(large(several), "spot").select("line", "m.pos", "m.lon", "m.lat", "spot")


def touching_ends(vertices: DataFrame, lat0: float) -> DataFrame:
    """line, end_pos, other, pos, lon, lat: for each end of a line the nearest place of another line within 20 m."""
    along = Window.partitionBy("line").orderBy("idx")
    vertices = _netted(vertices)
    segments = vertices.select(F.col("net").alias("_net"), F.col("line").alias("other"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), F.col("pos").alias("a_pos"), F.lead("lon").over(along).alias("b_lon"), F.lead("lat").over(along).alias("b_lat"), F.lead("pos").over(along).alias("b_pos")).filter("b_lon is not null")
    spread = segment_cells(segments, lat0, TOUCH_M)
    nets = vertices.groupBy(F.col("line").alias("_line")).agg(F.min("net").alias("net"))
    ends = _around(line_ends(vertices).withColumnRenamed("pos", "end_pos").join(large(nets), F.col("line") == F.col("_line")).drop("_line"), lat0, TOUCH_M)
    met = ends.join(large(spread), (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")) & (F.col("net") == F.col("_net")) & (F.col("line") != F.col("other")))
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    place = F.struct(dist.alias("d"), F.col("other"), (F.col("a_pos") + (F.col("b_pos") - F.col("a_pos")) * t).alias("pos"), (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * t).alias("lon"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * t).alias("lat"))
    best = met.select("line", "end_pos", place.alias("m")).filter(F.col("m.d") <= TOUCH_M).groupBy("line", "end_pos").agg(F.min("m").alias("m"))
    # both ends of a short stub near one place of another line would make it a loop of no length: only the nearer one joins
    hits = best.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("end_pos", "m"))).alias("_h"))
    a, b = F.get("_h", F.lit(0)), F.get("_h", F.lit(1))
    stub = (a["m"]["other"] == b["m"]["other"]) & (F.abs(a["m"]["pos"] - b["m"]["pos"]) < SAME_NODE_M)
    kept = F.when(stub & (a["m"]["d"] <= b["m"]["d"]), F.array(a)).when(stub, F.array(b)).otherwise(F.col("_h"))
    return hits.select("line", F.explode(kept).alias("h")).select("line", "h.end_pos", "h.m.other", "h.m.pos", "h.m.lon", "h.m.lat")


def junctions(vertices: DataFrame, lat0: float) -> DataFrame:
    """line, pos, node, lon, lat: places of lines that belong to a junction, with the junction's mean point.

    Places are line ends, shared vertices and places that ends of other lines touch; those joined outright and
    those within 12 m are one junction.
    """
    rounds = Rounds(vertices)
    hits = touching_ends(vertices, lat0)
    places = line_ends(vertices).unionByName(shared_vertices(vertices, lat0).drop("spot")).unionByName(hits.select(F.col("other").alias("line"), "pos", "lon", "lat"))
    nets = _netted(vertices).groupBy(F.col("line").alias("_line")).agg(F.min("net").alias("net"))
    once = places.withColumn("pos", F.round("pos", 3)).groupBy("line", "pos").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat")).withColumn("place", F.xxhash64("line", "pos"))
    once = rounds.write(once.join(large(nets), F.col("line") == F.col("_line")).drop("_line"))
    name = lambda line, pos: F.xxhash64(line, F.round(pos, 3))
    cells = _grid(F.col("lon"), F.col("lat"), lat0, UNION_M)
    other = once.select(F.col("net").alias("_net"), F.col("place").alias("_p"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), cells[0].alias("_x"), cells[1].alias("_y"))
    near = _around(once, lat0, UNION_M).join(large(other), (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")) & (F.col("net") == F.col("_net")) & (F.col("place") != F.col("_p")))
    close = near.filter(metres(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"), F.lit(lat0), Y_WALK) <= UNION_M).select(F.col("place").alias("src"), F.col("_p").alias("dst"))
    joined = hits.select(name(F.col("line"), F.col("end_pos")).alias("src"), name(F.col("other"), F.col("pos")).alias("dst"))
    edges = close.union(joined).union(joined.select("dst", "src")).distinct()
    labels = connected(once.select(F.col("place").alias("node")), rounds.write(edges)).withColumnsRenamed({"node": "place", "component": "node"})
    placed = once.join(large(labels), "place")
    return placed.join(large(placed.groupBy("node").agg(F.avg("lon").alias("node_lon"), F.avg("lat").alias("node_lat"))), "node").select("line", "pos", "node", F.col("node_lon").alias("lon"), F.col("node_lat").alias("lat"))


def network_edges(placed: DataFrame) -> DataFrame:
    """edge, line, a, b, a_pos, b_pos, length_m between consecutive junctions of a line.

    A place very near the last one kept, or soon after it at the same junction, is skipped, but a line's end
    replaces it. Very short edges and small loops go.
    """
    item = F.struct("pos", "node")
    lists = placed.groupBy("line").agg(F.array_sort(F.collect_list(item)).alias("cuts"))
    end = F.element_at("cuts", -1)["pos"]

    def keep(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        skip = (x["pos"] - last["pos"] < NEAR_CUT_M) | ((x["node"] == last["node"]) & (x["pos"] - last["pos"] < SAME_NODE_M))
        put = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))
        return F.when(F.size(acc) == 0, F.array(x)).when(skip & (x["pos"] == end) & (F.size(acc) > 1), put).when(skip, acc).otherwise(F.concat(acc, F.array(x)))

    kept = lists.withColumn("kept", F.aggregate("cuts", F.array().cast("array<struct<pos:double,node:bigint>>"), keep))
    pairs = kept.filter(F.size("kept") > 1).select("line", F.explode(F.transform(F.slice("kept", F.lit(1), F.size("kept") - 1), lambda x, i: F.struct(x.alias("a"), F.get("kept", i + 1).alias("b")))).alias("e"))
    out = pairs.select("line", F.col("e.a.node").alias("a"), F.col("e.b.node").alias("b"), F.col("e.a.pos").alias("a_pos"), F.col("e.b.pos").alias("b_pos")).withColumn("length_m", F.col("b_pos") - F.col("a_pos"))
    long = (F.col("length_m") >= LEAST_EDGE_M) & ((F.col("a") != F.col("b")) | (F.col("length_m") >= LEAST_LOOP_M))
    return out.filter(long).withColumn("edge", F.xxhash64("line", "a_pos"))


def half_edges(edges: DataFrame, vertices: DataFrame, lat0: float) -> DataFrame:
    """edge, forward, tail, head, bearing: each edge both ways, with its bearing over the first 15 metres (at most half the edge)."""
    both = edges.withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))
    reach = F.least(F.lit(BEARING_M), F.col("length_m") / 2)
    both = both.withColumn("_from", F.when(F.col("forward"), F.col("a_pos")).otherwise(F.col("b_pos"))).withColumn("_to", F.when(F.col("forward"), F.col("a_pos") + reach).otherwise(F.col("b_pos") - reach))
    asked = both.select("line", "edge", "forward", F.explode(F.array(F.struct(F.lit("s").alias("_n"), F.col("_from").alias("pos")), F.struct(F.lit("t").alias("_n"), F.col("_to").alias("pos")))).alias("q")).select("line", "edge", "forward", "q.*")
    spots = points_at(asked, vertices.select("line", "idx", "pos", "lon", "lat"), ("line",))
    spot = lambda n: F.max(F.when(F.col("_n") == n, F.struct("lon", "lat"))).alias(n)
    placed = both.join(large(spots.groupBy("edge", "forward").agg(spot("s"), spot("t"))), ["edge", "forward"])
    turn = bearing(F.col("s.lon"), F.col("s.lat"), F.col("t.lon"), F.col("t.lat"), F.lit(lat0))
    return placed.select("edge", "forward", F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("tail"), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("head"), turn.alias("bearing"))


def faces(halves: DataFrame) -> DataFrame:
    """edge, forward, face: half-edges that follow each other round a face have its least half-edge as name.

    After a half-edge comes the one next to its reverse, clockwise, at the junction it arrives at. Names double
    their reach in each round, so rounds grow with the logarithm of the longest face.
    """
    rounds = Rounds(halves)
    name = lambda forward: F.xxhash64("edge", forward)
    around = Window.partitionBy("tail").orderBy("bearing", "half")
    first = F.first("half").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    named = halves.withColumn("half", name(F.col("forward"))).withColumn("back", name(~F.col("forward")))
    # the half-edge after the reverse of h in rotation follows h; so whose reverse is h', that is h'.back
    follows = named.select(F.col("back").alias("half"), F.coalesce(F.lead("half").over(around), first).alias("next"))
    state = rounds.write(follows.withColumn("face", F.least("half", "next")))
    while True:
        ahead = state.select(F.col("half").alias("_h"), F.col("next").alias("_n"), F.col("face").alias("_f"))
        after = rounds.write(state.join(large(ahead), F.col("next") == F.col("_h")).select("half", F.col("_n").alias("next"), F.least("face", "_f").alias("low"), "face"))
        changed = not after.filter("low <> face").isEmpty()
        state = after.select("half", "next", F.col("low").alias("face"))
        if not changed:
            break
    return named.select("edge", "forward", "half").join(large(state.select("half", "face")), "half").select("edge", "forward", "face")
