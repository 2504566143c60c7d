"""Nearest-neighbour joins by grid cells: an equality join on cells, never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_PLAN, Y_WALK, metres, on_segment
from roadloom.operators.network import Rounds, large

#: Vertices that a vertex's cell may hold on average, and the least part of the widest ring that is searched first.
CROWD, LEAST_SHARE = 8, 1 / 4096


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def cell_of(lon: Column, lat: Column, lat0: float, size_m: float) -> tuple[Column, Column]:
    """The cell of a point among squares of ``size_m`` metres, as ``segment_cells`` numbers them."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    return F.floor(lon * x / size_m).cast("long"), F.floor(lat * F.lit(Y_WALK) / size_m).cast("long")


def neighbours(frame: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    """Each row nine times, with the cells (_cx, _cy) around its own."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = frame.withColumn("_o", F.explode(around))
    return spread.withColumn("_cx", cell(F.col(lon), size) + F.col("_o.i")).withColumn("_cy", cell(F.col(lat), size) + F.col("_o.j")).drop("_o")


def nearest_vertices(ends: DataFrame, vertices: DataFrame, lat0: float, most_m: float = 50.0, size: float = 0.001) -> DataFrame:
    """end, road, other, dist: for each end of a road the nearest vertex of another road within ``most_m``.

    ends: end, road, lon, lat. vertices: road, lon, lat. Ties go to the lesser name. A cell has to be at least
    as wide as ``most_m`` at the latitude. Where vertices are dense, ends look within narrower rings first, with cells as
    narrow, and only those that find none go on to the next: a hit within the ring that was searched is certainly the nearest.
    """
    rounds = Rounds(ends)
    spot = Window.partitionBy("_lon", "_lat").orderBy("other")
    named = vertices.select(F.col("road").alias("other"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat")).distinct()
    # of the roads that share a spot, an end can only take the first, or the second if the first is its own
    placed = rounds.write(named.withColumn("_n", F.row_number().over(spot)).filter("_n <= 2").drop("_n"))
    share = _ring_share(placed, size)
    found, left = None, rounds.write(ends.select("end", "road", "lon", "lat"))
    while True:
        hits = rounds.write(_nearest_within(left, placed, lat0, most_m * share, size * share))
        found = hits if found is None else found.union(hits)
        if share >= 1:
            return found
        done = large(hits.select(F.col("end").alias("_end"), F.col("road").alias("_road")))
        left = rounds.write(left.join(done, F.col("end").eqNullSafe(F.col("_end")) & (F.col("road") == F.col("_road")), "left_anti"))
        if left.isEmpty():
            return found
        share *= 2


def _ring_share(placed: DataFrame, size: float) -> float:
    """The part, a power of two, of the widest ring that leaves a vertex's cell with few others."""
    share = 1.0
    while share > LEAST_SHARE:
        cells = placed.groupBy(cell(F.col("_lon"), size * share), cell(F.col("_lat"), size * share)).count()
        if (cells.agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0) <= CROWD:
            break
        share /= 2
    return share


def _nearest_within(ends: DataFrame, placed: DataFrame, lat0: float, most_m: float, size: float) -> DataFrame:
    spread = neighbours(ends, "lon", "lat", size)
    cells = placed.select("*", cell(F.col("_lon"), size).alias("_x"), cell(F.col("_lat"), size).alias("_y"))
    met = spread.join(large(cells), (F.col("_cx") == F.col("_x")) & (F.col("_cy") == F.col("_y")) & (F.col("road") != F.col("other")))
    dist = metres(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat"), F.lit(lat0), Y_PLAN)
    # the least of a struct combines before the shuffle, so a crowded cell does not meet in one task
    best = met.select("end", "road", F.struct(dist.alias("dist"), "other").alias("m")).filter(F.col("m.dist") <= most_m).groupBy("end", "road").agg(F.min("m").alias("m"))
    return best.select("end", "road", F.col("m.other").alias("other"), F.col("m.dist").alias("dist"))


def adjacency(nearest: DataFrame) -> DataFrame:
    """src, dst in both directions, each once."""
    pairs = nearest.select(F.col("road").alias("src"), F.col("other").alias("dst"))
    return pairs.union(pairs.select("dst", "src")).distinct()


def crossed_cells(frame: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column], size: Column | float, reach: Column | float = 0.0) -> DataFrame:
    """Each row once for each cell (_sx, _sy) that its segment from a to b comes within ``reach`` of; all in metres.

    Column by column of cells, only the rows that the segment has there: a long diagonal stands in as many cells as
    its length holds, not in all of its bounding box.
    """
    size, reach = (x if isinstance(x, Column) else F.lit(float(x)) for x in (size, reach))
    cells = lambda u, v: F.sequence(F.floor((F.least(u, v) - reach) / size).cast("long"), F.floor((F.greatest(u, v) + reach) / size).cast("long"))
    spread = frame.withColumn("_sx", F.explode(cells(a[0], b[0])))
    dx, dy = b[0] - a[0], b[1] - a[1]
    at = lambda x: F.when(F.abs(dx) > 1e-9, a[1] + dy * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a[0]) / dx)))
    left, right = at(F.col("_sx") * size - reach), at((F.col("_sx") + 1) * size + reach)
    return spread.withColumn("_sy", F.explode(cells(F.coalesce(left, a[1]), F.coalesce(right, b[1]))))


def segment_cells(segments: DataFrame, lat0: float, size_m: float, reach_m: float = 0.0) -> DataFrame:
    """Each segment once for each square cell of ``size_m`` metres that it comes within ``reach_m`` of."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    end = lambda e: (F.col(f"{e}_lon") * x, F.col(f"{e}_lat") * F.lit(Y_WALK))
    return crossed_cells(segments, end("a"), end("b"), size_m, reach_m)


def nearest_segments(points: DataFrame, segments: DataFrame, lat0: float, most_m: float, net: bool = False) -> DataFrame:
    """pt, seg, t, dist: for each point the nearest segment within ``most_m``; ties, distances that are equal in micrometres, go to the lesser seg.

    points: pt, lon, lat. segments: seg, a_lon, a_lat, b_lon, b_lat. With ``net``, both have such a column, and only equal ones meet.
    """
    if not net:
        points, segments = points.withColumn("net", F.lit(0)), segments.withColumn("net", F.lit(0))
    segments = segments.withColumnRenamed("net", "_net")
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    placed = points.withColumn("_o", F.explode(around))
    placed = placed.select("pt", "net", "lon", "lat", (F.floor(F.col("lon") * x / most_m).cast("long") + F.col("_o.i")).alias("_cx"), (F.floor(F.col("lat") * F.lit(Y_WALK) / most_m).cast("long") + F.col("_o.j")).alias("_cy"))
    met = placed.join(large(segment_cells(segments, lat0, most_m)), (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")) & (F.col("net") == F.col("_net")))
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    best = met.select("pt", F.struct(F.round(dist, 6).alias("near"), F.col("seg"), t.alias("t"), dist.alias("dist")).alias("m")).filter(F.col("m.dist") <= most_m).groupBy("pt").agg(F.min("m").alias("m"))
    return best.select("pt", F.col("m.seg").alias("seg"), F.col("m.t").alias("t"), F.col("m.dist").alias("dist"))


def match_homes(points: DataFrame, segments: DataFrame, lat0: float, near_m: float = 40.0, far_m: float = 250.0) -> DataFrame:
    """The nearest segment within the near radius, else within the far one, with ``far`` telling which."""
    # a micrometre more, so that a segment just beyond the radius ties with one just within it
    near = nearest_segments(points, segments, lat0, near_m + 1e-6)
    rest = points.join(near.select(F.col("pt").alias("_pt")), F.col("pt") == F.col("_pt"), "left_anti")
    far = nearest_segments(rest, segments, lat0, far_m)
    return near.unionByName(far).withColumn("far", F.col("dist") > near_m)


def without_commercial_spots(points: DataFrame, most: int = 150) -> DataFrame:
    """Without points on a spot (five decimals) that ``most`` or more points share."""
    spot = [F.round(F.col(c) * 100000).cast("long").alias(f"_{c}") for c in ("lon", "lat")]
    crowded = points.groupBy(*spot).count().filter(F.col("count") >= most).drop("count").withColumnsRenamed({"_lon": "_x", "_lat": "_y"})
    placed = points.select("*", *spot)
    return placed.join(crowded, (F.col("_lon") == F.col("_x")) & (F.col("_lat") == F.col("_y")), "left_anti").drop("_lon", "_lat")


def counted_pieces(homes: DataFrame, pieces: DataFrame) -> DataFrame:
    """Homes for each piece of a road, zeros included. homes: road, piece. pieces: road, piece."""
    counts = homes.groupBy("road", "piece").agg(F.count("*").alias("homes"))
    return pieces.join(counts, ["road", "piece"], "left").withColumn("homes", F.coalesce("homes", F.lit(0)).cast("long"))


def next_in_rotation(half_edges: DataFrame) -> DataFrame:
    """Adds ``following``: the half-edge after this one around its node, by bearing; the last is followed by the first."""
    around = Window.partitionBy("node").orderBy("bearing", "half")
    first = F.first("half").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return half_edges.withColumn("following", F.coalesce(F.lead("half").over(around), first))
