"""Linear referencing: places along lines, points looked up on lines, and ranges of lines as lines of their own.

Lines are vertex rows (keys, idx, pos, lon, lat), pos in metres along the line. Places and vertices meet in one sorted
union, where each place takes the last vertex before it: no place is compared with the segments of its line.
Points and segments meet by grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_WALK, metres, on_segment
from roadloom.operators.network import Rounds, large
from roadloom.operators.roads import running_length
from roadloom.operators.spatial import cell_of, nearest_segments, segment_cells

#: Radii of the rings in which the nearest line is looked for: the first, and how much wider each next one is.
RING_M, WIDER = 50.0, 5.0
#: No two places on Earth are further apart.
FARTHEST_M = 4.1e7


def with_places(vertices: DataFrame, keys: tuple[str, ...], lat0: float) -> DataFrame:
    """Adds pos to vertices (keys, idx, lon, lat)."""
    step = metres(F.col("lon"), F.col("lat"), F.col("prev_lon"), F.col("prev_lat"), F.lit(lat0), Y_WALK)
    return running_length(vertices, keys, step).withColumnRenamed("cum_m", "pos")


def segments_of(vertices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, seq, from_m, to_m, a_lon, a_lat, b_lon, b_lat of consecutive vertices."""
    along = Window.partitionBy(*keys).orderBy("idx")
    after = lambda c: F.lead(c).over(along)
    ends = vertices.select(*keys, F.col("idx").alias("seq"), F.col("pos").alias("from_m"), after("pos").alias("to_m"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), after("lon").alias("b_lon"), after("lat").alias("b_lat"))
    return ends.filter("to_m is not null")


def points_at(wanted: DataFrame, vertices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """wanted (keys, pos and others) with lon, lat of that place; places beyond an end are at the end.

    Places on lines without vertices are left out.
    """
    rest = [c for c in wanted.columns if c not in (*keys, "pos")]
    along = Window.partitionBy(*keys).orderBy("idx")
    after = lambda c: F.lead(c).over(along).alias(f"b_{c}")
    known = vertices.select(*keys, "pos", F.struct("pos", "lon", "lat", after("pos"), after("lon"), after("lat")).alias("_v"), "idx", F.lit(None).cast(wanted.select(F.struct(*rest, "pos").alias("r")).schema["r"].dataType).alias("_r"))
    asked = wanted.select(*keys, F.greatest("pos", F.lit(0.0)).alias("pos"), F.lit(None).cast(known.schema["_v"].dataType).alias("_v"), F.lit(None).cast(known.schema["idx"].dataType).alias("idx"), F.struct(*rest, "pos").alias("_r"))
    order = Window.partitionBy(*keys).orderBy("pos", F.col("_r").isNotNull(), "idx").rowsBetween(Window.unboundedPreceding, 0)
    met = known.unionByName(asked).withColumn("v", F.last("_v", ignorenulls=True).over(order)).filter("_r is not null and v is not null")
    t = F.when(F.col("v.b_pos") > F.col("v.pos"), F.least((F.col("pos") - F.col("v.pos")) / (F.col("v.b_pos") - F.col("v.pos")), F.lit(1.0))).otherwise(0.0)
    between = lambda c: F.col(f"v.{c}") + F.coalesce((F.col(f"v.b_{c}") - F.col(f"v.{c}")) * t, F.lit(0.0))
    return met.select(*keys, "_r.*", between("lon").alias("lon"), between("lat").alias("lat"))


def inner_vertices(ranges: DataFrame, vertices: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """name, pos, lon, lat: the vertices strictly inside ranges (keys, name, a_pos, b_pos) of lines; ranges of a line don't overlap."""
    kind = ranges.schema[name].dataType
    begins = ranges.select(*keys, F.col("a_pos").alias("pos"), F.lit(1).alias("_k"), F.struct(name, "a_pos", "b_pos").alias("_g"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"))
    placed = vertices.select(*keys, "pos", F.lit(0).alias("_k"), F.lit(None).cast(begins.schema["_g"].dataType).alias("_g"), "lon", "lat")
    order = Window.partitionBy(*keys).orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.unionByName(begins).withColumn("g", F.last("_g", ignorenulls=True).over(order)).filter((F.col("_k") == 0) & (F.col("pos") > F.col("g.a_pos")) & (F.col("pos") < F.col("g.b_pos")))
    return inside.select(F.col(f"g.{name}").cast(kind).alias(name), "pos", "lon", "lat")


def nearest_of_own(points: DataFrame, segments: DataFrame, own: tuple[str, ...], lat0: float, most_m: float, per: tuple[str, ...] = ()) -> DataFrame:
    """own, pt, per, dist, seg, at_m: the place on lines of the same owner nearest to each point within ``most_m``.

    points: own, pt, lon, lat. segments: own, seg (ties go to the least), per, from_m, a_lon, a_lat, b_lon, b_lat. With ``per``
    columns of the segments, the nearest for each of their values.
    """
    x, y = cell_of(F.col("lon"), F.col("lat"), lat0, 4 * most_m)
    placed = points.select(*[F.col(c).alias(f"_{c}") for c in own], "pt", "lon", "lat", x.alias("_cx"), y.alias("_cy"))
    spread = segment_cells(segments, lat0, 4 * most_m, most_m)
    same = (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy"))
    for c in own:
        same = same & (F.col(f"_{c}") == F.col(c))
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    size = metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0), Y_WALK)
    hit = placed.join(large(spread), same).select(*own, "pt", *per, F.struct(dist.alias("dist"), "seg", (F.col("from_m") + t * size).alias("at_m")).alias("m")).filter(F.col("m.dist") <= most_m)
    return hit.groupBy(*own, "pt", *per).agg(F.min("m").alias("m")).select(*own, "pt", *per, "m.dist", "m.seg", "m.at_m")


def nearest_of_any(points: DataFrame, segments: DataFrame, lat0: float, net: bool = False) -> DataFrame:
    """pt, seg, t, dist: the nearest segment of all (with ``net``, of all with the point's), however far; ties go to the least seg.

    Points without a hit within a ring go on to the next, five times as wide, with cells as wide: a hit within the ring that was
    searched is certainly the nearest. Rounds grow with the logarithm of the widest distance; no segment, no rows.
    """
    rounds = Rounds(points)
    found, left, ring = None, rounds.write(points.select("pt", "lon", "lat", *(["net"] if net else []))), RING_M
    if segments.isEmpty():
        return nearest_segments(left, segments, lat0, ring, net)
    if net:  # a point whose network has no segment would look for one round the globe
        left = left.join(segments.select("net").distinct(), "net", "left_semi")
    while ring <= FARTHEST_M * WIDER:
        hits = rounds.write(nearest_segments(left, segments, lat0, ring, net))
        found = hits if found is None else found.union(hits)
        left = rounds.write(left.join(large(hits.select(F.col("pt").alias("_pt"))), F.col("pt") == F.col("_pt"), "left_anti"))
        if left.isEmpty():
            break
        ring *= WIDER
    return found


def metre_vector(a_lon: Column, a_lat: Column, b_lon: Column, b_lat: Column, lat0: float) -> tuple[Column, Column]:
    return (b_lon - a_lon) * (F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))), (b_lat - a_lat) * F.lit(Y_WALK)
