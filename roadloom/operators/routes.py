"""Routes and hubs: kinds, hubs that share a label, ranges of parts, rows near a route, plans made compact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.boxes import containing

from roadloom.functions.geo import halves_up, metres, route_kind
from roadloom.operators.payload import original_ranges

SAME_HUB_M = 2000.0
LONG_KM, SPARSE_PER_KM, SPREAD_KM = 2.0, 30.0, 1.5
PAD_DEGREES, PAD_LON = 0.015, 1.6


def route_kinds(clusters: DataFrame, lat0: float, by_effort: bool = False, general: bool = False) -> DataFrame:
    """Adds spread_km (diagonal of the box) and kind. clusters: min_dist_m, km, residences, min_lon, min_lat, max_lon, max_lat."""
    spread = metres(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), F.lit(lat0)) / 1000
    lane = ((F.col("km") > LONG_KM) & (F.col("residences") / F.col("km") < SPARSE_PER_KM)) | (F.col("spread_km") > SPREAD_KM)
    base = F.lit("walk") if general else route_kind(F.col("min_dist_m"))
    return clusters.withColumn("spread_km", spread).withColumn("kind", F.when(lane, "drive").otherwise(base) if by_effort else base)


def merged_hubs(hubs: DataFrame, lat0: float, same_m: float = SAME_HUB_M) -> DataFrame:
    """ward, id, label, hubs, clusters: hubs of one label near its first one are one hub; the others get a number.

    hubs: ward, seq, label, lon, lat, clusters (array).
    """
    order = Window.partitionBy("ward", "label").orderBy("seq")
    first = hubs.withColumns({"_x": F.first("lon").over(order), "_y": F.first("lat").over(order)})
    far = metres(F.col("lon"), F.col("lat"), F.col("_x"), F.col("_y"), F.lit(lat0)) > same_m
    numbered = first.withColumn("_far", far.cast("int")).withColumn("_n", F.sum("_far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    slot = F.when(F.col("_far") == 0, F.col("label")).otherwise(F.concat("label", F.lit(" #"), (F.col("_n") + 1).cast("string")))
    grouped = numbered.withColumn("slot", slot).groupBy("ward", "slot").agg(F.min("seq").alias("seq"), F.count("*").alias("hubs"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "clusters"))), lambda x: x["clusters"])).alias("clusters"))
    place = F.row_number().over(Window.partitionBy("ward").orderBy("seq"))
    return grouped.select("ward", F.concat(F.lit("H"), place.cast("string")).alias("id"), F.col("slot").alias("label"), "hubs", "clusters")


def best_fractions(points: DataFrame, segments: DataFrame, lat0: float) -> DataFrame:
    """pt, road, frag, frac, dist: the nearest place on all fragments of a point's own road; ties go to the first segment.

    points: pt, road, lon, lat. segments: road, frag, seq, a_lon, a_lat, b_lon, b_lat, from_m, frag_m. The nearest
    place of a segment is found in degrees, and only its distance in metres.
    """
    met = points.join(segments, "road")
    dx, dy = F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.greatest(((F.col("lon") - F.col("a_lon")) * dx + (F.col("lat") - F.col("a_lat")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    dist = metres(F.col("lon"), F.col("lat"), F.col("a_lon") + dx * t, F.col("a_lat") + dy * t, F.lit(lat0))
    size = metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    frac = F.when(F.col("frag_m") > 0, (F.col("from_m") + t * size) / F.col("frag_m")).otherwise(0.0)
    best = met.groupBy("pt", "road").agg(F.min(F.struct(dist.alias("dist"), "frag", "seq", frac.alias("frac"))).alias("m"))
    return best.select("pt", "road", "m.frag", "m.frac", "m.dist")


def part_ranges(parts: DataFrame, segments: DataFrame, lat0: float) -> DataFrame:
    """part, road, ranges: what of a road's own fragments a part from one point to another covers. parts: part, road, and lon and lat of a_ and b_."""
    ends = parts.select("part", "road", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(f"{e}_lon").alias("lon"), F.col(f"{e}_lat").alias("lat")) for e in "ab"])).alias("x"))
    found = best_fractions(ends.select(F.struct("part", "x.e").alias("pt"), "road", "x.lon", "x.lat"), segments, lat0)
    pick = lambda e, c: F.max(F.when(F.col("pt.e") == e, F.col(c)))
    both = found.groupBy("pt.part", "road").agg(pick("a", "frag").alias("f0"), pick("a", "frac").alias("t0"), pick("b", "frag").alias("f1"), pick("b", "frac").alias("t1"))
    return both.select("part", "road", original_ranges(F.col("f0"), F.col("t0"), F.col("f1"), F.col("t1")).alias("ranges"))


def bounds(vertices: DataFrame, *keys: str) -> DataFrame:
    """keys, min_lon, min_lat, max_lon, max_lat."""
    return vertices.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")])


def rows_near(rows: DataFrame, box: DataFrame, key: str) -> DataFrame:
    """The rows of which a vertex is strictly inside the padded box of their key. rows: key, fragments; box: see ``bounds``."""
    named = box.withColumnRenamed(key, "_key")
    lon, lat = PAD_DEGREES * PAD_LON, PAD_DEGREES
    inside = lambda p: (p["lon"] > F.col("min_lon") - lon) & (p["lon"] < F.col("max_lon") + lon) & (p["lat"] > F.col("min_lat") - lat) & (p["lat"] < F.col("max_lat") + lat)
    joined = rows.join(named, F.col(key) == F.col("_key"))
    return joined.filter(F.exists(F.flatten("fragments"), inside)).select(*rows.columns)


def wards_seen(rows: DataFrame) -> DataFrame:
    """ward_name, first_row, rows, mean_lat of the wards that have a name."""
    named = rows.filter(F.coalesce("ward_name", F.lit("")) != "")
    return named.groupBy("ward_name").agg(F.min("row_index").alias("first_row"), F.count("*").alias("rows"), F.avg("lat").alias("mean_lat"))


def without_near_vertices(points: Column, least_m: float, lat0: Column, y: float) -> Column:
    """Points of a line without those nearer than ``least_m`` to the last one kept."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (metres(last["lon"], last["lat"], p["lon"], p["lat"], lat0, y) > least_m), F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(points, F.array().cast("array<struct<lon:double,lat:double>>"), add)


def streets_in_order(path: DataFrame) -> DataFrame:
    """route, streets: the streets of a path (route, seq, street), consecutive ones once, joined by an arrow."""
    before = F.lag("street").over(Window.partitionBy("route").orderBy("seq"))
    kept = path.withColumn("_b", before).filter(F.col("street").isNotNull() & ~F.col("street").eqNullSafe(F.col("_b")))
    return kept.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "street"))), lambda x: x["street"]), " > ").alias("streets"))


def start_place(kind: Column, parking: Column, spot: Column, hub: Column) -> Column:
    """Where a route begins: on its parking road unless it is walked, then on its own spot, else at the hub."""
    return F.when((kind != "walk") & parking.isNotNull(), parking).otherwise(F.coalesce(spot, hub))


def direction_stats(legs: DataFrame) -> DataFrame:
    """route, legs, homes, walk_m, transfer_m, crossings of legs (route, type, homes, length_m, crosses)."""
    leg = F.col("type") == "leg"
    return legs.groupBy("route").agg(
        F.count_if(leg).alias("legs"), F.coalesce(F.sum(F.when(leg, F.col("homes"))), F.lit(0)).alias("homes"), F.coalesce(F.sum(F.when(leg, F.col("length_m"))), F.lit(0.0)).alias("walk_m"),
        F.coalesce(F.sum(F.when(~leg, F.col("length_m"))), F.lit(0.0)).alias("transfer_m"), F.count_if("crosses").alias("crossings"),
    )


def compact_legs(legs: DataFrame) -> DataFrame:
    """legs with homes to one digit, whole metres, places to six digits, and null for empty texts."""
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return legs.select("route", "seq", empty("street"), empty("cue"), halves_up(F.col("homes"), 1).alias("homes"), halves_up(F.col("length_m")).cast("long").alias("len"), halves_up(F.col("lon"), 6).alias("lon"), halves_up(F.col("lat"), 6).alias("lat"))


def least_by_route(distances: DataFrame, members: DataFrame) -> DataFrame:
    """route, dist_m: the least network distance of a route's roads. distances: road, dist_m; members: route, road."""
    return members.join(distances, "road").groupBy("route").agg(F.min("dist_m").alias("dist_m"))


def uncovered_requests(requests: DataFrame, coverage: DataFrame, most_degrees: float = 0.6, most_boxes: int = 300) -> DataFrame:
    """The requested boxes that are not too large and not inside a covered one, which alone have to be fetched.

    Boxes: min_lon, min_lat, max_lon, max_lat; requests have a unique ``request``. coverage: the latest ``most_boxes`` (by seq) count, as many
    as a cache lists. Boxes meet by cells of their sizes, neither side is broadcast.
    """
    latest = coverage.orderBy(F.col("seq").desc()).limit(most_boxes).withColumnRenamed("seq", "id")
    small = requests.filter((F.col("max_lon") - F.col("min_lon") <= most_degrees) & (F.col("max_lat") - F.col("min_lat") <= most_degrees))
    covered = containing(small.withColumnRenamed("request", "id"), latest).select(F.col("inner_id").alias("request")).distinct()
    return small.join(covered, "request", "left_anti")
