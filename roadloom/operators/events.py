"""An event from its road table to its routes: hubs, clusters, route records, and the document of each ward."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_PLAN, halves_up, metres, point
from roadloom.functions.text import letters_id
from roadloom.operators import clusters, payload, roads, routes
from roadloom.operators.lineage import RANGES
from roadloom.operators.network import Rounds, dealt, large

# Fixed value: the note on a route that needs review.
REVIEW = "NEEDS REVIEW: combines roads not directly linked by a mapped road in this dataset (nearest-cluster fallback) — double-check there's a sensible walking/driving link between them, or split this route."
HUB = ["ward", "hub_seq"]
#: Sides of the cells by which settlements look for points of interest, each level so many times as wide as the one before, to farther than the earth reaches.
WIDER = 4
SIDES_M = [25.0 * WIDER**k for k in range(10)]
#: Degrees from which a place doesn't count as one, and the cosine of a latitude up to which cells would be too narrow.
FINITE, LEAST_COSINE = 1e6, 0.01


def nearest_on_line(points: Column, lon: Column, lat: Column) -> Column:
    """The place of a line (array of points) nearest to a point: found in degrees on each segment, compared in metres."""

    def on(i: Column) -> Column:
        a, b = F.get(points, i - 1), F.get(points, i)
        dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
        square = dx * dx + dy * dy
        t = F.when(square > 0, F.least(F.greatest(((lon - a["lon"]) * dx + (lat - a["lat"]) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        x, y = a["lon"] + dx * t, a["lat"] + dy * t
        return F.struct(metres(lon, lat, x, y, lat).alias("d"), i.alias("i"), point(x, y).alias("p"))

    return F.when(F.size(points) > 1, F.array_min(F.transform(F.sequence(F.lit(1), F.size(points) - 1), on))["p"])


def _at_levels(frame: DataFrame, lon: str, lat: str) -> DataFrame:
    """Each row once for each level of cells; without a finite place, or near a pole, only for the last, one cell that holds everything."""
    placed = (F.abs(lon) < FINITE) & (F.abs(lat) < FINITE) & (F.col("_least") > LEAST_COSINE)
    last = F.lit(len(SIDES_M))
    return frame.withColumn("level", F.explode(F.when(placed, F.sequence(F.lit(0), last)).otherwise(F.array(last))))


def _in_cells(frame: DataFrame, lon: str, lat: str, around: int) -> DataFrame:
    """Each row once for each cell (_x, _y) of its level that is at most ``around`` from its own. _least: the cosine by which degrees of longitude shrink."""
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-around, around + 1) for j in range(-around, around + 1)]
    inner, none = F.col("level") < len(SIDES_M), F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))
    side = F.get(F.array(*map(F.lit, SIDES_M)), F.col("level"))
    x, y = F.floor(F.col(lon) * F.col("_least") * X_DEGREE / side), F.floor(F.col(lat) * Y_PLAN / side)
    at = lambda c, o: F.when(inner, c + F.col(o)).otherwise(0).cast("long")
    spread = frame.withColumn("_o", F.explode(F.when(inner, F.array(*steps)).otherwise(F.array(none))))
    return spread.withColumns({"_x": at(x, "_o.i"), "_y": at(y, "_o.j")}).drop("_o")


def nearest_hubs(centres: DataFrame, pois: DataFrame) -> DataFrame:
    """ward, hub_seq, label, lon, lat: each settlement's nearest point of interest of its district, else its own centre.

    centres: ward, hub_seq (unique), district, lon, lat; pois: district, poi, p_lon, p_lat; those without a finite place are left out. Ties go to the first
    name. A settlement meets the points of its own and the neighbouring cells, at the narrowest level that certainly
    has the nearest one there: the points of a district aren't compared with all of its settlements. The least distance is hashed, and
    only points as near as that are compared by name, so pairs are neither sorted nor gathered.
    """
    cosine = F.when(F.abs("lat") < FINITE, F.abs(F.cos(F.radians("lat"))))
    # cells of a district are as wide as its settlement farthest from the equator needs them
    squeezed = centres.groupBy(F.col("district").alias("_d")).agg(F.min(cosine).alias("_least"), F.max(cosine).alias("_most"))
    finite = pois.filter((F.abs("p_lon") < FINITE) & (F.abs("p_lat") < FINITE) & F.col("poi").isNotNull())
    spots = finite.groupBy("district", "p_lon", "p_lat").agg(F.min("poi").alias("poi")).join(squeezed, F.col("district") == F.col("_d"))
    standing = _in_cells(_at_levels(spots.drop("_d", "_most"), "p_lon", "p_lat"), "p_lon", "p_lat", 0).drop("_least")
    asked = _at_levels(centres.join(squeezed, F.col("district") == F.col("_d")).drop("_d"), "lon", "lat")
    key, cell = [F.col(c) for c in HUB], ["district", "level", "_x", "_y"]
    taken = large(standing.select(*cell).distinct())
    narrowest = _in_cells(asked, "lon", "lat", 1).join(taken, cell).groupBy(*key, "district", "lon", "lat", "_least", "_most").agg(F.min("level").alias("_level"))
    # a point in one of the nine cells is within two sides each way, by longitude within as many more as the settlement's cosine exceeds the least one
    reach = 2.002 * F.sqrt(1 + F.pow(F.col("_most") / F.col("_least"), F.lit(2)))
    wider = F.ceil(F.log(reach) / math.log(WIDER))
    # searched at a level whose side is at least as long as that, or in the one cell of all
    searched = narrowest.withColumn("level", F.least(F.col("_level") + wider, F.lit(len(SIDES_M))).cast("int")).drop("_level")
    dist = metres(F.col("lon"), F.col("lat"), F.col("p_lon"), F.col("p_lat"), F.col("lat"), Y_PLAN)

    def met(frame: DataFrame) -> DataFrame:
        return _in_cells(frame, "lon", "lat", 1).join(large(standing), cell).withColumn("_m", dist)

    least = met(searched).groupBy(*key).agg(F.min("_m").alias("_near"))
    nearest = met(searched.join(least, HUB)).filter(F.col("_m").eqNullSafe(F.col("_near")))
    best = nearest.groupBy(*key).agg(F.min(F.struct("poi", "p_lon", "p_lat")).alias("m"))
    own = F.concat(F.lit("Settlement "), F.col("hub_seq").cast("string"), F.lit(" centre"))
    return centres.join(best, HUB, "left").select(*HUB, F.coalesce("m.poi", own).alias("label"), F.coalesce("m.p_lon", "lon").alias("lon"), F.coalesce("m.p_lat", "lat").alias("lat"))


def numbered_routes(members: DataFrame) -> DataFrame:
    """ward, hub_seq, cluster, route: identifiers A, B, … that run on across the hubs of a ward."""
    place = F.row_number().over(Window.partitionBy("ward").orderBy("hub_seq", "cluster")) - 1
    return members.select(*HUB, "cluster").distinct().select(*HUB, "cluster", letters_id(place).alias("route"))


#: What a route's road has besides: its homes and its stretches done on one side, and, of a split road, the part of its row.
EXTRAS = {
    "homes": "array<struct<lon:double,lat:double>>", "half_done": "array<struct<side:string,points:array<struct<lon:double,lat:double>>>>",
    "root_name": "string", "original_ranges": RANGES, "current_partial": "string", "homes_trimmed": "boolean",
}


def with_extras(members: DataFrame, lineage: DataFrame | None = None, homes: DataFrame | None = None, half_done: DataFrame | None = None, trimmed: DataFrame | None = None) -> DataFrame:
    """members with the columns of EXTRAS; a part of a split road takes the row_index of the row it was cut from.

    lineage: as of ``lineage.part_lineage``; homes: road, pt, lon, lat on the road; half_done: road, piece, side, points; trimmed: road
    of parts of roads that were cut down to their homes.
    """
    out = members
    if lineage is not None:
        of = lineage.select(F.col("road").alias("_road"), "root_name", F.col("row_index").alias("_row"), "original_ranges", "current_partial")
        out = out.join(of, F.col("road") == F.col("_road"), "left").withColumn("row_index", F.coalesce("_row", "row_index")).drop("_road", "_row")
    listed = lambda frame, name, order, made: frame.groupBy(F.col("road").alias("_road")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), made).alias(name))
    if homes is not None:
        out = out.join(listed(homes, "homes", ("pt", "lon", "lat"), lambda h: point(h["lon"], h["lat"])), F.col("road") == F.col("_road"), "left").drop("_road")
    if half_done is not None:
        out = out.join(listed(half_done, "half_done", ("piece", "side", "points"), lambda h: h.dropFields("piece")), F.col("road") == F.col("_road"), "left").drop("_road")
    if trimmed is not None:
        out = out.join(trimmed.select(F.col("road").alias("_road"), F.lit(True).alias("homes_trimmed")), F.col("road") == F.col("_road"), "left").drop("_road")
    return out


def route_records(members: DataFrame, edges: DataFrame, hubs: DataFrame, general: bool = False) -> DataFrame:
    """One row for each route: ward, route, hub_id, name, kind, shape, residences, start_hint, notes, marker, roads.

    members may have the columns of EXTRAS (see ``with_extras``); those it lacks are null in its roads.

    members: ward, hub_seq, cluster, seq, road (unique), street, status, residences, row_index, kind, merged (by
    distance), lon, lat, points; edges: src, dst in both directions; hubs: ward, hub_seq, id, label, lon, lat. A
    route that isn't walked from its hub, and every general one, has a marker: the place of its parking road nearest
    to that road's centre. roads is in the order of seq.
    """
    numbered = numbered_routes(members)
    # a route's key, for operators that know clusters
    own = dealt(members.join(numbered, [*HUB, "cluster"]).withColumn("cluster", F.struct("ward", "route")), "cluster")
    lone = F.struct(
        "seq", F.col("road").alias("name"), "status", halves_up(F.col("residences").cast("double"), 1).alias("residences"), "row_index", F.col("points").alias("geometry"),
        *[(F.col(c) if c in members.columns else F.lit(None)).cast(kind).alias(c) for c, kind in EXTRAS.items()],
    )
    base = own.groupBy("cluster").agg(
        F.min("hub_seq").alias("hub_seq"), F.min("kind").alias("kind"), halves_up(F.sum("residences").cast("double"), 1).alias("residences"), F.max("merged").alias("merged"),
        F.transform(F.array_sort(F.collect_list(lone)), lambda r: r.dropFields("seq")).alias("roads"),
    )
    named = roads.route_names(own.select(F.col("cluster").alias("route"), "street", "residences")).withColumnRenamed("route", "cluster")
    shape = payload.cluster_shapes(own.select("cluster", "road"), edges).select("cluster", "shape")
    parking = payload.parking_roads(own.select("cluster", "road", "seq", "residences"), edges)
    # the place on its line is looked for on parking roads only
    lines = own.select(F.col("cluster").alias("_c"), "road", "lon", "lat", "points")
    marked = parking.join(large(lines), (F.col("cluster") == F.col("_c")) & (F.col("parking") == F.col("road"))).select("cluster", "parking", nearest_on_line(F.col("points"), F.col("lon"), F.col("lat")).alias("spot"))
    joined = base.join(shape, "cluster").join(named, "cluster", "left").join(marked, "cluster", "left").withColumn("ward", F.col("cluster.ward"))
    hub = hubs.select(*HUB, F.col("id").alias("hub_id"), F.col("label").alias("_label"))
    joined = joined.join(hub, HUB, "left")
    hint = payload.general_hint(F.col("kind"), F.col("parking")) if general else payload.start_hint(F.col("kind"), F.col("_label"), F.col("parking"))
    marker = F.struct(F.col("parking").alias("label"), F.col("spot.lon").alias("lon"), F.col("spot.lat").alias("lat"))
    return joined.select(
        "ward", F.col("cluster.route").alias("route"), (F.lit(None).cast("string") if general else F.col("hub_id")).alias("hub_id"), F.coalesce("name", F.lit("")).alias("name"), "kind", "shape", "residences",
        hint.alias("start_hint"), F.when(F.col("merged"), REVIEW).otherwise("").alias("notes"), (marker if general else F.when(F.col("kind") != "walk", marker)).alias("marker"), "roads",
    )


def ward_documents(records: DataFrame, hubs: DataFrame, general: bool = False) -> DataFrame:
    """ward, general, routes (their number), residences, hubs, start, and bounds of all routes' roads; see ``route_records``.

    An event starts at its first hub; a general one has no hubs, and its start is the middle of its bounds.
    """
    each = records.select("ward", "route", "residences", F.flatten("roads.geometry").alias("p"))
    span = lambda f, c: f(F.transform("p", lambda p: p[c]))
    box = each.groupBy("ward").agg(
        F.count("*").alias("routes"), F.sum("residences").alias("residences"),
        *[g(span(f, c)).alias(f"{n}_{c}") for n, f, g in (("min", F.array_min, F.min), ("max", F.array_max, F.max)) for c in ("lon", "lat")],
    )
    bounds = F.struct("min_lon", "max_lon", "min_lat", "max_lat").alias("bounds")
    listed = F.array_sort(F.collect_list(F.struct("hub_seq", "id", "label", "lon", "lat")))
    some = hubs.groupBy("ward").agg(F.transform(listed, lambda h: h.dropFields("hub_seq")).alias("hubs"))
    joined = box.join(some, "ward", "left")
    middle = F.struct(F.concat("ward", F.lit(" ward")).alias("label"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"), ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"))
    first = F.get("hubs", F.lit(0))
    start = middle if general else F.struct(first["label"].alias("label"), first["lon"].alias("lon"), first["lat"].alias("lat"))
    return joined.select("ward", F.lit(general).alias("general"), "routes", "residences", (F.slice("hubs", 1, 0) if general else F.col("hubs")).alias("hubs"), start.alias("start"), bounds)


def _clustered(placed: DataFrame, sizes: dict) -> DataFrame:
    """ward, hub_seq, cluster, seq, road, residences, kind, min_dist_m, merged of roads with the place of their hub (hub_lon, hub_lat).

    A hub's roads are clustered in one task, not a ward's.
    """
    dist = metres(F.col("lon"), F.col("lat"), F.col("hub_lon"), F.col("hub_lat"), F.col("lat"), Y_PLAN)
    task = F.to_json(F.struct("ward", "hub_seq"))
    asked = placed.select(task.alias("ward"), "ord", "road", "residences", "size", dist.alias("dist_m"), "lon", "lat", "neighbours")
    found = clusters.cluster_roads(asked, **sizes)
    back = F.from_json("ward", "ward string, hub_seq long")
    return found.select(back["ward"].alias("ward"), back["hub_seq"].alias("hub_seq"), "cluster", "seq", "road", "residences", "kind", "min_dist_m", F.col("merged_by_distance").alias("merged"))


def _kinds_by_effort(found: DataFrame, table: DataFrame, lat0: float, general: bool) -> DataFrame:
    """found with the kinds of clusters by their length, homes and spread; table: road, length_m, points."""
    key = [*HUB, "cluster"]
    side = lambda f, g, c: g(f(F.transform("points", lambda p: p[c])))
    sized = found.join(large(table.select("road", "length_m", "points")), "road").groupBy(*key).agg(
        F.min("min_dist_m").alias("min_dist_m"), (F.sum("length_m") / 1000).alias("km"), F.sum("residences").alias("residences"),
        *[side(f, g, c).alias(f"{n}_{c}") for n, f, g in (("min", F.array_min, F.min), ("max", F.array_max, F.max)) for c in ("lon", "lat")],
    )
    return found.drop("kind").join(routes.route_kinds(sized, lat0, by_effort=True, general=general).select(*key, "kind"), key)


def _records(found: DataFrame, table: DataFrame, hubs: DataFrame, general: bool) -> tuple[DataFrame, DataFrame]:
    # written once: routes' names, shapes, markers and lists all read the clusters, which are costly to make again
    found = Rounds(table).write(found)
    known = table.select("road", "street", "status", "row_index", "lon", "lat", "points")
    edges = table.select(F.col("road").alias("src"), F.explode("neighbours").alias("dst"))
    records = route_records(found.join(large(known), "road"), edges.union(edges.select("dst", "src")), hubs, general)
    return records, ward_documents(records, hubs, general)


def single_hub(table: DataFrame, starts: DataFrame, lat0: float, **sizes) -> tuple[DataFrame, DataFrame]:
    """Route records and documents of wards that start at one given place each.

    table: ward, ord, road (unique), street, status, row_index, residences (left), size, lon, lat (centre),
    neighbours, points, length_m: roads loaded, trimmed and split as the caller wants them. starts: ward, label, lon, lat.
    sizes: see ``clusters.cluster_roads``. A ward without a start has no routes.
    """
    hubs = starts.select("ward", F.lit(0).cast("long").alias("hub_seq"), F.lit("H1").alias("id"), "label", "lon", "lat")
    placed = table.join(hubs.select("ward", "hub_seq", F.col("lon").alias("hub_lon"), F.col("lat").alias("hub_lat")), "ward")
    found = _clustered(placed, sizes)
    if sizes.get("by_effort"):
        found = _kinds_by_effort(found, table, lat0, False)
    return _records(found, table, hubs, False)


def multi_hub(table: DataFrame, pois: DataFrame, lat0: float, radius_m: float = 1000.0, general: bool = False, **sizes) -> tuple[DataFrame, DataFrame]:
    """Route records and documents of wards whose settlements are found, each with its own hub.

    table as in ``single_hub``, and district; pois: district, poi, p_lon, p_lat; lat0: of the
    projection in which hubs of one name are compared. Settlements with the same hub nearby
    are one hub, whose routes follow each other. ``general``: no hubs, sizes by
    effort (the table's size), and a settlement's routes begin at its own centre.
    """
    sizes = {**sizes, "by_effort": True} if general else sizes
    # written once, over all tasks: settlements, centres, clusters, names, shapes, markers and lists all read it
    table = Rounds(table).write(dealt(table, "road"))
    asked = table.select("ward", "ord", "road", "residences", "size", F.lit(0.0).alias("dist_m"), "lon", "lat", "neighbours")
    settled = Rounds(table).write(clusters.find_settlements(asked, radius_m))
    placed = table.join(large(settled.select("road", F.col("settlement").alias("hub_seq"))), "road")
    weight = F.when(F.col("status") != roads.COMPLETE, F.greatest("residences", F.lit(1.0)))
    # sums by district first: they are hashed, while the least of texts would sort all roads
    summed = placed.groupBy(*HUB, "district").agg(*[F.sum(F.col(c) * weight).alias(c) for c in ("lon", "lat")], F.sum(weight).alias("weight"))
    centre = lambda c: (F.sum(c) / F.sum("weight")).alias(c)
    # written once, as the search for hubs reads them again and again
    centres = Rounds(table).write(summed.groupBy(*HUB).agg(F.min("district").alias("district"), centre("lon"), centre("lat")))
    own = Rounds(table).write(nearest_hubs(centres, pois.filter(F.lit(not general))))
    found = _clustered(placed.join(own.select(*HUB, F.col("lon").alias("hub_lon"), F.col("lat").alias("hub_lat")), HUB), sizes)
    if sizes.get("by_effort"):
        found = _kinds_by_effort(found, table, lat0, general)
    hubs = own.withColumn("id", F.concat(F.lit("H"), (F.col("hub_seq") + 1).cast("string")))
    if general:
        return _records(found, table, hubs, True)
    # settlements that share a hub: the routes of one after those of the other
    joined = routes.merged_hubs(own.select("ward", F.col("hub_seq").alias("seq"), "label", "lon", "lat", F.array("hub_seq").alias("clusters")), lat0)
    of = joined.select("ward", F.col("id"), "label", F.explode("clusters").alias("hub_seq"))
    first = of.withColumn("new_seq", F.min("hub_seq").over(Window.partitionBy("ward", "id")))
    moved = found.join(first.select(*HUB, "new_seq"), HUB)
    # clusters are counted within a settlement, so settlements of one hub keep apart by both numbers
    counted = moved.withColumn("cluster", F.struct("hub_seq", "cluster")).drop("hub_seq").withColumnRenamed("new_seq", "hub_seq")
    kept = first.filter("hub_seq = new_seq").select("ward", "hub_seq", "id", "label").join(own.select(*HUB, "lon", "lat"), HUB)
    return _records(counted, table, kept, False)


def cover_stats(records: DataFrame) -> DataFrame:
    """ward, routes, residences, walk, hybrid, drive: the counts on the cover of a ward's sheets."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("walk", "hybrid", "drive")]
    return records.groupBy("ward").agg(F.count("*").alias("routes"), F.sum("residences").alias("residences"), *kinds)
