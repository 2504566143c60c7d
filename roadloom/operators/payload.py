"""Routes assembled for the printed sheets and the page: shape, parking, names, hints, colours, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import halves_up

# The colours of the first routes.
ROUTE_COLOURS = ("#2a78d6", "#eb6834", "#1baf7a", "#eda100", "#e87ba4", "#008300", "#4a3aa7", "#e34948")
# Further routes take hues a golden ratio apart, at this lightness and saturation.
GOLDEN, LIGHTNESS, SATURATION = 0.618033988749895, 0.48, 0.65


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, src, dst in both directions for neighbours within one cluster. members: cluster, road; edges: src, dst."""
    one = members.select("cluster", F.col("road").alias("src"))
    two = members.select(F.col("cluster").alias("_c"), F.col("road").alias("dst"))
    return edges.join(one, "src").join(two, "dst").filter("cluster = _c").select("cluster", "src", "dst").distinct()


def cluster_shapes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, roads, edges, shape: a loop if it has as many neighbour pairs as roads."""
    inner = cluster_edges(members, edges).filter("src < dst").groupBy("cluster").agg(F.count("*").alias("edges"))
    counted = members.groupBy("cluster").agg(F.count("*").alias("roads")).join(inner, "cluster", "left").withColumn("edges", F.coalesce("edges", F.lit(0)).cast("long"))
    return counted.withColumn("shape", F.when(F.col("edges") >= F.col("roads"), "loop").otherwise("out-and-back"))


def parking_roads(members: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, parking: the road with most neighbours in its cluster, then most homes, then the first. members also: seq, residences."""
    degree = cluster_edges(members, edges).groupBy("cluster", "src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "road")
    ranked = members.join(degree, ["cluster", "road"], "left")
    best = F.max_by("road", F.struct(F.coalesce("degree", F.lit(0)), "residences", -F.col("seq")))
    return ranked.groupBy("cluster").agg(best.alias("parking"))


# The sentences of the two hints.
def start_hint(kind: Column, start: Column, parking: Column) -> Column:
    discretion = "(suggested — please use your own discretion)"
    drive = F.concat(F.lit("Park on "), parking, F.lit(f" {discretion}"))
    hybrid = F.concat(F.lit("Drive to "), parking, F.lit(f" and park there {discretion}, then walk the route"))
    return F.when(kind == "walk", F.concat(start, F.lit(" (event start point)"))).when(kind == "hybrid", hybrid).otherwise(drive)


def general_hint(kind: Column, spot: Column) -> Column:
    name = F.regexp_replace(spot, r"\s*\(part [\d.]+\)$", "")
    return F.when(kind == "drive", F.concat(F.lit("Park on "), name, F.lit(" (suggested — please use your own discretion)"))).otherwise(F.concat(F.lit("Start on "), name, F.lit(" (suggested — if you're driving, park nearby with discretion)")))


def route_colour(place: Column) -> Column:
    """The colour of the route at a place from 0."""
    hue = F.pmod((place - len(ROUTE_COLOURS)).cast("double") * GOLDEN, F.lit(1.0))
    high = LIGHTNESS * (1 + SATURATION)
    low = 2 * LIGHTNESS - high

    def channel(turn: float) -> Column:
        t = F.pmod(hue + turn, F.lit(1.0))
        value = F.when(t < 1 / 6, low + (high - low) * 6 * t).when(t < 1 / 2, high).when(t < 2 / 3, low + (high - low) * (2 / 3 - t) * 6).otherwise(low)
        return F.lpad(F.lower(F.hex(F.floor(value * 255 + 0.5).cast("long"))), 2, "0")

    made = F.concat(F.lit("#"), channel(1 / 3), channel(0.0), channel(-1 / 3))
    return F.when(place < len(ROUTE_COLOURS), F.element_at(F.array(*map(F.lit, ROUTE_COLOURS)), (F.least(place, F.lit(len(ROUTE_COLOURS) - 1)) + 1).cast("int"))).otherwise(made)


def original_ranges(start_frag: Column, start: Column, end_frag: Column, end: Column) -> Column:
    """Ranges of a row's own fragments that a part from one place to another covers: one, or two where it spans fragments."""
    item = lambda f, a, b: F.struct(f.alias("frag"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    one = F.array(item(start_frag, F.least(start, end), F.greatest(start, end)))
    two = F.array(item(start_frag, F.least(start, F.lit(1.0)), F.lit(1.0)), item(end_frag, F.lit(0.0), F.greatest(end, F.lit(0.0))))
    return F.when(start_frag.isNull() | end_frag.isNull(), F.array().cast("array<struct<frag:int,a:double,b:double>>")).when(start_frag == end_frag, one).otherwise(two)


def route_rows(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Adds route_id over hubs and clusters in order (A, B, …), and a colour. members: hub, cluster; hubs: hub, hub_seq."""
    from roadloom.functions.text import letters_id

    routes = members.select("hub", "cluster").distinct().join(hubs, "hub")
    # routes of one event are a few dozen
    place = F.dense_rank().over(Window.orderBy("hub_seq", "cluster")) - 1
    numbered = routes.withColumn("_place", place).select("hub", "cluster", letters_id(F.col("_place")).alias("route_id"), route_colour(F.col("_place")).alias("colour"))
    return members.join(numbered, ["hub", "cluster"])


def exported(routes: DataFrame, roads: DataFrame) -> DataFrame:
    """ward, json: the page's document. routes: ward, route, name, kind, residences; roads: ward, route, seq, street, status, residences, points."""
    seven = lambda p: F.struct(halves_up(p["lat"], 7).alias("lat"), halves_up(p["lon"], 7).alias("lon"))
    meta = F.map_from_entries(F.array_sort(F.collect_list(F.struct("route", F.struct(F.col("route").alias("id"), "name", "kind", "residences").alias("v")))))
    road = F.struct(
        "route", "seq", F.concat("route", F.lit("-"), F.col("seq").cast("string")).alias("id"), "street", F.col("route").alias("routeId"), F.col("residences").alias("res"), "status",
        F.transform("points", lambda p: F.array(seven(p)["lat"], seven(p)["lon"])).alias("segment"),
    )
    lists = roads.groupBy("ward").agg(F.transform(F.array_sort(F.collect_list(road)), lambda r: r.dropFields("route", "seq")).alias("roads"))
    return routes.groupBy("ward").agg(meta.alias("routesMeta")).join(lists, "ward", "left").select("ward", F.to_json(F.struct("ward", "routesMeta", "roads")).alias("json"))


def sheet_facts(members: DataFrame) -> DataFrame:
    """route, streets (sorted, distinct), residences. members: route, street, residences."""
    return members.groupBy("route").agg(F.array_join(F.array_sort(F.collect_set("street")), ", ").alias("streets"), F.sum("residences").alias("residences"))


def summary_tiles(roads: DataFrame, kinds: tuple[str, ...] = ("walk", "hybrid", "drive")) -> DataFrame:
    """routes, roads, residences and the number of roads of each kind, on one row. roads: route, kind, residences."""
    return roads.agg(F.count_distinct("route").alias("routes"), F.count("*").alias("roads"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.coalesce(F.sum("residences"), F.lit(0)).alias("residences"))
