"""Homes on roads: attached by row key, placed on lines, shared out between pieces, and cuts between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import geo, intervals, parse, text
from roadloom.functions.geo import on_segment
from roadloom.operators.network import large
from roadloom.operators.roads import COMPLETE, IN_PROGRESS, last_of_street, remaining_share, without_features

VERSION = 1
NEAR_M = 2.0


def attach_homes(rows: DataFrame, index: DataFrame, version: int = VERSION) -> DataFrame:
    """Adds home_fracs, the positions (fractions) by fragment that an index has for a row, and null where it has none.

    rows: street, ward_name, road_geometry; index: row_key, positions (thousandths by fragment). The key holds a
    fingerprint of the geometry, so positions of a geometry that has changed since match nothing. An index of
    another version attaches nothing.
    """
    usable = index.filter(F.lit(version == VERSION)).select(F.col("row_key").alias("_key"), F.transform("positions", lambda f: F.transform(f, lambda v: v / 1000.0)).alias("home_fracs"))
    keyed = rows.withColumn("_row", text.row_key(F.col("street"), F.col("ward_name"), F.col("road_geometry")))
    return keyed.join(large(usable), F.col("_row") == F.col("_key"), "left").drop("_row", "_key")


def match_stats(attached: DataFrame, *keys: str) -> DataFrame:
    """with_homes and matched: rows that have homes, and those of them whose positions are known."""
    some = F.col("residences") > 0
    return attached.groupBy(*keys).agg(F.count_if(some).alias("with_homes"), F.count_if(some & F.col("home_fracs").isNotNull()).alias("matched"))


def points_on_lines(lines: DataFrame, lat0: Column) -> DataFrame:
    """lines with points: each home's place on its own fragment; null if the numbers of fragments differ or no home is placed.

    lines: fragments (arrays of points), home_fracs.
    """
    pairs = F.arrays_zip("fragments", "home_fracs")
    one = lambda x: F.transform(F.when(F.size(x["fragments"]) > 1, x["home_fracs"]).otherwise(F.array().cast("array<double>")), lambda f: geo.point_at(x["fragments"], f, lat0, geo.Y_WALK))
    made = F.flatten(F.transform(pairs, one))
    return lines.withColumn("points", F.when((F.size("fragments") == F.size("home_fracs")) & (F.size(made) > 0), made))


def nearest_pieces(homes: DataFrame, segments: DataFrame, lat0: float, near_m: float = NEAR_M) -> DataFrame:
    """road, pt, piece, along_m, dist: the piece of its own road that a home lies on, and where; homes on none are left out.

    homes: road, pt, lon, lat. segments: road, piece, seq, a_lon, a_lat, b_lon, b_lat, from_m (length of the piece
    before the segment). Ties go to the first piece and segment. The least of a struct combines before the shuffle.
    """
    met = homes.join(segments, "road")
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    size = geo.metres(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0), geo.Y_WALK)
    best = met.select("road", "pt", F.struct(dist.alias("dist"), "piece", "seq", (F.col("from_m") + t * size).alias("along_m")).alias("m")).filter(F.col("m.dist") <= near_m)
    return best.groupBy("road", "pt").agg(F.min("m").alias("m")).select("road", "pt", "m.piece", "m.along_m", "m.dist")


def points_on(homes: DataFrame, segments: DataFrame, lat0: float, near_m: float = NEAR_M) -> DataFrame:
    """The homes (or other points: road, pt, lon, lat) that lie on a piece of their own road."""
    return homes.join(nearest_pieces(homes, segments, lat0, near_m).select("road", "pt"), ["road", "pt"], "left_semi")


def half_done_of_parts(stretches: DataFrame, segments: DataFrame, lat0: float, near_m: float = 3.0) -> DataFrame:
    """The stretches done on one side (road, pt, lon, lat of their middle vertex) that lie on the pieces of a part."""
    return points_on(stretches, segments, lat0, near_m)


def build_stats(matched: DataFrame) -> DataFrame:
    """points, placed, far, roads of points (pt, seg, road, far), of which those of no segment are not placed."""
    on = F.col("seg").isNotNull()
    return matched.agg(F.count("*").alias("points"), F.count_if(on).alias("placed"), F.count_if(on & F.col("far")).alias("far"), F.countDistinct(F.when(on, F.col("road"))).alias("roads"))


def write_home_index(index: DataFrame, path: str, version: int = VERSION) -> None:
    """Writes row_key, positions as an index: a JSON line for each row, so that no task holds the whole of it."""
    index.select(F.lit(version).alias("version"), F.create_map("row_key", "positions").alias("roads")).write.mode("overwrite").json(path)


def shared_residences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces (road, piece, remaining) with homes (zeros included) and residences: the road's remaining ones, shared by homes.

    residences is null for a road none of whose homes is on a piece.
    """
    counts = placed.groupBy("road", "piece").agg(F.count("*").alias("homes"))
    counted = pieces.join(counts, ["road", "piece"], "left").withColumn("homes", F.coalesce("homes", F.lit(0)).cast("long"))
    total = F.sum("homes").over(Window.partitionBy("road"))
    return counted.withColumn("residences", F.when(total > 0, F.col("remaining") * F.col("homes") / total))


def positions_along(placed: DataFrame) -> DataFrame:
    """road, positions: the sorted distances along the line of the homes that lie on it."""
    return placed.groupBy("road").agg(F.sort_array(F.collect_list("along_m")).alias("positions"))


def halfway_parts(positions: DataFrame, parts: DataFrame) -> DataFrame:
    """road, part, from_m, to_m, homes: roads cut halfway between homes, into parts with equal shares of them.

    positions: road, pos. parts: road, k, length. A road with fewer homes than parts is cut into equal lengths.
    """
    along = Window.partitionBy("road").orderBy("pos")
    numbered = positions.select("road", "pos", F.row_number().over(along).alias("n"), F.lead("pos").over(along).alias("next"), F.count("*").over(Window.partitionBy("road")).alias("all"))
    each = parts.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k")))).withColumn("at", F.col("i").cast("long"))
    cut = numbered.join(parts.filter("k > 1"), "road").filter("`all` >= k").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.filter(F.col("n") == F.floor(F.col("i") * F.col("all") / F.col("k") + 0.5)).select("road", "i", ((F.col("pos") + F.col("next")) / 2).alias("cut"), "n")
    joined = each.join(cut, ["road", "i"], "left")
    # without cuts between homes, equal lengths
    end = F.when(F.col("i") == F.col("k"), F.col("length")).otherwise(F.coalesce("cut", F.col("length") * F.col("i") / F.col("k")))
    ends = joined.withColumn("to_m", end)
    return ends.select("road", F.col("at").alias("part"), F.coalesce(F.lag("to_m").over(Window.partitionBy("road").orderBy("at")), F.lit(0.0)).alias("from_m"), "to_m")


def load_roads(rows: DataFrame, lat0: float, ward: str | None = None, exclude_features: bool = False) -> DataFrame:
    """The road table of rows: remaining residences by status, of a street's last row.

    rows: row_index, ward_name, street, status, residences, road_geometry, partial_geometry, and home_fracs (see
    ``attach_homes``; null where unknown). Complete leaves nothing; In_Progress leaves the share of the length that
    is not done (done on one side counts half), or of the homes that stand there, within two metres at the ends of
    stretches done on one side; any other status leaves all. Homes are measured along their own fragment.
    """
    kept = rows if ward is None else rows.filter(F.col("ward_name") == ward)
    kept = last_of_street(without_features(kept) if exclude_features else kept)
    read = kept.withColumn("fragments", parse.linestrings(F.col("road_geometry"))).withColumn("ranges", parse.partial_ranges(F.col("partial_geometry")))
    at = F.sequence(F.lit(0), F.size("fragments") - 1)

    def spans(i: Column, side: str) -> Column:
        return F.transform(F.filter("ranges", lambda r: (r["frag"] == i) & (r["side"] == side)), lambda r: intervals.interval(r["a"], r["b"]))

    def fragment(i: Column) -> Column:
        points = F.get(F.col("fragments"), i)
        return F.struct(geo.line_length(points, F.lit(lat0)).alias("length"), spans(i, "B").alias("both"), spans(i, "S").alias("one"), spans(i, "F").alias("other"), F.when(F.size("home_fracs") == F.size("fragments"), F.get(F.col("home_fracs"), i)).alias("homes"))

    parts = read.withColumn("_p", F.when(F.size("fragments") > 0, F.transform(at, fragment)))
    parts = parts.withColumn("_p", F.transform("_p", lambda p: p.withField("done", intervals.done(p["both"], p["one"], p["other"], p["length"]))))
    parts = parts.withColumn("_p", F.transform("_p", lambda p: p.withField("half", F.concat(intervals.half_done(p["one"], p["done"], p["length"]), intervals.half_done(p["other"], p["done"], p["length"])))))
    total = lambda make: F.coalesce(F.aggregate("_p", F.lit(0.0), lambda t, p: t + make(p)), F.lit(0.0))
    within = lambda f, spans, by: F.exists(spans, lambda x: (f >= x["a"] - by) & (f <= x["b"] + by))
    homes = lambda p, test: F.size(F.filter(F.coalesce(p["homes"], F.array().cast("array<double>")), test)).cast("double")
    out = parts.withColumns({
        "length_m": total(lambda p: p["length"]),
        "done_m": total(lambda p: p["length"] * intervals.total(p["done"])),
        "half_m": total(lambda p: p["length"] * intervals.total(p["half"])),
        "homes": total(lambda p: homes(p, lambda f: F.lit(True))),
        "homes_done": total(lambda p: homes(p, lambda f: within(f, p["done"], 0.0))),
        "homes_half": total(lambda p: homes(p, lambda f: within(f, p["half"], F.when(p["length"] > 0, NEAR_M / p["length"]).otherwise(0.0)))),
    })
    by_length = F.col("residences") * remaining_share(F.col("status"), F.col("length_m"), F.col("done_m"), F.col("half_m"))
    by_homes = F.col("residences") * (F.col("homes") - F.col("homes_done") - F.col("homes_half") / 2) / F.col("homes")
    left = F.when((F.col("status") == IN_PROGRESS) & (F.col("homes") > 0), by_homes).when(F.coalesce("status", F.lit("")) == COMPLETE, 0.0).otherwise(by_length)
    return out.select("ward_name", "street", "row_index", "status", "residences", "fragments", "length_m", "done_m", "half_m", left.alias("residences_left"))
