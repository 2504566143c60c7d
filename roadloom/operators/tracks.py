"""A route as a track of pieces with running positions, and where on it a position fix most likely is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import X_DEGREE, Y_WALK, on_segment
from roadloom.operators.linear import points_at
from roadloom.operators.spatial import crossed_cells

PACE_MPS, PAVEMENT_M = 0.45, 5.0
BEHIND_M, SPREAD_M, LEAST_REACH_M = 40.0, 400.0, 30.0


def built_track(legs: DataFrame) -> DataFrame:
    """legs (track, seq, n, length_m, …) with start_m, the length of all legs before."""
    before = Window.partitionBy("track").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return legs.withColumn("start_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)))


def at_positions(positions: DataFrame, pieces: DataFrame, bucket_m: float = 500.0) -> DataFrame:
    """positions (track, pos) with the piece each is in: n, into_m, left_m. A position beyond the end is at the end of the last piece.

    Pieces and positions meet by stretches of the track, so a long track is not compared piece by piece. Equal rows are
    answered together and come back as often as they were given.
    """
    rest = positions.columns
    positions = positions.groupBy(*rest).agg(F.count("*").cast("int").alias("_times"))
    ends = pieces.groupBy("track").agg(F.max(F.col("start_m") + F.col("length_m")).alias("_total"), F.max("seq").alias("_final")).withColumnRenamed("track", "_k")
    goal = positions.join(ends, F.col("track") == F.col("_k")).withColumn("_p", F.least(F.greatest("pos", F.lit(0.0)), F.col("_total"))).withColumn("_b", F.floor(F.col("_p") / bucket_m))
    spread = pieces.select(F.col("track").alias("_t"), "seq", "n", "start_m", "length_m", F.explode(F.sequence(F.floor(F.col("start_m") / bucket_m), F.floor((F.col("start_m") + F.col("length_m")) / bucket_m))).alias("_c"))
    inside = (F.col("_p") >= F.col("start_m")) & (F.col("_p") <= F.col("start_m") + F.col("length_m"))
    met = goal.join(spread, (F.col("track") == F.col("_t")) & (F.col("_b") == F.col("_c")) & inside)
    # of two pieces that meet at a position, the earlier
    best = met.groupBy(*rest, "_times").agg(F.min(F.struct("seq", "n", (F.col("_p") - F.col("start_m")).alias("into_m"), (F.col("start_m") + F.col("length_m") - F.col("_p")).alias("left_m"))).alias("m"))
    return best.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*rest, "m.n", "m.into_m", "m.left_m")


def step_starts(pieces: DataFrame) -> DataFrame:
    """track, n, start_m: where each step of a track begins, the first piece of its number."""
    return pieces.filter("n is not null").groupBy("track", "n").agg(F.min_by("start_m", "seq").alias("start_m"))


def places(positions: DataFrame, pieces: DataFrame, vertices: DataFrame) -> DataFrame:
    """positions (track, pos and others) with n, into_m, left_m as of ``at_positions``, and lon, lat of the place there.

    vertices: track, seq (of the piece), idx, pos (within the piece), lon, lat.
    """
    marked = at_positions(positions, pieces.withColumn("n", F.struct("n", "seq")))
    asked = marked.select("track", F.col("n.seq").alias("seq"), F.col("into_m").alias("pos"), F.struct(*[c for c in positions.columns if c != "track"], F.col("n.n").alias("n"), "into_m", "left_m").alias("_row"))
    met = points_at(asked, vertices, ("track", "seq"))
    return met.select("track", "_row.*", "lon", "lat")


def slices(wanted: DataFrame, pieces: DataFrame, vertices: DataFrame, bucket_m: float = 500.0) -> DataFrame:
    """q, track, seq, n, place, lon, lat: the lines of a track between two positions (q, track, from_m, to_m), one for each piece.

    vertices as in ``places``. A piece that is covered from its beginning starts where the piece before it ended, as a position
    there is that piece's. Ranges and pieces meet by stretches of the track.
    """
    order = Window.partitionBy("track").orderBy("seq")
    numbered = pieces.select("track", "seq", "n", "start_m", "length_m", F.lag("seq").over(order).alias("_before"), F.lag("length_m").over(order).alias("_before_m"))
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / bucket_m), F.floor(b / bucket_m)))
    spread = numbered.withColumn("_b", stretch(F.col("start_m"), F.col("start_m") + F.col("length_m"))).withColumnRenamed("track", "_t")
    asked = wanted.select("q", "track", F.greatest("from_m", F.lit(0.0)).alias("_from"), F.col("to_m").alias("_to")).filter("_to > _from").withColumn("_c", stretch(F.col("_from"), F.col("_to")))
    met = asked.join(spread, (F.col("track") == F.col("_t")) & (F.col("_b") == F.col("_c"))).withColumns({"a": F.greatest("_from", "start_m"), "b": F.least("_to", F.col("start_m") + F.col("length_m"))})
    # a pair counts in the stretch where what they share begins
    met = met.filter((F.col("b") > F.col("a")) & (F.floor(F.col("a") / bucket_m) == F.col("_c"))).select("q", "track", "seq", "n", "_before", "_before_m", (F.col("a") - F.col("start_m")).alias("a"), (F.col("b") - F.col("start_m")).alias("b"))
    own = F.struct("q", "seq", "n")
    before = (F.col("a") <= 0) & F.col("_before").isNotNull()
    first = met.select("track", F.when(before, F.col("_before")).otherwise(F.col("seq")).alias("seq"), F.when(before, F.col("_before_m")).otherwise(F.col("a")).alias("pos"), own.alias("_own"), F.lit(-1.0).alias("_at"))
    last = met.select("track", "seq", F.col("b").alias("pos"), own.alias("_own"), F.lit(float("inf")).alias("_at"))
    ends = points_at(first.union(last), vertices, ("track", "seq")).select("track", "_own", "_at", "lon", "lat")
    inner = met.join(vertices.select("track", "seq", F.col("pos").alias("_p"), "lon", "lat"), ["track", "seq"]).filter("_p > a and _p < b").select("track", own.alias("_own"), F.col("_p").alias("_at"), "lon", "lat")
    line = Window.partitionBy("track", "_own").orderBy("_at")
    return ends.union(inner).select("_own.q", "track", "_own.seq", "_own.n", (F.row_number().over(line) - 1).alias("place"), "lon", "lat")


def reach_level(accuracy: Column) -> Column:
    """The size of cells for a fix: it doubles with its reach, which is max(30, twice the accuracy) metres."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(LEAST_REACH_M), F.coalesce(accuracy, F.lit(0.0)) * 2) / LEAST_REACH_M))).cast("int")


def _cell_m(level: Column) -> Column:
    return F.lit(4 * LEAST_REACH_M) * F.pow(F.lit(2.0), level)


def placed_segments(segments: DataFrame, sizes: DataFrame, lat0: float) -> DataFrame:
    """Segments of steps in all cells that they are within reach of, at the levels (_track, _size) that sizes names."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    sized = segments.filter("n is not null").join(sizes, F.col("track") == F.col("_track")).drop("_track")
    end = lambda e: (F.col(f"{e}_lon") * x, F.col(f"{e}_lat") * F.lit(Y_WALK))
    return crossed_cells(sized, end("a"), end("b"), _cell_m(F.col("_size")), _cell_m(F.col("_size")) / 4)


def in_cells(fixes: DataFrame, lat0: float) -> DataFrame:
    """fixes with their level and cell; ``track`` becomes _track."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    spread = fixes.withColumnRenamed("track", "_track").withColumn("_level", reach_level(F.col("accuracy")))
    return spread.withColumn("_cx", F.floor(F.col("lon") * x / _cell_m(F.col("_level"))).cast("long")).withColumn("_cy", F.floor(F.col("lat") * F.lit(Y_WALK) / _cell_m(F.col("_level"))).cast("long"))


def beside(fixes: DataFrame, placed: DataFrame, lat0: float, how: str = "inner") -> DataFrame:
    """fixes (as of ``in_cells``) with the segments that they meet: d, s (metres into the piece), side (left positive); see ``located``."""
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    met = fixes.join(placed, (F.col("_track") == F.col("track")) & (F.col("_level") == F.col("_size")) & (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")), how)
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    dx, dy = (F.col("b_lon") - F.col("a_lon")) * x, (F.col("b_lat") - F.col("a_lat")) * Y_WALK
    size = F.sqrt(dx * dx + dy * dy)
    qx, qy = (F.col("lon") - F.col("a_lon")) * x - dx * t, (F.col("lat") - F.col("a_lat")) * Y_WALK - dy * t
    side = F.when(size > 0, (dx * qy - dy * qx) / size).otherwise(0.0)
    return met.withColumns({"d": dist, "s": F.col("from_m") + t * size, "side": side})


def located(fixes: DataFrame, segments: DataFrame, lat0: float, keep: int = 4) -> DataFrame:
    """fix, rank, n, pos, score: the steps of its track where a fix most likely is, best first, each step once.

    fixes: fix, track, lon, lat, from_pos, elapsed_s (null if unknown), accuracy (of any size).
    segments: track, n (null for walks between areas, which are no steps), pavement, start_m (of the piece),
    from_m (of the segment within it), seq, a_lon, a_lat, b_lon, b_lat. A step counts if it is within
    max(30, twice the accuracy) metres and not more than 40 m behind or too far ahead for the time. The score adds
    squares of distance, side and time; what is ahead of time costs more, so ties lean to the earlier step.

    Cells double with the reach of a fix, and a track's segments stand in those sizes that its fixes have.
    """
    spread = in_cells(fixes, lat0)
    sizes = spread.select("_track", F.col("_level").alias("_size")).distinct()
    met = beside(spread, placed_segments(segments, sizes, lat0), lat0)
    own = ("fix", "from_pos", "elapsed_s", "accuracy", "n", "pavement", "start_m")
    hit = met.select(*own, F.struct("d", "seq", "s", "side").alias("h")).groupBy(*own).agg(F.min("h").alias("h"))
    near = F.greatest(F.lit(30.0), F.col("accuracy") * 2)
    known = F.col("elapsed_s").isNotNull()
    expected = F.col("from_pos") + F.when(known, F.col("elapsed_s") * PACE_MPS).otherwise(0.0)
    ahead = F.col("from_pos") + F.col("elapsed_s") * PACE_MPS * 2.5 + 150
    spread_m = F.when(known, F.greatest(F.lit(120.0), F.col("elapsed_s") * PACE_MPS * 0.6)).otherwise(SPREAD_M)
    pos = F.col("start_m") + F.col("h.s")
    usual = F.when(F.col("pavement") == "right", -PAVEMENT_M).when(F.col("pavement") == "left", PAVEMENT_M).otherwise(0.0)
    square = lambda v: v * v
    score = square(F.col("h.d") / near) + square((F.col("h.side") - usual) / (F.col("accuracy") + 6)) + square((pos - expected) / spread_m) + F.greatest(F.lit(0.0), pos - expected) / spread_m * 0.5
    fits = (F.col("h.d") <= near) & (pos >= F.col("from_pos") - BEHIND_M) & (~known | (pos <= ahead))
    scored = hit.filter(fits).select("fix", "n", F.struct(score.alias("score"), pos.alias("pos")).alias("m")).groupBy("fix", "n").agg(F.min("m").alias("m"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("fix").orderBy("m.score", "n")))
    return ranked.filter(F.col("rank") <= keep).select("fix", "rank", "n", "m.pos", "m.score")
