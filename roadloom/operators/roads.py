"""Operators on the road table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import text
from roadloom.functions.geo import point

MARKER = r"(?i)^\s*#+\s*ROUTE_PLANNER_ONLY_BELOW\s*#+\s*$"
COMPLETE, IN_PROGRESS = "Complete", "In_Progress"


def network_split(rows: DataFrame, order: str, cells: list[str]) -> DataFrame:
    """Adds is_network to rows below the first marker row; marker rows go, and rows below it without a street."""
    marked = rows.withColumn("_marker", F.exists(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]), lambda x: x.rlike(MARKER)))
    first = marked.filter("_marker").agg(F.min(order).alias("_first"))
    # one row, so the broadcast is bounded
    joined = marked.join(F.broadcast(first), how="left").filter("not _marker")
    below = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return joined.withColumn("is_network", below).filter(~below | (F.coalesce("street", F.lit("")) != "")).drop("_marker", "_first")


def last_of_street(rows: DataFrame, keys: tuple[str, ...] = ("ward_name", "street")) -> DataFrame:
    """One row for each street of a ward: the values of its last row, with ``ord``, the place of its first one."""
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "row_index").alias("m"), F.min("row_index").alias("ord"))
    return grouped.select(*keys, "m.*", "ord")


def remaining_share(status: Column, total_m: Column, done_m: Column, half_m: Column) -> Column:
    """The share of a road's homes that are left: a stretch done on one side counts half."""
    share = F.when(total_m > 0, (total_m - done_m - half_m / 2) / total_m).otherwise(0.0)
    return F.when(status == COMPLETE, 0.0).when(status == IN_PROGRESS, share).otherwise(1.0)


def eligible(status: Column, left: Column) -> Column:
    return (F.coalesce(status, F.lit("")) != COMPLETE) & (left > 0)


def without_features(rows: DataFrame) -> DataFrame:
    """Without features that have no homes, unless they are complete."""
    return rows.filter(~(text.non_residential(F.col("street"), F.col("residences")) & (F.coalesce("status", F.lit("")) != COMPLETE)))


def ward_summary(vertices: DataFrame, keys: tuple[str, ...] = ("ward_name",), buffer: float = 0.02) -> DataFrame:
    """Weighted centroid and buffered bounding box by ward. vertices: keys, lon, lat, residences, status."""
    weight = F.when(F.col("status") != COMPLETE, F.greatest(F.col("residences"), F.lit(1)).cast("double"))
    box = lambda f, c, by: (f(c) + F.lit(by)).alias(f"{'min' if by < 0 else 'max'}_{c}")
    return vertices.groupBy(*keys).agg(
        (F.sum(F.col("lon") * weight) / F.sum(weight)).alias("lon"), (F.sum(F.col("lat") * weight) / F.sum(weight)).alias("lat"),
        box(F.min, "lon", -buffer), box(F.min, "lat", -buffer), box(F.max, "lon", buffer), box(F.max, "lat", buffer),
    )


def islands(positions: DataFrame, keys: tuple[str, ...], length: str, gap_m: float = 250.0, margin_m: float = 30.0) -> DataFrame:
    """Stretches of homes: positions (keys, pos in metres, length) that follow within the gap, with margins, clamped to the road.

    Stretches of at most one metre go.
    """
    along = Window.partitionBy(*keys).orderBy("pos")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    apart = lambda step: F.coalesce(step, F.lit(gap_m + 1)) > gap_m
    marked = positions.withColumns({"_first": apart(F.col("pos") - F.lag("pos").over(along)), "_last": apart(F.lead("pos").over(along) - F.col("pos")), "_n": F.row_number().over(along)})
    numbered = marked.withColumn("island", F.sum(F.col("_first").cast("int")).over(so_far))
    # islands are numbered as they come, so the greatest pair so far is of the present one
    sized = numbered.withColumn("_l", F.max(F.struct("island", F.col(length).alias("l"))).over(so_far)["l"])
    # only the first and the last position of an island go on; what is sorted is told in passing and not gathered by islands
    ends = sized.filter("_first or _last")
    end = lambda c: F.when(F.col("_last"), F.col(c)).otherwise(F.lead(c).over(along))
    a, b = F.greatest(F.col("pos") - margin_m, F.lit(0.0)), F.least(F.col("_b") + margin_m, F.col("_end_l"))
    told = ends.withColumns({"_b": end("pos"), "_end_n": end("_n"), "_end_l": end("_l")}).filter("_first")
    return told.select(*keys, F.col("island").cast("long").alias("island"), a.alias("from_m"), b.alias("to_m"), (F.col("_end_n") - F.col("_n") + 1).cast("long").alias("homes")).filter(F.col("to_m") - F.col("from_m") > 1)


def merged_intervals(rows: DataFrame, keys: tuple[str, ...], gap: float = 1e-9) -> DataFrame:
    """Union of intervals (keys, a, b) over rows: sorted, joined where the next begins within the gap of the end so far."""
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("_new", (reach.isNull() | (F.col("a") > reach + gap)).cast("int")).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_i").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_i")


def gaps(merged: DataFrame, keys: tuple[str, ...], low: float = 0.0, high: float = 1.0, least: float = 1e-9) -> DataFrame:
    """What merged intervals (keys, a, b; disjoint) leave of low to high: gaps longer than ``least``."""
    order = Window.partitionBy(*keys).orderBy("a")
    beside = merged.withColumn("_before", F.coalesce(F.lag("b").over(order), F.lit(low))).withColumn("_last", F.lead("a").over(order).isNull())
    gap = lambda a, b: F.struct(F.greatest(a, F.lit(low)).alias("a"), F.least(b, F.lit(high)).alias("b"))
    around = F.array(gap(F.col("_before"), F.col("a")), F.when(F.col("_last"), gap(F.col("b"), F.lit(high))))
    return beside.select(*keys, F.explode(around).alias("_x")).select(*keys, "_x.a", "_x.b").filter(F.col("b") - F.col("a") > least)


def overlaps(merged: DataFrame, keys: tuple[str, ...], fixed: tuple[tuple[float, float], ...]) -> DataFrame:
    """What merged intervals (keys, a, b; disjoint) share with a fixed list of disjoint ones."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in fixed]))
    pairs = merged.select(*keys, "a", "b", each.alias("_y"))
    return pairs.select(*keys, F.greatest("a", "_y.a").alias("a"), F.least("b", "_y.b").alias("b")).filter("b > a")


def swept(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, a, b, both: the stretches of the left intervals (keys, a, b), cut at the ends of the right ones; both: covered by these too.

    A sweep over the ends of both lists with two running counts; no interval is compared with another.
    """
    end = lambda frame, side: frame.select(*keys, F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(n if side == 0 else 0).alias("l"), F.lit(n if side else 0).alias("r")) for c, n in (("a", 1), ("b", -1))])).alias("e")).select(*keys, "e.*")
    ends = end(left, 0).unionByName(end(right, 1)).groupBy(*keys, "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    open_ = ends.select(*keys, F.col("at").alias("a"), F.lead("at").over(order).alias("b"), F.sum("l").over(so_far).alias("_l"), F.sum("r").over(so_far).alias("_r"))
    return open_.filter("_l > 0 and b > a").select(*keys, "a", "b", (F.col("_r") > 0).alias("both"))


def small_gaps_closed(merged: DataFrame, keys: tuple[str, ...], near: float | Column) -> DataFrame:
    """Merged intervals (keys, a, b; disjoint) with gaps, and ends at 0 and 1, of less than ``near`` closed."""
    order = Window.partitionBy(*keys).orderBy("a")
    before = F.lag("b").over(order)
    numbered = merged.withColumn("_new", (before.isNull() | ~(F.col("a") - before < near)).cast("int")).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy(*keys, "_i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return joined.select(*keys, F.when(F.col("a") < near, 0.0).otherwise(F.col("a")).alias("a"), F.when(1 - F.col("b") < near, 1.0).otherwise(F.col("b")).alias("b"))


def running_length(vertices: DataFrame, keys: tuple[str, ...], step: Column) -> DataFrame:
    """Adds cum_m. ``step`` is the distance to the vertex before, from prev_lon and prev_lat."""
    along = Window.partitionBy(*keys).orderBy("idx")
    before = vertices.withColumn("prev_lon", F.lag("lon").over(along)).withColumn("prev_lat", F.lag("lat").over(along))
    return before.withColumn("cum_m", F.sum(F.coalesce(step, F.lit(0.0))).over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("prev_lon", "prev_lat")


def midpoint_stretches(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Stretches (keys, part, a, b) extended to the middle of the gap to their neighbours, the outer ones to 0 and 1."""
    order = Window.partitionBy(*keys).orderBy("a", "b", "part")
    low = F.coalesce((F.lag("b").over(order) + F.col("a")) / 2, F.lit(0.0))
    high = F.coalesce((F.col("b") + F.lead("a").over(order)) / 2, F.lit(1.0))
    return parts.select(*keys, "part", low.alias("from_f"), high.alias("to_f"))


def route_names(members: DataFrame) -> DataFrame:
    """route, name: the two streets with the most homes, parts of a split street together. members: route, street, residences."""
    totals = members.select("route", text.base_name(F.col("street")).alias("street"), "residences").groupBy("route", "street").agg(F.sum("residences").alias("n"))
    best = totals.filter("n > 0").withColumn("_r", F.row_number().over(Window.partitionBy("route").orderBy(F.col("n").desc(), "street"))).filter("_r <= 2")
    return best.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "street"))), lambda x: x["street"]), " & ").alias("name"))


def runs(samples: DataFrame, keys: tuple[str, ...], order: str, same: tuple[str, ...]) -> DataFrame:
    """Consecutive samples that agree in ``same``: keys, run, same, first, last, n. Samples with a null there break a run."""
    along = Window.partitionBy(*keys).orderBy(order)
    change = F.lit(False)
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(along))
    numbered = samples.withColumn("_new", F.when(F.row_number().over(along) == 1, 1).otherwise(change.cast("int"))).withColumn("run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    present = F.lit(True)
    for c in same:
        present = present & F.col(c).isNotNull()
    return numbered.filter(present).groupBy(*keys, "run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def as_points(vertices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Fragments as arrays of points again. vertices: keys, idx, lon, lat."""
    return vertices.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda v: point(v["lon"], v["lat"])).alias("points"))
