"""Progress written back to rows: tokens of done stretches, their union, and the steps' own tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import parse
from roadloom.functions.geo import X_DEGREE, Y_WALK, on_segment
from roadloom.functions.intervals import LEAST_METRES
from roadloom.operators.network import large
from roadloom.operators.roads import COMPLETE, IN_PROGRESS, merged_intervals, runs, small_gaps_closed, swept
from roadloom.operators.spatial import segment_cells

NEAR_M, ALIGNED, LEAST_RUN_M, SAMPLE_M = 8.0, 0.85, 5.0, 3.0
CELL_M = 32.0


def token_union(existing: Column, added: Column) -> Column:
    """Recorded tokens and then the new ones, each once; a hyphen for none. added: an array of tokens."""
    have = F.when(F.coalesce(existing, F.lit("-")).isin("-", ""), F.array().cast("array<string>")).otherwise(F.split(existing, r"\|"))
    both = F.array_union(have, added)
    return F.when(F.size(both) > 0, F.array_join(both, "|")).otherwise("-")


def recorded_tokens(changes: DataFrame) -> DataFrame:
    """row_index, token, since: the tokens that stand after a log of changes (row_index, at, action add or remove, token).

    A token stands from its first addition after its last removal; at one moment a removal comes after an addition.
    Changes combine before they shuffle.
    """
    gone = changes.filter("action = 'remove'").groupBy(F.col("row_index").alias("_r"), F.col("token").alias("_t")).agg(F.max("at").alias("_gone"))
    added = changes.filter("action = 'add'").join(gone, F.col("row_index").eqNullSafe(F.col("_r")) & (F.col("token") == F.col("_t")), "left")
    return added.filter("_gone is null or at > _gone").groupBy("row_index", "token").agg(F.min("at").alias("since"))


def done_stretches(tokens: DataFrame, fragments: DataFrame) -> DataFrame:
    """row_index, frag, a, b: what is done of each fragment on both sides at once, or on one side and the other.

    tokens: row_index, token; fragments: row_index, frag, length_m (null if unknown, then small gaps stay). Stretches are
    endpoints, and what they cover is a running sum over them in windows: no row's stretches meet in an array.
    """
    keys = ("row_index", "frag", "length_m")
    spans = tokens.select("row_index", F.explode(parse.partial_ranges(F.col("token"))).alias("r")).select("row_index", "r.*")
    spans = spans.join(fragments.select("row_index", "frag", "length_m"), ["row_index", "frag"]).withColumn("length_m", F.when(F.col("length_m") > 0, F.col("length_m")).otherwise(0.0))
    near = F.when(F.col("length_m") > 0, F.lit(LEAST_METRES) / F.col("length_m")).otherwise(0.0)

    def clean(frame: DataFrame) -> DataFrame:
        large = frame.filter((F.col("length_m") == 0) | ((F.col("b") - F.col("a")) * F.col("length_m") >= LEAST_METRES))
        return small_gaps_closed(merged_intervals(large.select(*keys, "a", "b"), keys), keys, near)

    side = lambda s: spans.filter(F.col("side") == s)
    shared = swept(clean(side("S")), clean(side("F")), keys).filter("both").select(*keys, "a", "b")
    return clean(side("B").select(*keys, "a", "b").union(merged_intervals(shared, keys))).select("row_index", "frag", "a", "b")


def row_status(tokens: DataFrame, fragments: DataFrame, told: DataFrame) -> DataFrame:
    """row_index, partial_geometry, status of rows from their tokens (row_index, token, since), recorded ones first.

    told: row_index, complete_at, removed_at (latest moments, or null) for every row with a change. A row is Complete if all of its
    fragments are done, or if a change said so and nothing was removed since; In_Progress with any token.
    """
    done = done_stretches(tokens, fragments).filter("a <= 1e-9 and b >= 1 - 1e-9").groupBy("row_index").agg(F.countDistinct("frag").alias("_done"))
    whole = fragments.groupBy("row_index").agg(F.countDistinct("frag").alias("_all")).join(done, "row_index").filter("_all = _done").select(F.col("row_index").alias("_w"))
    texts = tokens.groupBy(F.col("row_index").alias("_k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("since", "token"))), lambda t: t["token"]), "|").alias("text"))
    rows = told.join(texts, F.col("row_index").eqNullSafe(F.col("_k")), "left").join(whole, F.col("row_index") == F.col("_w"), "left")
    said = F.col("complete_at").isNotNull() & (F.col("removed_at").isNull() | (F.col("complete_at") > F.col("removed_at")))
    status = F.when(F.col("_w").isNotNull() | said, COMPLETE).when(F.col("text").isNotNull(), IN_PROGRESS).otherwise("Not_Started")
    return rows.select("row_index", F.coalesce("text", F.lit("-")).alias("partial_geometry"), status.alias("status"))


def accumulated(changes: DataFrame, fragments: DataFrame) -> DataFrame:
    """row_index, partial_geometry, status after a log of changes (row_index, at, action, token, complete).

    fragments: row_index, frag, length_m of all fragments of the rows. ``complete`` says that a change did all that was left.
    """
    moment = lambda test: F.max(F.when(test, F.col("at")))
    told = changes.groupBy("row_index").agg(moment((F.col("action") == "add") & F.col("complete")).alias("complete_at"), moment(F.col("action") == "remove").alias("removed_at"))
    return row_status(recorded_tokens(changes), fragments, told)


def write_summary(results: DataFrame, *keys: str) -> DataFrame:
    """ok, succeeded, total, errors of write-backs (keys, seq, ok, error)."""
    grouped = results.groupBy(*keys).agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("seq", "error")))).alias("_e"))
    return grouped.select(*keys, (F.col("succeeded") == F.col("total")).alias("ok"), "succeeded", "total", F.array_join(F.transform("_e", lambda x: x["error"]), "; ").alias("errors"))


def step_tokens(lines: DataFrame, segments: DataFrame, lat0: float) -> DataFrame:
    """step, row_index, token: the stretches of rows that walking a step covers.

    lines: step, seq, pavement, a_lon, a_lat, b_lon, b_lat (the step's segments). segments: row_index, frag, a_lon,
    a_lat, b_lon, b_lat, from_m, frag_m. Every three metres of a step snap to the nearest segment within 8 m that
    runs its way; samples in a row on one fragment and in one direction are a stretch, if it has 5 m or more. If both have
    a column net, a step snaps to rows of its own only.
    """
    if "net" not in lines.columns:
        lines, segments = lines.withColumn("net", F.lit(0)), segments.withColumn("net", F.lit(0))
    segments = segments.withColumnRenamed("net", "_net")
    x = F.lit(X_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    vector = lambda: ((F.col("b_lon") - F.col("a_lon")) * x, (F.col("b_lat") - F.col("a_lat")) * Y_WALK)
    dx, dy = vector()
    size = F.sqrt(dx * dx + dy * dy)
    walked = lines.withColumns({"_l": size, "_ux": dx / size, "_uy": dy / size}).filter("_l > 0")
    n = F.greatest(F.lit(1), F.ceil(F.col("_l") / SAMPLE_M)).cast("int")
    samples = walked.withColumn("_n", n).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("_s") / F.col("_n")
    samples = samples.select("step", "net", "pavement", F.struct("seq", "_s").alias("at"), (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * share).alias("lon"), (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * share).alias("lat"), "_ux", "_uy")
    # a segment stands in all cells that it is near to, and a sample in its own: each pair meets once
    cell = lambda v, k: F.floor(v * k / CELL_M).cast("long")
    spread = samples.withColumn("_cx", cell(F.col("lon"), x)).withColumn("_cy", cell(F.col("lat"), F.lit(Y_WALK)))
    met = spread.join(large(segment_cells(segments, lat0, CELL_M, NEAR_M)), (F.col("_cx") == F.col("_sx")) & (F.col("_cy") == F.col("_sy")) & (F.col("net") == F.col("_net")))
    t, dist = on_segment(F.col("lon"), F.col("lat"), F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"), F.lit(lat0))
    sx, sy = vector()
    length = F.sqrt(sx * sx + sy * sy)
    cos = (sx * F.col("_ux") + sy * F.col("_uy")) / length
    hit = F.struct(dist.alias("d"), "row_index", "frag", ((F.col("from_m") + t * length) / F.col("frag_m")).alias("t"), (cos > 0).alias("fwd"), "frag_m")
    snapped = met.filter((length > 0) & (F.abs(cos) >= ALIGNED)).select("step", "at", hit.alias("h")).filter(F.col("h.d") <= NEAR_M).groupBy("step", "at").agg(F.min("h").alias("h"))
    # a sample that snaps to nothing breaks a stretch
    every = samples.select("step", "at", "pavement").join(large(snapped), ["step", "at"], "left").select("step", "at", "pavement", "h.row_index", "h.frag", "h.fwd", "h.t", "h.frag_m")
    found = runs(every, ("step",), "at", ("row_index", "frag", "fwd")).select("step", "run", "first", "last")
    keyed = every.filter("row_index is not null").join(large(found), "step").filter(F.col("at").between(F.col("first"), F.col("last")))
    stretch = keyed.groupBy("step", "run", "pavement", "row_index", "frag", "fwd").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.max("frag_m").alias("frag_m"))
    side = F.when(F.col("pavement") == "both", "B").when((F.col("pavement") == "right") == F.col("fwd"), "S").otherwise("F")
    token = F.format_string("seg%d:%.4f-%.4f:%s", "frag", "a", "b", side)
    return stretch.filter((F.col("b") - F.col("a")) * F.col("frag_m") >= LEAST_RUN_M).select("step", "run", "row_index", token.alias("token"))
