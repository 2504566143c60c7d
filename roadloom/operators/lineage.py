"""Where parts of roads come from: what of its sheet row's own fragments each part covers, however often a road was cut.

A cut is an affine map: the fractions 0 and 1 of a piece are the fractions a and b of the line it was cut from (a > b if it
was turned round). Maps of a chain of cuts compose, and pointers double, so rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.network import Rounds

RANGES = "array<struct<frag:int,a:double,b:double>>"


def origins(cuts: DataFrame) -> DataFrame:
    """line, root, a, b, cuts: each line's place on the line that it comes from in the end, and through how many cuts.

    cuts: line (once), parent, a, b. A parent without a row of its own is a root. Lines in a circle of cuts have no
    root and are left out.
    """
    rounds = Rounds(cuts)
    state = rounds.write(cuts.select("line", F.col("parent").alias("root"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), F.lit(1).cast("long").alias("cuts")))
    most = max(1, state.count())
    reach = 1
    while True:
        up = state.select(F.col("line").alias("_l"), F.col("root").alias("_r"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("cuts").alias("_n"))
        through = lambda f: F.when(F.col("_l").isNull(), F.col(f)).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col(f))
        met = state.join(up, F.col("root") == F.col("_l"), "left")
        state = rounds.write(met.select("line", F.coalesce("_r", "root").alias("root"), through("a").alias("a"), through("b").alias("b"), (F.col("cuts") + F.coalesce("_n", F.lit(0))).alias("cuts"), F.col("_l").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        reach *= 2
        if reach > 2 * most:  # no chain is as long as that: what still moves goes round
            return state.filter("not moved").drop("moved")


def captured(rows: DataFrame) -> DataFrame:
    """root, row_index, fragments, tokens of a road table (road, row_index, fragments, partial_geometry) before anything is cut."""
    return rows.select(F.col("road").alias("root"), "row_index", F.size("fragments").alias("fragments"), F.coalesce("partial_geometry", F.lit("-")).alias("tokens"))


def part_lineage(parts: DataFrame, made: DataFrame, kept: DataFrame) -> DataFrame:
    """road, root_name, row_index, original_ranges, current_partial: of each part of a split road what a report on it writes to its row.

    parts: line, road, place (in the part's own order). made: as of ``origins``, whose roots are lines of ``kept``: root line, root (road), frag.
    A range is of one fragment, from its lesser to its greater fraction.
    """
    lines = kept.select(F.col("line").alias("_line"), F.col("root").alias("root_name"), "frag", "row_index", "tokens")
    met = parts.join(made, "line").join(lines, F.col("root") == F.col("_line"))
    one = F.struct("place", F.struct(F.col("frag").cast("int").alias("frag"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("r"))
    grouped = met.groupBy("road").agg(F.min("root_name").alias("root_name"), F.min("row_index").alias("row_index"), F.array_sort(F.collect_list(one)).alias("_r"), F.min("tokens").alias("current_partial"))
    return grouped.select("road", "root_name", "row_index", F.transform("_r", lambda x: x["r"]).alias("original_ranges"), "current_partial")


def reported_ranges(ranges: DataFrame, fragments: DataFrame) -> DataFrame:
    """root, part, frag, a, b: ranges of parts of rows that were trimmed to homes, so that all parts together are the whole row.

    ranges: root, part (in order), frag, a, b; fragments: root, frag. Within a fragment, parts meet in the middle of the gap between
    them and reach to its ends. A fragment that no part touches goes whole to the first part on the nearest fragment that
    has one, the one before on ties: in one sorted union every fragment sees the last one with parts before it and the next one behind it.
    """
    order = Window.partitionBy("root", "frag").orderBy("a", "b", "part")
    before, after = F.lag("b").over(order), F.lead("a").over(order)
    # ranges that overlap or touch stay as they are
    low = F.when(before.isNull(), 0.0).when(F.col("a") > before, (before + F.col("a")) / 2).otherwise(F.col("a"))
    high = F.when(after.isNull(), 1.0).when(after > F.col("b"), (F.col("b") + after) / 2).otherwise(F.col("b"))
    met = ranges.select("root", "part", "frag", low.alias("a"), high.alias("b"))

    owners = ranges.groupBy("root", "frag").agg(F.min("part").alias("owner"))
    along = Window.partitionBy("root").orderBy("frag")
    back = Window.partitionBy("root").orderBy(F.desc("frag"))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("owner").isNotNull(), F.struct("frag", "owner"))
    seen = fragments.select("root", "frag").join(owners, ["root", "frag"], "left").withColumns({"_p": F.last(known, ignorenulls=True).over(so_far(along)), "_n": F.last(known, ignorenulls=True).over(so_far(back))})
    nearer = F.when(F.col("_n").isNull() | (F.col("frag") - F.col("_p.frag") <= F.col("_n.frag") - F.col("frag")), F.col("_p.owner")).otherwise(F.coalesce("_n.owner", "_p.owner"))
    orphans = seen.filter("owner is null").select("root", nearer.alias("part"), "frag", F.lit(0.0).alias("a"), F.lit(1.0).alias("b")).filter("part is not null")
    return met.unionByName(orphans)


def range_tokens(ranges: Column) -> Column:
    """The tokens that reporting a part done adds to its row."""
    return F.transform(ranges, lambda r: F.format_string("seg%d:%.4f-%.4f:B", r["frag"], r["a"], r["b"]))
