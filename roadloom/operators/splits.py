"""Roads cut into parts. Lines are vertex rows (road, frag, idx, lon, lat, pos), pos in metres along the fragment.

One primitive, ``slices``, makes the geometry of any intervals of fragments; what differs between the operators
is how the intervals come about. Only the orders that depend on what was taken before (chains of fragments,
folds of short parts, groups of close fragments) are small functions over one road's arrays, in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from roadloom.functions.geo import Y_PLAN, effort_weight, metres
from roadloom.operators.roads import COMPLETE, islands, running_length

LINE = ("road", "frag")
# Measured lengths are off by their last bits (2000 m as 1999.9999999999977): what differs by less is the same.
SAME_M = 1e-6


def with_positions(vertices: DataFrame, lat0: float, y: float = Y_PLAN) -> DataFrame:
    """Adds pos to rows (road, frag, idx, lon, lat)."""
    step = metres(F.col("lon"), F.col("lat"), F.col("prev_lon"), F.col("prev_lat"), F.lit(lat0), y)
    return running_length(vertices, LINE, step).withColumnRenamed("cum_m", "pos")


def lengths(vertices: DataFrame) -> DataFrame:
    """road, frag, length_m."""
    return vertices.groupBy(*LINE).agg(F.max("pos").alias("length_m"))


def slices(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """road, frag, part, a, b, idx, lon, lat: the vertices of each interval (road, frag, part, a, b), ends interpolated."""
    along = Window.partitionBy(*LINE).orderBy("idx")
    segments = vertices.withColumn("_end", F.lead("pos").over(along)).withColumn("_lon", F.lead("lon").over(along)).withColumn("_lat", F.lead("lat").over(along)).filter(F.col("_end").isNotNull())
    met = wanted.join(segments, list(LINE)).filter((F.col("pos") <= F.col("b")) & (F.col("_end") >= F.col("a")))

    def at(x: Column) -> Column:
        t = F.when(F.col("_end") > F.col("pos"), (x - F.col("pos")) / (F.col("_end") - F.col("pos"))).otherwise(0.0)
        return F.struct(x.alias("pos"), (F.col("lon") + (F.col("_lon") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("_lat") - F.col("lat")) * t).alias("lat"))

    low, high = F.greatest(F.col("a"), F.col("pos")), F.least(F.col("b"), F.col("_end"))
    points = met.select(*LINE, "part", "a", "b", F.explode(F.array(at(low), at(high))).alias("p")).select(*LINE, "part", "a", "b", F.round("p.pos", 6).alias("_p"), "p.lon", "p.lat")
    once = points.groupBy(*LINE, "part", "a", "b", "_p").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"))
    order = Window.partitionBy(*LINE, "part").orderBy("_p")
    return once.withColumn("idx", F.row_number().over(order) - 1).drop("_p")


def remaining_paths(vertices: DataFrame, done: DataFrame, least_m: float = 5.0) -> DataFrame:
    """Pieces that no done interval (road, frag, a, b in metres, disjoint) covers; shorter ones than five metres go."""
    order = Window.partitionBy(*LINE).orderBy("a")
    gaps = done.select(*LINE, F.coalesce(F.lag("b").over(order), F.lit(0.0)).alias("x"), F.col("a").alias("y"))
    tails = lengths(vertices).join(done.groupBy(*LINE).agg(F.max("b").alias("x")), list(LINE), "left").select(*LINE, F.coalesce("x", F.lit(0.0)).alias("x"), F.col("length_m").alias("y"))
    free = gaps.unionByName(tails).filter(F.col("y") - F.col("x") >= least_m)
    numbered = free.withColumn("part", F.row_number().over(Window.partitionBy(*LINE).orderBy("x")) - 1)
    return slices(vertices, numbered.select(*LINE, "part", F.col("x").alias("a"), F.col("y").alias("b")))


def part_names(parts: DataFrame, taken: DataFrame, root: str = "road") -> DataFrame:
    """Adds name: ``X (part n)``, numbered on past names that are taken. parts: root, n from 0; taken: road."""
    name = lambda n: F.format_string("%s (part %d)", F.col(root), n)
    used = taken.select(F.regexp_extract("road", r"^(.*) \(part (\d+)\)$", 1).alias("_r"), F.regexp_extract("road", r"^(.*) \(part (\d+)\)$", 2).try_cast("int").alias("_u")).filter("_r <> ''").groupBy("_r").agg(F.collect_set("_u").alias("_used"))
    joined = parts.join(used, F.col(root) == F.col("_r"), "left")
    count = F.max("n").over(Window.partitionBy(root)) + 1
    free = F.array_except(F.sequence(F.lit(1), (count + F.coalesce(F.size("_used"), F.lit(0))).cast("int")), F.coalesce("_used", F.array().cast("array<int>")))
    return joined.withColumn("_free", free).withColumn("name", name(F.element_at("_free", (F.col("n") + 1).cast("int")))).drop("_r", "_used", "_free")


def trim_to_homes(roads: DataFrame, vertices: DataFrame, homes: DataFrame, gap_m: float = 250.0, margin_m: float = 30.0, keep_if_over: float = 0.85) -> DataFrame:
    """road, frag, part, a, b, residences of the stretches with homes, for the roads worth trimming.

    roads: road, status, residences; homes: road, frag, pos. Roads without homes, finished ones, and those of
    which 85 % would stay are not among them. A stretch's residences are its share of the homes placed.
    """
    open_roads = roads.filter((F.coalesce("status", F.lit("")) != COMPLETE) & (F.col("residences") > 0))
    sized = lengths(vertices)
    found = islands(homes.join(sized, list(LINE)), LINE, "length_m", gap_m, margin_m)
    kept = found.groupBy("road").agg(F.sum(F.col("to_m") - F.col("from_m")).alias("_kept"))
    whole = sized.groupBy("road").agg(F.sum("length_m").alias("_whole"))
    placed = homes.groupBy("road").agg(F.count("*").alias("_placed"))
    worth = open_roads.join(kept, "road").join(whole, "road").join(placed, "road").filter(F.col("_kept") < keep_if_over * F.col("_whole") - SAME_M)
    numbered = found.join(worth.select("road", "residences", "_placed"), "road").withColumn("part", F.row_number().over(Window.partitionBy("road").orderBy("frag", "from_m")) - 1)
    return numbered.select(*LINE, "part", F.col("from_m").alias("a"), F.col("to_m").alias("b"), (F.col("residences") * F.col("homes") / F.col("_placed")).alias("residences"))


def parts_needed(effort: Column, target: float, most: float | None = None) -> Column:
    """In how many parts a road goes: as few as keep each under the target; with a maximum, each nearest the target."""
    if most is None:
        return F.ceil(effort / target).cast("int")
    return F.greatest(F.floor(effort / target + 0.5), F.ceil(effort / most)).cast("int")


def oversized(roads: DataFrame, target: float = 150.0, strict: bool = False, by_effort: bool = False, most: float | None = None) -> DataFrame:
    """road, k of the roads too big for one route, to be cut in k parts: by homes under strict sizes, by effort where asked; else none.

    roads: road, status, residences (left), length_m.
    """
    homes = F.when((F.coalesce("status", F.lit("")) != COMPLETE) & (F.col("residences") > 0) & (F.col("length_m") > 0), F.col("residences").cast("double")).otherwise(0.0)
    effort = homes * effort_weight(F.col("residences").cast("double"), F.col("length_m")) if by_effort else homes
    limit = None if not strict else math.floor(1.25 * target + 0.5) if most is None else most
    return roads.select("road", parts_needed(effort, target, limit).alias("k")).filter((F.col("k") >= 2) & F.lit(strict or by_effort))


def _chain(fragments: list[list[tuple[float, float]]], lat0: float) -> list[tuple[int, bool]]:
    """Fragments end to end: from the end that is farthest out, then always the nearest one, turned if need be."""
    kx = 111320.0 * math.cos(math.radians(lat0))
    far = lambda p, q: math.sqrt(((p[0] - q[0]) * kx) ** 2 + ((p[1] - q[1]) * Y_PLAN) ** 2)
    points = [p for f in fragments for p in f]
    middle = tuple(sum(p[k] for p in points) / len(points) for k in (0, 1))
    ends = [(far(f[0 if first else -1], middle), -i, first) for i, f in enumerate(fragments) for first in (True, False)]
    _, start, first = max(ends)
    out, left = [(-start, not first)], [i for i in range(len(fragments)) if i != -start]
    while left:
        last, turned = out[-1]
        here = fragments[last][0 if turned else -1]
        _, i, flip = min((min(far(here, fragments[i][0]), far(here, fragments[i][-1])), i, far(here, fragments[i][-1]) < far(here, fragments[i][0])) for i in left)
        out.append((i, flip))
        left.remove(i)
    return out


def chained(vertices: DataFrame, lat0: float) -> DataFrame:
    """road, frag, place, turned: the order of a road's fragments as one way."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("idx", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"]))
    lines = vertices.groupBy(*LINE).agg(one.alias("p")).groupBy("road").agg(F.array_sort(F.collect_list(F.struct("frag", "p"))).alias("f"))

    @F.pandas_udf("array<struct<frag:int,place:int,turned:boolean>>")
    def order(fragments: pd.Series) -> pd.Series:
        out = []
        for road in fragments:
            lines = [[tuple(p) for p in f["p"]] for f in road]
            out.append([{"frag": int(road[i]["frag"]), "place": k, "turned": turned} for k, (i, turned) in enumerate(_chain(lines, lat0))])
        return pd.Series(out)

    return lines.select("road", F.explode(order("f")).alias("c")).select("road", "c.frag", "c.place", "c.turned")


def split_evenly(vertices: DataFrame, needed: DataFrame, lat0: float) -> DataFrame:
    """road, frag, part, a, b: equal lengths along the chained fragments. needed: road, k (two or more)."""
    chain = chained(vertices.join(needed.select("road"), "road", "left_semi"), lat0).join(lengths(vertices), list(LINE))
    along = Window.partitionBy("road").orderBy("place")
    placed = chain.withColumn("from", F.coalesce(F.sum("length_m").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("total", F.sum("length_m").over(Window.partitionBy("road")))
    parts = placed.join(needed, "road").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    step = F.col("total") / F.col("k")
    low = F.greatest(F.col("part") * step - F.col("from"), F.lit(0.0))
    high = F.least((F.col("part") + 1) * step - F.col("from"), F.col("length_m"))
    cut = parts.withColumn("_low", low).withColumn("_high", high).filter(F.col("_high") - F.col("_low") > 1e-6)
    a, b = F.when(F.col("turned"), F.col("length_m") - F.col("_high")).otherwise(F.col("_low")), F.when(F.col("turned"), F.col("length_m") - F.col("_low")).otherwise(F.col("_high"))
    return cut.select(*LINE, "part", a.alias("a"), b.alias("b"))


def thinned(fractions: Column, gap: float = 0.08) -> Column:
    """Sorted fractions of which each lies more than the gap beyond the last one kept."""
    keep = lambda acc, f: F.when((F.size(acc) == 0) | (f - F.element_at(acc, -1) > gap), F.concat(acc, F.array(f))).otherwise(acc)
    return F.aggregate(F.array_sort(fractions), F.array().cast("array<double>"), keep)


@F.pandas_udf(ArrayType(DoubleType()))
def folded(cuts: pd.Series, residences: pd.Series, least: pd.Series) -> pd.Series:
    """Cuts that are left when parts with too few homes join the part before (the first one: the part after)."""
    out = []
    for own, homes, few in zip(cuts, residences, least):
        bounds = [0.0, *own, 1.0]
        i = 0
        while i < len(bounds) - 1:
            if homes * (bounds[i + 1] - bounds[i]) < few and len(bounds) > 2:
                del bounds[i + 1 if i == 0 else i]
            else:
                i += 1
        out.append(bounds[1:-1])
    return pd.Series(out)


def split_long(roads: DataFrame, vertices: DataFrame, touching: DataFrame, threshold: float = 100.0, least: float = 40.0, edge: float = 0.08, gap: float = 0.08) -> DataFrame:
    """road, frag, part, a, b, residences: fragments with many homes, cut where other roads end on them.

    roads: road, residences; touching: road, frag, fraction. A fragment's residences are its share of the length.
    """
    sized = lengths(vertices).withColumn("_total", F.sum("length_m").over(Window.partitionBy("road")))
    long = sized.join(roads.select("road", "residences"), "road").withColumn("_homes", F.col("residences") * F.col("length_m") / F.col("_total")).filter(F.col("_homes") > threshold)
    bent = vertices.groupBy(*LINE).agg(F.count("*").alias("_n")).filter("_n >= 3")
    cuts = touching.filter(F.col("fraction").between(edge, 1 - edge)).groupBy(*LINE).agg(thinned(F.collect_set("fraction"), gap).alias("_cuts"))
    kept = long.join(bent, list(LINE)).join(cuts, list(LINE)).withColumn("_cuts", folded("_cuts", "_homes", F.lit(least))).filter(F.size("_cuts") > 0)
    bounds = kept.withColumn("_b", F.concat(F.array(F.lit(0.0)), F.col("_cuts"), F.array(F.lit(1.0))))
    spread = bounds.select(*LINE, "length_m", "_homes", F.posexplode(F.transform(F.slice("_b", F.lit(1), F.size("_b") - 1), lambda x, i: F.struct(x.alias("a"), F.get("_b", i + 1).alias("b")))).alias("_i", "x"))
    return spread.select(*LINE, F.col("_i").alias("part"), (F.col("x.a") * F.col("length_m")).alias("a"), (F.col("x.b") * F.col("length_m")).alias("b"), (F.col("_homes") * (F.col("x.b") - F.col("x.a"))).alias("residences"))


def _areas(ends: list[tuple], kx: float, most_m: float) -> list[int]:
    """The area (from 1) of each fragment of a road, given by its two ends."""
    area = list(range(len(ends)))
    for i in range(len(ends)):
        for j in range(i):
            if area[i] != area[j] and min(math.sqrt(((p[0] - q[0]) * kx) ** 2 + ((p[1] - q[1]) * Y_PLAN) ** 2) for p in ends[i] for q in ends[j]) <= most_m:
                area = [area[j] if x == area[i] else x for x in area]
    number = {a: k + 1 for k, a in enumerate(dict.fromkeys(area))}
    return [number[a] for a in area]


def split_disconnected(vertices: DataFrame, lat0: float, most_m: float = 600.0) -> DataFrame:
    """road, frag, area (from 1), n_areas: fragments whose ends lie within the distance are of one area.

    A task goes over the sorted ends of its roads and carries one road's.
    """
    place = ("idx", "lon", "lat")
    order = Window.partitionBy(*LINE).orderBy(*place)
    marked = vertices.select(*LINE, *place).repartition("road").withColumns({"_first": F.row_number().over(order) == 1, "_last": F.lead(F.lit(1)).over(order).isNull()})
    ends = marked.filter("_first or _last").sortWithinPartitions(*LINE, *place).drop("idx")
    kx = 111320.0 * math.cos(math.radians(lat0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        road, frags, held, types = None, [], [], []

        def told() -> list[tuple]:
            area = _areas(held, kx, most_m)
            most = max(area)
            return [(road, f, a, most) for f, a in zip(frags, area)]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["road", "frag", "area", "n_areas"])

        for batch in batches:
            types, out = [batch.schema.field("road").type, batch.schema.field("frag").type, pa.int32(), pa.int32()], []
            for r, f, lon, lat, first, last in zip(*[c.to_pylist() for c in batch.columns]):
                if frags and r != road:
                    out += told()
                    frags, held = [], []
                road = r
                if first:
                    frags.append(f)
                    held.append(((lon, lat), (lon, lat)))
                if last:
                    held[-1] = (held[-1][0], (lon, lat))
            if out:
                yield packed(out)
        if frags:
            yield packed(told())

    return ends.mapInArrow(run, StructType([*[vertices.schema[c] for c in LINE], StructField("area", IntegerType()), StructField("n_areas", IntegerType())]))
