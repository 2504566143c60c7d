"""Graph operators over adjacency: components and distances by rounds of joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.functions.geo import metres


class Rounds:
    """Written tables that cut the lineage of a loop, in the folder ``spark.checkpoint.dir`` names."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="roadloom-")
            self.spark.conf.set("spark.checkpoint.dir", base)
        self.base, self.turn = f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.turn += 1
        df.write.parquet(f"{self.base}/{self.turn}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{self.turn}")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Groups of these keys over all tasks: few bytes would be joined into one task, however much work there is in each group."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def large(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast.

    Spark takes rows that a column was exploded into for as many as there were before, and would send millions of
    them through the driver as a small table.
    """
    return df.hint("merge")


#: A written table of at most so many rows is broadcast; loops do so in every round, so it is a MB or two.
SMALL_ROWS = 20_000


def counted(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join with so many rows: broadcast if they are few, else never."""
    return F.broadcast(df) if rows <= SMALL_ROWS else large(df)


def _roots(parents: DataFrame, rounds: Rounds) -> DataFrame:
    """node, up of a forest (node, up; lesser ones up, roots their own), with the root of each node: pointers double until none moves."""
    parents = rounds.write(parents)
    while True:
        above = counted(parents.select(F.col("node").alias("_n"), F.col("up").alias("_up")), parents.count())
        jumped = rounds.write(parents.join(above, F.col("up") == F.col("_n")).select("node", F.col("_up").alias("up"), (F.col("_up") != F.col("up")).alias("moved")))
        moved = jumped.filter("moved").limit(1).count()
        parents = jumped.select("node", "up")
        if not moved:
            return parents


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node). nodes: node; edges: src, dst in both directions.

    Each node with edges points to the least of its neighbours and itself, and all nodes go into the roots of these
    pointers. Of what is left with edges each round leaves half at most, and it finds roots by doubling, so the number of rounds
    and of their joins grows with logarithms, not with a component's diameter.
    """
    rounds = Rounds(nodes)
    labels = rounds.write(nodes.select("node", F.col("node").alias("component")))
    known = edges.join(large(labels.select(F.col("node").alias("_a"))), F.col("src") == F.col("_a"), "left_semi").join(large(labels.select(F.col("node").alias("_b"))), F.col("dst") == F.col("_b"), "left_semi")
    links = rounds.write(known.filter("src <> dst").select("src", "dst"))
    while links.count():
        roots = _roots(links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_low")).select("node", F.least("node", "_low").alias("up")), rounds)
        rows = roots.count()
        to = lambda c: counted(roots.select(F.col("node").alias(f"_{c}"), F.col("up").alias(f"_{c}_up")), rows)
        merged = links.join(to("src"), F.col("src") == F.col("_src")).join(to("dst"), F.col("dst") == F.col("_dst")).filter("_src_up <> _dst_up")
        links = rounds.write(merged.select(F.col("_src_up").alias("src"), F.col("_dst_up").alias("dst")).distinct())
        labels = rounds.write(labels.join(to("label"), F.col("component") == F.col("_label"), "left").select("node", F.coalesce("_label_up", "component").alias("component")))
    return labels


#: After so many rounds the tables of what came nearer are one table again; after the most it fails.
COMPACT_ROUNDS, MOST_ROUNDS = 8, 100_000


def _least(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, layers).groupBy("walk", "node").agg(F.min("m").alias("m"))


def relaxed(ways: DataFrame, starts: DataFrame, most_rounds: int = MOST_ROUNDS, limits: DataFrame | None = None) -> DataFrame:
    """walk, node, dist_m, prev, edge: the least distance of every node that a walk reaches, and the node and edge that it came by.

    ways: edge, src, dst, length_m, one way; starts: walk, node, dist_m, where prev and edge are null. limits: walk, most_m, beyond which
    a walk doesn't go on. Ties go to the least edge. All walks relax in the same rounds; a round reads the nodes that came nearer in the one before and writes those that
    come nearer in it. It fails if some still do after the last.
    """
    rounds = Rounds(ways)
    ways = rounds.write(ways.select("edge", F.col("src").alias("_from"), F.col("dst").alias("_to"), "length_m"))
    kind = starts.schema["node"].dataType
    first = starts.select("walk", "node", "dist_m", F.lit(None).cast(kind).alias("prev"), F.lit(None).cast(ways.schema["edge"].dataType).alias("edge"))
    fresh = rounds.write(first.groupBy("walk", "node").agg(F.min(F.struct("dist_m", "edge", "prev")).alias("m")))
    layers, rows = [fresh], fresh.count()
    for _ in range(most_rounds):
        step = F.struct((F.col("m.dist_m") + F.col("length_m")).alias("dist_m"), "edge", F.col("node").alias("prev"))
        reached = ways.join(counted(fresh, rows), F.col("node") == F.col("_from")).select("walk", F.col("_to").alias("node"), step.alias("new")).groupBy("walk", "node").agg(F.min("new").alias("new"))
        if limits is not None:
            reached = reached.join(large(limits.select("walk", "most_m")), "walk").filter("new.dist_m <= most_m").drop("most_m")
        reached = rounds.write(reached)
        met = reached.count()
        best = reduce(DataFrame.union, layers).join(counted(reached.select("walk", "node"), met), ["walk", "node"], "left_semi").groupBy("walk", "node").agg(F.min("m.dist_m").alias("_d"))
        fresh = rounds.write(reached.join(counted(best, met), ["walk", "node"], "left").filter("_d is null or new.dist_m < _d").select("walk", "node", F.col("new").alias("m")))
        rows = fresh.count()
        if not rows:
            return _least(layers).select("walk", "node", "m.dist_m", "m.prev", "m.edge")
        layers.append(fresh)
        if len(layers) > COMPACT_ROUNDS:
            layers = [rounds.write(_least(layers))]
    raise RuntimeError(f"distances still change after {most_rounds} rounds")


def network_distances(roads: DataFrame, edges: DataFrame, entries: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """road, dist_m: shortest distances where a hop costs the whole length of the road entered.

    roads: road, length_m; edges: src, dst; entries: road, dist_m. Roads that no path reaches have none.
    """
    sized = roads.select(F.col("road").alias("_r"), "length_m")
    ways = edges.join(sized, F.col("dst") == F.col("_r")).select(F.struct("src", "dst").alias("edge"), "src", "dst", "length_m")
    found = relaxed(ways, entries.select(F.lit(0).alias("walk"), F.col("road").alias("node"), "dist_m"), most_rounds)
    return found.select(F.col("node").alias("road"), "dist_m")


def hub_distances(roads: DataFrame, segments: DataFrame, edges: DataFrame, hubs: DataFrame, lat0: float, entry_m: float = 250.0) -> DataFrame:
    """road, hub, dist_m: how far each road of a hub is from it over the roads of that hub.

    roads: road (unique), hub, length_m; segments: road, a_lon, a_lat, b_lon, b_lat; edges: src, dst in both directions; hubs: hub, lon, lat. A walk
    enters by the roads whose nearest place is within ``entry_m`` of the hub, or by the nearest one of all (ties: the first) if there is
    none. Roads that no walk reaches are as far as the crow flies.
    """
    met = roads.select("road", "hub", "length_m").join(segments, "road").join(hubs, "hub")
    dx, dy = F.col("b_lon") - F.col("a_lon"), F.col("b_lat") - F.col("a_lat")
    square = dx * dx + dy * dy
    # the nearest place of a segment is found in degrees, and only its distance in metres
    t = F.when(square > 0, F.least(F.greatest(((F.col("lon") - F.col("a_lon")) * dx + (F.col("lat") - F.col("a_lat")) * dy) / square, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    far = metres(F.col("lon"), F.col("lat"), F.col("a_lon") + dx * t, F.col("a_lat") + dy * t, F.lit(lat0))
    crow = Rounds(roads).write(met.groupBy("road", "hub").agg(F.min(far).alias("crow")))
    near = crow.filter(F.col("crow") <= entry_m).select("road", "hub", F.col("crow").alias("dist_m"))
    alone = crow.join(near.select("hub").distinct(), "hub", "left_anti").groupBy("hub").agg(F.min(F.struct("crow", "road")).alias("m")).select("m.road", "hub", F.col("m.crow").alias("dist_m"))
    owner = roads.select(F.col("road").alias("_s"), F.col("hub").alias("_h"))
    other = roads.select(F.col("road").alias("_d"), F.col("hub").alias("_g"))
    inner = edges.join(owner, F.col("src") == F.col("_s")).join(other, F.col("dst") == F.col("_d")).filter("_h = _g").select("src", "dst")
    found = network_distances(roads, inner, near.unionByName(alone)).select(F.col("road").alias("_f"), "dist_m")
    return crow.join(found, F.col("road") == F.col("_f"), "left").select("road", "hub", F.coalesce("dist_m", "crow").alias("dist_m"))
