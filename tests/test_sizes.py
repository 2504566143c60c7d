"""What queries do on tables larger than those of the catalog's test."""

import math

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from roadloom import catalog
from roadloom.operators import junctions, linear, network, paths, roads, spatial, splits
from roadloom.plans import walk_queries
from roadloom.streaming import progress


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crossing_vertices(spark):
    return spark.range(4).select(F.col("id").alias("line"), F.explode(F.array(*map(F.lit, range(3)))).alias("idx")).selectExpr("line", "idx", "idx * 100.0D as pos", "idx * 0.01D as lon", "52.8D as lat")


def test_shared_vertices_are_not_broadcast(spark):
    assert "Broadcast" not in planned(junctions.shared_vertices(crossing_vertices(spark), 52.8))


def test_touching_ends_are_not_broadcast(spark):
    assert "Broadcast" not in planned(junctions.touching_ends(crossing_vertices(spark), 52.8))


def differing(spark, folder, name, keys):
    """Rows of a query over customers of these keys that its SQL lacks, and the other way round."""
    customers = spark.createDataFrame([(k, f"Customer#{k}", 3, "MACHINERY") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    customers.coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, keys[0])], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    connection = duckdb.connect()
    for table in ("customer", "orders"):
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = connection.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return set(want.fetchall()) ^ {tuple(r) for r in catalog.queries()[name](spark, str(folder)).select(*columns).collect()}


def test_homes_of_roads_whose_grid_begins_again(spark, tmp_path):
    # one street, ward and place on the grid, but only the first has homes in the index
    assert not differing(spark, tmp_path, "attach_homes", [4, 4 + 80000])


def test_segments_as_far_in_micrometres_tie(spark):
    segments = spark.createDataFrame([(2, -2.1, 52.8, -2.09, 52.8), (1, -2.1, 52.8 - 1e-13, -2.09, 52.8 - 1e-13)], "seg int, a_lon double, a_lat double, b_lon double, b_lat double")
    # a hundred metres above both, and at the radius of near ones but for less than a micrometre
    points = spark.createDataFrame([(0, -2.095, 52.8 + 100 / 110540), (1, -2.095, 52.8 + (40 - 1e-9) / 110540)], "pt int, lon double, lat double")
    assert {(r.pt, r.seg, r.far) for r in spatial.match_homes(points, segments, 52.8).collect()} == {(0, 1, True), (1, 1, True)}


def test_steps_on_roads_whose_grid_begins_again(spark, tmp_path):
    assert not differing(spark, tmp_path, "step_tokens", [5, 16005])


def test_places_near_lines_of_their_own_are_not_broadcast(spark):
    points = spark.range(4).selectExpr("id as road", "id as pt", "id * 0.01D as lon", "52.8D as lat")
    segments = spark.range(4).selectExpr("id as road", "id as seg", "0.0D as from_m", "0.0D as a_lon", "52.8D as a_lat", "0.1D as b_lon", "52.8D as b_lat")
    assert "Broadcast" not in planned(linear.nearest_of_own(points, segments, ("road",), 52.8, 3.0))


def test_crowded_vertices_meet_few_ends(spark):
    # 400 roads 1 m apart and 3 more on one spot: the ring that is searched is far narrower than 600 m, and no end is lost
    spots = [(i, -2.1 + (i % 20) / 67000, 52.8 + i // 20 / 111320) for i in range(400)] + [(1000 + i, -2.09, 52.8) for i in range(3)]
    vertices = spark.createDataFrame(spots, "road int, lon double, lat double")
    ends = spark.createDataFrame([(road, road, lon + 1e-7, lat) for road, lon, lat in spots], "end int, road int, lon double, lat double")
    placed = vertices.selectExpr("road as other", "lon as _lon", "lat as _lat")
    assert spatial._ring_share(placed, 0.01) <= 1 / 64
    x = 111320 * math.cos(math.radians(52.8))
    want = {}
    for road, lon, lat in spots:
        far = [(math.sqrt(((lon + 1e-7 - b) * x) ** 2 + ((lat - c) * 111320) ** 2), a) for a, b, c in spots if a != road]
        want[road] = min((round(d, 6), a) for d, a in far if d <= 600)
    got = {r.end: (round(r.dist, 6), r.other) for r in spatial.nearest_vertices(ends, vertices, 52.8, 600.0, 0.01).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and [got[1000 + i][1] for i in range(3)] == [1001, 1000, 1000]


def test_a_fix_meets_one_leg_of_its_track(spark):
    # with the place in the join's keys no fix is compared with all legs of its track
    fixes, _ = walk_queries.walker_fixes(spark, "/root/testdata/sf0.001")
    joins = [line for line in planned(fixes).splitlines() if "Join" in line]
    assert any("_at#" in line and "_j#" in line for line in joins)


def test_a_walker_has_one_timer_for_what_came_together(spark):
    class Handle:
        timers, rows = [], []

        def registerTimer(self, ms):
            self.timers.append(ms)

        def appendList(self, rows):
            self.rows.extend(rows)

    scorer = progress._Scorer()
    scorer.handle = scorer.held = Handle()
    names = [c.split()[0] for c in progress.MET.split(", ")]
    given = pd.DataFrame([(1, i, pd.Timestamp(1000 + i, unit="s"), 5.0, *[None] * 7) for i in range(500)], columns=names)
    assert list(scorer.handleInputRows((1,), iter([given]), None)) == []
    assert Handle.timers == [1_000_000] and len(Handle.rows) == 500


def test_components_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    turns = []
    write = network.Rounds.write
    monkeypatch.setattr(network.Rounds, "write", lambda self, df: turns.append(1) or write(self, df))
    nodes = spark.range(43).withColumnRenamed("id", "node")
    pairs = spark.range(39).selectExpr("id as src", "id + 1 as dst")
    got = {r.node: r.component for r in network.connected(nodes, pairs.union(pairs.select("dst", "src"))).collect()}
    assert got == {n: 0 if n < 40 else n for n in range(43)}
    assert len(turns) <= 16


def test_relaxation_broadcasts_only_what_is_counted(spark, monkeypatch):
    plans = []
    write = network.Rounds.write
    monkeypatch.setattr(network, "SMALL_ROWS", -1, raising=False)
    monkeypatch.setattr(network.Rounds, "write", lambda self, df: plans.append(planned(df)) or write(self, df))
    ways = spark.range(5).selectExpr("id as edge", "id as src", "id + 1 as dst", "1.0D as length_m")
    starts = spark.createDataFrame([(0, 0, 0.0)], "walk int, node long, dist_m double")
    limits = spark.createDataFrame([(0, 3.0)], "walk int, most_m double")
    assert {(r.node, r.dist_m) for r in network.relaxed(ways, starts, limits=limits).collect()} == {(n, float(n)) for n in range(4)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_stretches_of_one_file_are_many_tasks(spark):
    assert catalog.queries()["done_and_half_done"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_islands_are_told_in_passing(spark):
    spots = [(1, p, 1000.0) for p in (10.0, 10.0, 260.0, 511.0, 900.0)] + [(2, 5.0, 20.0), (2, None, 20.0)]
    found = roads.islands(spark.createDataFrame(spots, "road int, pos double, len double"), ("road",), "len")
    assert "Aggregate" not in planned(found)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 0.0, 290.0, 3), (1, 2, 481.0, 541.0, 1), (1, 3, 870.0, 930.0, 1), (2, 1, 0.0, 20.0, 1), (2, 2, 0.0, 20.0, 1)}


def test_areas_gather_no_arrays(spark):
    ends = [(road, frag, i, -2.1 + (frag * 700 + 100 * i) / 67305, 52.8) for road in ("A", None) for frag in (0, 1) for i in (0, 1)]
    found = splits.split_disconnected(spark.createDataFrame(ends, "road string, frag int, idx int, lon double, lat double"), 52.8, 650.0)
    assert "Aggregate" not in planned(found)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(str((road, frag, 1, 1)) for road in ("A", None) for frag in (0, 1))


def test_ways_are_not_broadcast(spark):
    edges = spark.createDataFrame([(1, 10, 11, "A", 100.0), (2, 11, 12, "B", 100.0)], "edge long, a long, b long, street string, length_m double")
    shapes = edges.selectExpr("edge", "inline(array(struct(0 as idx, 0.0D as pos, edge * 0.01D as lon, 52.8D as lat), struct(1 as idx, 100.0D as pos, edge * 0.01D + 0.0015D as lon, 52.8D as lat)))")
    place = lambda e, *more: edges.filter(f"edge = {e}").selectExpr("cast(length_m * 0 as int) as walk", *more, "edge", "a", "b", "street", "40.0D as s", "length_m", "5.0D as d", "0.0D as p_lon", "52.8D as p_lat")
    starts, targets = place(1), place(2, "0 as target")
    ways, pieces = paths.ways_to(starts, targets, edges, shapes, paths.shortest(edges, paths.start_nodes(starts)))
    assert "Broadcast" not in planned(ways) + planned(pieces)
    assert [round(r.dist_m) for r in ways.collect()] == [110] and [r.street for r in pieces.orderBy("seq").collect()] == ["A", "B"]


def test_tours_of_few_bytes_are_many_tasks(spark):
    assert walk_queries.walk_tours(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
