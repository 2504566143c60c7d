import math

import duckdb
import pytest
from pyspark.sql import functions as F

from roadloom.operators import splits

KX = 111320 * math.cos(math.radians(52.8))


def rows(road, frag, *points):
    """Points in metres east and north of a corner."""
    return [(road, frag, i, -2.1 + x / KX, 52.8 + y / 111320) for i, (x, y) in enumerate(points)]


@pytest.fixture(scope="module")
def lines(spark):
    data = [*rows("A", 0, (0, 0), (300, 0), (300, 400)), *rows("B", 0, (0, 0), (0, 1000)), *rows("B", 1, (0, 2100), (0, 1500)), *rows("B", 2, (0, 4000), (0, 4100))]
    return splits.with_positions(spark.createDataFrame(data, "road string, frag int, idx int, lon double, lat double"), 52.8).cache()


def metric(r):
    return round((r.lon + 2.1) * KX, 2) + 0.0, round((r.lat - 52.8) * 111320, 2) + 0.0


def test_slices(spark, lines):
    wanted = spark.createDataFrame([("A", 0, 0, 100.0, 500.0), ("A", 0, 1, 300.0, 700.0)], "road string, frag int, part int, a double, b double")
    got = {}
    for r in splits.slices(lines, wanted).orderBy("part", "idx").collect():
        got.setdefault(r.part, []).append(metric(r))
    assert got == {0: [(100, 0), (300, 0), (300, 200)], 1: [(300, 0), (300, 400)]}
    done = spark.createDataFrame([("A", 0, 0.0, 200.0), ("A", 0, 203.0, 600.0)], "road string, frag int, a double, b double")
    left = [(r.road, r.frag, round(r.a), round(r.b)) for r in splits.remaining_paths(lines, done).select("road", "frag", "part", "a", "b").distinct().collect()]
    assert sorted(left) == [("A", 0, 600, 700), ("B", 0, 0, 1000), ("B", 1, 0, 600), ("B", 2, 0, 100)]


def test_even_parts_along_the_chain(spark, lines):
    order = {(r.road, r.frag): (r.place, r.turned) for r in splits.chained(lines, 52.8).collect()}
    assert (order["B", 0], order["B", 1], order["B", 2]) == ((0, False), (1, True), (2, False))
    needed = spark.createDataFrame([("B", 2)], "road string, k int")
    got = sorted((r.part, r.frag, round(r.a), round(r.b)) for r in splits.split_evenly(lines, needed, 52.8).collect())
    assert got == [(0, 0, 0, 850), (1, 0, 850, 1000), (1, 1, 0, 600), (1, 2, 0, 100)]
    k = spark.range(1).select(splits.parts_needed(F.lit(301.0), 150).alias("a"), splits.parts_needed(F.lit(370.0), 150, 187.5).alias("b"), splits.parts_needed(F.lit(100.0), 150, 187.5).alias("c")).first()
    assert tuple(k) == (3, 2, 1)


def test_trimming(spark, lines):
    homes = [("B", 0, p) for p in (10.0, 100.0, 340.0, 900.0)] + [("A", 0, float(p)) for p in range(0, 700, 50)]
    roads = spark.createDataFrame([("A", "Not_Started", 14.0), ("B", "In_Progress", 8.0)], "road string, status string, residences double")
    got = splits.trim_to_homes(roads, lines, spark.createDataFrame(homes, "road string, frag int, pos double")).orderBy("part").collect()
    assert [(r.road, r.frag, r.part, round(r.a), round(r.b), r.residences) for r in got] == [("B", 0, 0, 0, 370, 6.0), ("B", 0, 1, 870, 930, 2.0)]


def test_roads_of_which_just_85_percent_would_stay_are_left(spark, tmp_path):
    from roadloom import catalog

    # homes 200 m apart at most; stretches reach from 300 m to the end, from 301 m to the end, from 70 to 1770 m and from the start to 1700 m
    homes = {1: [330, 1999], 2: [331, 1999], 3: [100, 1740], 4: [0, 1670]}
    # the query places an order at o_orderkey * 7919 % 2000
    orders = [(p * pow(7919, -1, 2000) % 2000, road) for road, (first, last) in homes.items() for p in [*range(first, last, 200), last]]
    spark.createDataFrame([(road,) for road in homes], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, catalog.queries()["trimmed_roads"](spark, str(tmp_path)).collect()))
    connection = duckdb.connect()
    for table in ("customer", "orders"):
        connection.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    assert got == sorted(connection.execute(catalog.oracle_sql()["trimmed_roads"]).fetchall()) == [(2, 0, 301.0, 2000.0, 2.0)]


def test_long_roads_fold_short_parts(spark, lines):
    touching = spark.createDataFrame([("A", 0, f) for f in (0.05, 0.2, 0.25, 0.5, 0.9, 0.95)], "road string, frag int, fraction double")
    got = splits.split_long(spark.createDataFrame([("A", 200.0), ("B", 50.0)], "road string, residences double"), lines, touching).orderBy("part").collect()
    assert [(round(r.a), round(r.b), round(r.residences, 6)) for r in got] == [(0, 140, 40.0), (140, 350, 60.0), (350, 700, 100.0)]


def test_areas_and_names(spark, lines):
    got = {(r.road, r.frag): (r.area, r.n_areas) for r in splits.split_disconnected(lines, 52.8).collect()}
    assert got == {("A", 0): (1, 1), ("B", 0): (1, 2), ("B", 1): (1, 2), ("B", 2): (2, 2)}
    parts = spark.createDataFrame([("X", 0), ("X", 1), ("Y", 0)], "road string, n int")
    taken = spark.createDataFrame([("X",), ("X (part 1)",), ("X (part 3)",)], "road string")
    assert sorted(r.name for r in splits.part_names(parts, taken).collect()) == ["X (part 2)", "X (part 4)", "Y (part 1)"]
