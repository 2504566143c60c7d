"""Walks on small networks: ends on one edge, ways that improve late, links over gaps, places out of reach, and drawn lines."""

import math

from pyspark.sql import functions as F

from roadloom.operators import linear, paths

KX = 111320 * math.cos(math.radians(52.8))


def ll(x, y):
    return -2.1 + x / KX, 52.8 + y / 110540


def walked(spark, lines, starts, targets):
    """lines: edge -> (a, b, street, points); starts: walk -> point; targets: (walk, target) -> point."""
    edges = spark.createDataFrame([(e, a, b, s) for e, (a, b, s, _) in lines.items()], "edge long, a long, b long, street string")
    raw = spark.createDataFrame([(e, i, *ll(*p)) for e, (*_, points) in lines.items() for i, p in enumerate(points)], "edge long, idx int, lon double, lat double")
    shapes = linear.with_places(raw, ("edge",), 52.8).cache()
    asked = spark.createDataFrame([((w, -1), *ll(*p)) for w, p in starts.items()] + [(k, *ll(*p)) for k, p in targets.items()], "pt struct<walk:long,target:long>, lon double, lat double")
    met = paths.located(asked, edges, shapes, 52.8).withColumnsRenamed({"lon": "on_lon", "lat": "on_lat"}).join(asked.withColumnsRenamed({"pt": "_pt", "lon": "p_lon", "lat": "p_lat"}), F.col("pt") == F.col("_pt"))
    placed = met.selectExpr("pt.walk", "pt.target", "edge", "a", "b", "street", "s", "length_m", "d", "p_lon", "p_lat").cache()
    begun, ended = placed.filter("target = -1").drop("target"), placed.filter("target >= 0")
    sized = edges.join(shapes.groupBy("edge").agg(F.max("pos").alias("length_m")), "edge")
    reached = paths.shortest(sized, paths.start_nodes(begun)).cache()
    ways, pieces = paths.ways_to(begun, ended, edges, shapes, reached)
    streets = {(r.walk, r.target): r.streets for r in paths.way_streets(pieces).collect()}
    points = {}
    for r in paths.way_lines(pieces, shapes, begun, ended).orderBy("place").collect():
        points.setdefault((r.walk, r.target), []).append((round((r.lon + 2.1) * KX, 3), round((r.lat - 52.8) * 110540, 3)))
    far = {(r.walk, r.node): round(r.dist_m, 3) for r in reached.collect()}
    return {(r.walk, r.target): round(r.dist_m, 3) for r in ways.collect()}, streets, points, far, placed


SQUARE = {
    1: (1, 2, "South", [(0, 0), (100, 0)]), 2: (2, 3, "East", [(100, 0), (100, 100)]), 3: (4, 3, "North", [(0, 100), (50, 120), (100, 100)]), 4: (1, 4, "West", [(0, 0), (0, 100)]),
    5: (3, 5, None, [(100, 100), (200, 100)]), 6: (5, 6, "North", [(200, 100), (300, 100)]), 7: (8, 9, "Away", [(0, 9000), (100, 9000)]),
}


def test_ways_on_a_square(spark):
    ways, streets, points, far, placed = walked(spark, SQUARE, {1: (20, 5)}, {(1, 0): (80, -5), (1, 1): (105, 50), (1, 2): (250, 90), (1, 3): (-10, 60), (1, 4): (50, 9010), (1, 5): (20, 5)})
    assert ways == {(1, 0): 70.0, (1, 1): 140.0, (1, 2): 5 + 80 + 100 + 100 + 50 + 10.0, (1, 3): 5 + 20 + 60 + 10.0, (1, 5): 10.0}
    assert streets == {(1, 0): ["South"], (1, 1): ["South", "East"], (1, 2): ["South", "East", "North"], (1, 3): ["South", "West"], (1, 5): ["South"]}
    assert points[1, 0] == [(20, 5), (20, 0), (80, 0), (80, -5)]
    assert points[1, 2] == [(20, 5), (20, 0), (100, 0), (100, 100), (200, 100), (250, 100), (250, 90)]
    assert points[1, 3] == [(20, 5), (20, 0), (0, 0), (0, 60), (-10, 60)]
    assert (1, 8) not in far and (1, 4) not in points


def test_junctions_improve_late_and_long_ways_are_read_off(spark):
    # a direct edge of 10000 m beside a chain of 60 short ones: junctions behind it are reached soon and improved often
    chain = {i: (i, i + 1, f"S{i // 20}", [(10 * i, 0), (10 * i + 10, 0)]) for i in range(60)}
    bent = {100 + i: (0, 15 * i, "Detour", [(0, 0), (0, 4000 + i), (150 * i, 0)]) for i in range(1, 5)}
    ways, streets, points, far, _ = walked(spark, chain | bent, {1: (5, 0), 2: (595, 0)}, {(1, 0): (595, 1), (2, 0): (5, 1)})
    assert {n: far[1, n] for n in range(1, 61)} == {n: 10 * n - 5 for n in range(1, 61)}
    assert ways == {(1, 0): 591.0, (2, 0): 591.0} and streets == {(1, 0): ["S0", "S1", "S2"], (2, 0): ["S2", "S1", "S0"]}
    assert points[1, 0][1:-1] == [(10 * i, 0) for i in range(1, 60)] + [(595, 0)] and points[2, 0][0] == (595, 0)


def test_distances_of_routes(spark):
    _, _, _, far, placed = walked(spark, SQUARE, {1: (20, 5)}, {})
    edges = spark.createDataFrame([(1, 1, 2, "A"), (4, 1, 4, "A"), (2, 2, 3, "B"), (6, 5, 6, "B"), (3, 4, 3, None), (7, 8, 9, "C")], "edge long, a long, b long, route string")
    reached = spark.createDataFrame([(w, n, d) for (w, n), d in far.items()], "walk long, node long, dist_m double")
    got = {r.route: r.dist_m for r in paths.route_distances(edges, placed.drop("target"), reached).collect()}
    assert {k: round(v, 3) for k, v in got.items()} == {"A": 5.0, "B": 85.0}
