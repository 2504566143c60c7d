import math

from roadloom.operators import edges, junctions, linear, splits

KX = 111320 * math.cos(math.radians(52.8))


def build(spark, lines):
    rows = [(name, 0, i, -2.1 + x / KX, 52.8 + y / 110540) for name, points in lines.items() for i, (x, y) in enumerate(points)]
    df = spark.createDataFrame(rows, "road string, frag int, idx int, lon double, lat double")
    vertices = splits.with_positions(df, 52.8, 110540.0).selectExpr("road as line", "idx", "lon", "lat", "pos").cache()
    placed = junctions.junctions(vertices, 52.8).cache()
    edges = junctions.network_edges(placed).cache()
    halves = junctions.half_edges(edges, vertices, 52.8).cache()
    return placed, edges, halves, junctions.faces(halves).cache()


def test_square_block_has_two_faces(spark):
    square = {"a": [(0, 0), (200, 0)], "b": [(200, 0), (200, 200)], "c": [(200, 200), (0, 200)], "d": [(0, 200), (0, 0)]}
    placed, edges, halves, faces = build(spark, square)
    assert placed.select("node").distinct().count() == 4 and edges.count() == 4
    got = {}
    for r in faces.collect():
        got.setdefault(r.face, []).append(r.edge)
    assert sorted(map(len, got.values())) == [4, 4]


def test_dead_ends_have_one_face(spark):
    tree = {"a": [(0, 0), (300, 0)], "b": [(150, 8), (150, 200)], "c": [(150, 120), (260, 120)]}
    placed, edges, halves, faces = build(spark, tree)
    # b begins 8 m beside a, and c on b: both lines are cut there
    assert sorted((r.line, round(r.length_m)) for r in edges.collect()) == [("a", 150), ("a", 150), ("b", 80), ("b", 112), ("c", 110)]
    assert faces.select("face").distinct().count() == 1 and faces.count() == 10
    bearings = {(r.forward, round(r.bearing)) for r in halves.join(edges.filter("line = 'c'").select("edge"), "edge").collect()}
    assert bearings == {(True, 90), (False, 270)}


def test_two_networks(spark):
    lines = {"a": [(0, 0), (100, 0)], "b": [(0, 500), (100, 500)], "x": [(0, 500), (100, 560)], "short": [(1000, 0), (1001, 0)]}
    placed, edges, halves, faces = build(spark, lines)
    assert edges.count() == 3 and faces.select("face").distinct().count() == 2


def network(spark, roads, lines, homes=None, half=None):
    ll = lambda x, y: (-2.1 + x / KX, 52.8 + y / 110540)
    r = spark.createDataFrame([(k, street, float(res)) for k, (street, res) in roads.items()], "road int, street string, residences double")
    v = spark.createDataFrame([(road, line, i, *ll(*p)) for (road, line), points in lines.items() for i, p in enumerate(points)], "road int, line string, idx int, lon double, lat double")
    h = homes and spark.createDataFrame([(road, n, *ll(*p)) for n, (road, p) in enumerate(homes)], "road int, pt int, lon double, lat double")
    d = half and spark.createDataFrame([(road, n, side, i, *ll(*p)) for n, (road, side, points) in enumerate(half) for i, p in enumerate(points)], "road int, piece int, side string, idx int, lon double, lat double")
    out = edges.build_network(r, v, 52.8, h, d)
    found = {(e.line, round(e.a_pos)): e for e in out.edges.collect()}
    return found, {r.street for r in out.lost.collect()}, out


def test_residences_go_by_length_or_by_homes(spark):
    roads = {1: ("Long Road (part 2)", 40), 2: ("Side", 12), 3: ("Sliver", 5), 4: ("Nowhere", 7)}
    lines = {(1, "a"): [(0, 0), (100, 0), (400, 0)], (2, "b"): [(100, 6), (100, 106)], (3, "c"): [(390, 40), (391, 40)]}
    found, lost, out = network(spark, roads, lines)
    assert {k: round(e.residences, 6) for k, e in found.items()} == {("a", 0): 10, ("a", 100): 35, ("b", 0): 12}
    assert found["a", 100].includes == ["Sliver"] and found["a", 100].street == "Long Road" and lost == {"Nowhere"}
    assert round(found["a", 0].per_km) == 100 and not found["a", 0].done_left
    # three homes on the first stretch, one on the second, one too far off
    homes = [(1, (20, 3)), (1, (40, -14)), (1, (60, 0)), (1, (300, 5)), (1, (200, 19)), (2, (100, 500))]
    found, lost, out = network(spark, roads, lines, homes)
    assert {k: round(e.residences, 6) for k, e in found.items()} == {("a", 0): 30, ("a", 100): 15, ("b", 0): 12}
    assert sum(e.residences for e in found.values()) == 57


def test_sides_turn_with_the_direction_of_travel(spark):
    roads = {1: ("East", 1), 2: ("West", 1), 3: ("Both", 1)}
    lines = {(1, "e"): [(0, 0), (200, 0)], (2, "w"): [(200, 500), (0, 500)], (3, "b"): [(0, 900), (100, 900), (100, 1000)]}
    half = [(1, "S", [(50, 0), (150, 0)]), (2, "S", [(50, 500), (150, 500)]), (3, "F", [(100, 950), (100, 900), (80, 900)]), (3, "S", [(90, 901), (100, 901), (100, 950)]), (1, "F", [(0, 0), (90, 0)]), (2, "F", [(80, 504), (130, 504)])]
    found, _, _ = network(spark, roads, lines, half=half)
    got = {line: (e.done_left, e.done_right) for (line, _), e in found.items()}
    # S is right of the stretch: of a road the other way, that is its left; a stretch that ends before the middle or lies off counts nothing
    assert got == {"e": (False, True), "w": (True, False), "b": (False, True)}


def test_short_stubs_join_by_their_nearer_end(spark):
    lines = {(1, "a"): [(0, 0), (300, 0)], (2, "stub"): [(150, 4), (150, 19)], (3, "ring"): [(0, 600), (100, 600), (100, 700), (0, 600)]}
    found, _, out = network(spark, {1: ("A", 1), 2: ("Stub", 3), 3: ("Ring", 2)}, lines)
    assert {(line, round(e.length_m)) for (line, _), e in found.items()} == {("a", 150), ("stub", 15), ("ring", 341)}
    assert found["ring", 0].a == found["ring", 0].b and found["stub", 0].a != found["stub", 0].b


def test_nearest_line_is_found_at_any_distance(spark):
    segments = spark.createDataFrame([(1, -2.1, 52.8, -2.1 + 100 / KX, 52.8), (2, -2.1, 52.9, -2.1 + 100 / KX, 52.9)], "seg int, a_lon double, a_lat double, b_lon double, b_lat double")
    points = spark.createDataFrame([(1, -2.1, 52.8 + 30 / 110540), (2, -2.1, 52.8 + 240 / 110540), (3, -2.0, 52.8499), (4, 40.0, 10.0), (5, -2.1, 52.851)], "pt int, lon double, lat double")
    assert {r.pt: r.seg for r in linear.nearest_of_any(points, segments, 52.8).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    assert linear.nearest_of_any(points, segments.limit(0), 52.8).collect() == []
