"""Directions of routes: worked sentences, homes by side, very short roads, and routes that fail without harming others."""

import math

from roadloom.operators import directions, edges

KX = 111320 * math.cos(math.radians(52.8))


def ll(x, y):
    return -2.1 + x / KX, 52.8 + y / 110540


def made(spark, routes, lines, homes=None, half=None, around=None):
    """routes: name -> (kind, start or None, label, start_kind); lines: (route, road) -> (street, residences, points)."""
    r = spark.createDataFrame([(k, kind, *(ll(*s) if s else (None, None)), label, sk) for k, (kind, s, label, sk) in routes.items()], "route string, kind string, start_lon double, start_lat double, start_label string, start_kind string")
    roads = spark.createDataFrame([(route, road, street, float(n)) for (route, road), (street, n, _) in lines.items()], "route string, road string, street string, residences double")
    v = spark.createDataFrame([(route, road, road, i, *(ll(*p) if p else (float("nan"), 1.0))) for (route, road), (*_, points) in lines.items() for i, p in enumerate(points)], "route string, road string, line string, idx int, lon double, lat double")
    h = half and spark.createDataFrame([(road, n, side, i, *ll(*p)) for n, (road, side, points) in enumerate(half) for i, p in enumerate(points)], "road string, piece int, side string, idx int, lon double, lat double")
    return directions.add_directions(r, roads, v, 52.8, homes, h, around)


GOOD = {("A", "a1"): ("Long Road (part 1)", 20, [(0, 0), (200, 0)]), ("A", "a2"): ("Side Lane", 6, [(100, 5), (100, 105)]), ("A", "a3"): ("Stub", 2, [(150, 9), (151, 9)])}
BAD = {
    ("N", "n"): ("Nan Street", 3, [(0, 0), None, (100, 0)]), ("S", "s"): ("Sliver", 3, [(0, 1), (1, 1)]), ("P", "p"): ("Point", 3, [(0, 2)]), ("L", "l"): ("Lost Start", 3, [(0, 3), (90, 3)]),
}
ROUTES = {"A": ("walk", (0, -10), "The Inn", "hub"), "N": ("walk", (0, 0), "x", "hub"), "S": ("walk", (0, 0), "x", "hub"), "P": ("walk", (0, 0), "x", "hub"), "L": ("walk", None, "x", "hub"), "E": ("walk", (0, 0), "x", "hub")}


def test_a_failed_route_leaves_an_error_and_all_others_as_they_are(spark):
    alone = made(spark, {"A": ROUTES["A"]}, GOOD)
    want = sorted(map(str, alone.legs.collect())), alone.stats.collect()
    assert alone.errors.collect() == []
    both = made(spark, ROUTES, GOOD | BAD)
    assert (sorted(map(str, both.legs.collect())), both.stats.collect()) == want
    assert {r.route: (r.stage, r.reason) for r in both.errors.collect()} == {
        "N": ("geometry", "a point without a place"), "S": ("network", "no street is long enough"), "P": ("geometry", "no line of two points"), "L": ("start", "no place to start from"), "E": ("roads", "no roads"),
    }


def test_a_walk_in_words(spark):
    got = made(spark, {"A": ROUTES["A"]}, GOOD)
    legs = [r for r in got.legs.orderBy("n").collect() if r.type == "leg"]
    stats = got.stats.first()
    assert round(sum(r.homes for r in legs), 6) == 28 and round(stats.walk_m) == 2 * 300 and stats.components == 1 and stats.junctions == 1 and round(stats.road_m) == 300
    assert legs[0].cue.startswith("Start at Long Road. Then walk") and legs[-1].end_cue == "That's the route done, and you're back where you started." and legs[0].end_cue is None
    assert any("Includes Stub (a very short road here)." in r.cue for r in legs)
    assert {r.pavement for r in legs} == {"right"} and {r.side for r in legs} <= {f"{s} side" for s in ("north", "south", "east", "west")}
    # up one side and back down the other, turning at the ends
    assert sum("cross over and come back down the other side" in r.cue for r in legs) == stats.crossings


def test_sides_done_and_drives(spark):
    lines = {("A", "a1"): ("Long Road", 20, [(0, 0), (200, 0)])}
    # walked eastwards the southern side is on the right
    half = made(spark, {"A": ("walk", (0, 0), None, "hub")}, lines, half=[("a1", "S", [(0, 0), (200, 0)])])
    legs = half.legs.orderBy("n").collect()
    assert [(r.side, round(r.homes, 6), r.already_done) for r in legs] == [("south side (already done)", 0, True), ("north side", 20, False)]
    drive = made(spark, {"A": ("drive", (0, 60), "Long Road (part 2)", "parking"), "B": ("drive", (0, 0), "Long Road", "spot")}, {("A", "a1"): ("Long Road", 3, [(0, 0), (200, 0)]), ("B", "b1"): ("Other Road", 30, [(0, 1), (200, 1)])})
    told = {}
    for r in drive.legs.orderBy("n").collect():
        told.setdefault(r.route, []).append(r)
    a = [r for r in told["A"] if r.type == "leg"]
    assert [r.pavement for r in a] == ["both", "back"] and a[0].cue == "Park on Long Road. Drive to Long Road (about 60 m, nothing to deliver on the way). Then drive east along Long Road. Deliver both sides as you go." and a[0].homes == 3
    assert a[1].cue == "At the end of Long Road, turn round and head back along Long Road. Both sides are already done." and [round(r.length_m) for r in told["A"] if r.type == "transfer"] == [60]
    assert [r.pavement for r in told["B"]] == ["right", "right"] and sum(r.homes for r in told["B"]) == 30


def test_walks_to_a_route_follow_the_streets_around(spark):
    """From the inn along two streets and over a gap; and a part that only an absurd way leads to."""
    around = {"Inn Lane": [(-300, 0), (0, 0)], "Unknown Road 7": [(0, 0), (0, 100)], "High Street": [(0, 190), (300, 190)], "Far Loop": [(-300, 0), (-300, -5000), (400, -5000), (400, -60)]}
    streets = spark.createDataFrame([(i, s, 0.0) for i, s in enumerate(around)], "road int, street string, residences double")
    lines = spark.createDataFrame([(i, str(i), k, *ll(*p)) for i, points in enumerate(around.values()) for k, p in enumerate(points)], "road int, line string, idx int, lon double, lat double")
    network = edges.build_network(streets, lines, 52.8)
    # no street leads to the other one but the loop of ten kilometres
    got = made(spark, {"A": ("walk", (-300, 0), "The Inn", "hub"), "B": ("walk", (300, 190), "Stile", "hub")}, {("A", "a"): ("Mill Road", 8, [(300, 190), (300, 290)]), ("B", "b"): ("Brook End", 4, [(400, -55), (500, -55)])}, around=network)
    cues = {r.route: r.cue for r in got.legs.filter("n = 1").collect()}
    # 300 m, 100 m, a gap of 90 m, 300 m; the unknown road is not named
    assert cues["A"].startswith("From The Inn, walk to Mill Road via Inn Lane and High Street (about 790 m, nothing to deliver on the way). Then walk north along Mill Road.")
    assert cues["B"].startswith("From Stile, walk to Brook End (about 260 m, nothing to deliver on the way).")
    assert {r.route: round(r.length_m) for r in got.legs.filter("type = 'transfer'").collect()} == {"A": 790, "B": 265}
