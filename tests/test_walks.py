import math

import pytest

from roadloom.operators import walks
from tests.test_junctions import KX, build


def test_links_join_near_parts_once(spark):
    at = {1: (0, 0), 2: (100, 0), 3: (180, 0), 4: (180, 70), 5: (400, 0), 6: (500, 0), 7: (150, 0)}
    nodes = spark.createDataFrame([(n, -2.1 + x / KX, 52.8 + y / 110540) for n, (x, y) in at.items()], "node long, lon double, lat double")
    edges = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    # 7 has no edge, 5 is too far from 3
    assert [(r.a, r.b, round(r.length_m)) for r in walks.gap_links(nodes, edges, 52.8).collect()] == [(2, 3, 80)]


def test_walks_take_the_shorter_way_and_name_streets_once(spark):
    links = spark.createDataFrame([(1, 2, 10.0, "A"), (2, 3, 10.0, "A"), (1, 3, 25.0, "B"), (3, 4, 5.0, None), (4, 5, 1.0, "A"), (8, 9, 1.0, "Z")], "a long, b long, length_m double, street string")
    starts = spark.createDataFrame([("w", 1, 3.0), ("v", 5, 0.0)], "walk string, node long, dist_m double")
    got = {(r.walk, r.node): (r.dist_m, list(r.streets)) for r in walks.shortest_walks(links, starts).collect()}
    assert got[("w", 3)] == (23.0, ["A"]) and got[("w", 5)] == (29.0, ["A"]) and got[("v", 1)] == (26.0, ["A"])
    assert len(got) == 10  # 8 and 9 are not reached


LINES = {
    "square": {"a": [(0, 0), (200, 0)], "b": [(200, 0), (200, 200)], "c": [(200, 200), (0, 200)], "d": [(0, 200), (0, 0)]},
    "tree": {"a": [(0, 0), (300, 0)], "b": [(150, 8), (150, 200)], "c": [(150, 120), (260, 120)]},
    "two": {"a": [(0, 0), (100, 0)], "b": [(0, 500), (100, 500)], "x": [(0, 500), (100, 560)]},
}


@pytest.mark.parametrize("left", [True, False])
@pytest.mark.parametrize("name", sorted(LINES))
def test_tour_walks_every_pavement_once(spark, name, left):
    placed, edges, halves, faces = build(spark, LINES[name])
    spots = placed.selectExpr("node as tail", "lon", "lat").distinct()
    ready = halves.join(edges.selectExpr("edge", "line as street"), "edge").join(spots, "tail").selectExpr("'r' as route", "*", "1 as homes", "-2.1D as start_lon", "52.8D as start_lat")
    steps = sorted(walks.tours(ready, 52.8, left).collect(), key=lambda r: r.seq)
    ends = {(r.edge, r.forward): (r.tail, r.head) for r in halves.collect()}
    walked = [(r.edge, r.forward) for r in steps if r.type == "walk"]
    assert sorted(walked) == sorted(ends)
    n_faces, parts = faces.select("face").distinct().count(), sum(r.type == "approach" for r in steps)
    crossings = [r for r in steps if r.type == "cross"]
    assert len(crossings) == 2 * (n_faces - parts) and sum(r.back for r in crossings) * 2 == len(crossings)
    here = None
    for r in steps:  # without a jump, and crossing where one stands
        if r.type == "approach":
            here = r.node
        elif r.type == "cross":
            assert r.node == here and r.streets
        else:
            assert ends[(r.edge, r.forward)][0] == here
            here = r.node
    turns = [b.uturn == (a.edge == b.edge) for a, b in zip(steps, steps[1:]) if a.type == b.type == "walk"]
    assert all(turns)


def test_square_is_crossed_at_the_first_corner(spark):
    # one street to cross at any corner: the tie goes to the first corner in order
    placed, edges, halves, faces = build(spark, LINES["square"])
    spots = placed.selectExpr("node as tail", "lon", "lat").distinct()
    ready = halves.join(edges.selectExpr("edge", "line as street"), "edge").join(spots, "tail").selectExpr("'r' as route", "*", "1 as homes", "cast(null as double) as start_lon", "cast(null as double) as start_lat")
    steps = sorted(walks.tours(ready, 52.8).collect(), key=lambda r: r.seq)
    assert [r.type for r in steps].count("cross") == 2 and all(len(r.streets) == 1 for r in steps if r.type == "cross")


def test_cues(spark):
    walk = lambda seq, street, out, into, pas="side", uturn=False, degree=2: ("r", seq, "walk", None, False, uturn, None, street, pas, 4.0, 50.0, out, into, degree, seq * 50.0, 0.0, seq * 50.0 + 50, 0.0)
    other = lambda seq, kind, streets, d=None, back=False: ("r", seq, kind, streets, back, False, d, *[None] * 11)
    rows = [
        other(0, "approach", ["High St", "Low Rd"], 10.0), walk(1, "High St", 90.0, 90.0), walk(2, "High St", 95.0, 90.0), walk(3, "Low Rd", 180.0, 180.0), walk(4, "Low Rd", 0.0, 0.0, uturn=True),
        other(5, "cross", ["High St", "Low Rd"]), walk(6, "Elm", 90.0, 90.0), walk(7, "Elm", 10.0, 10.0, degree=3), other(8, "cross", ["Elm"], back=True), walk(9, "Far Lane", 90.0, 90.0, "both"), walk(10, "Far Lane", 270.0, 270.0, "back", True), walk(11, "End Lane", 270.0, 270.0, "back"),
    ]
    schema = "route string, seq int, type string, streets array<string>, back boolean, uturn boolean, dist_m double, street string, pass string, homes double, length_m double, out_bearing double, in_bearing double, degree int, a_x double, a_y double, b_x double, b_y double"
    got = sorted(walks.walk_legs(spark.createDataFrame(rows, schema)).collect(), key=lambda r: r.n)
    assert [r.cue for r in got] == [
        "Start at the corner of High St and Low Rd. Then walk east along High St.", "Turn right into Low Rd.", "At the end of Low Rd, cross over and come back down the other side.",
        "Cross over High St / Low Rd. Then walk east along Elm.", "Turn left to stay on Elm (it branches here).", "Cross back over Elm. Then drive east along Far Lane. Deliver both sides as you go.",
        "At the end of Far Lane, turn round and head back along Far Lane, then End Lane. Both sides are already done.",
    ]
    assert [r.homes for r in got] == [4.0, 2.0, 2.0, 2.0, 2.0, 4.0, 0.0] and got[0].length_m == 100.0
    assert math.isclose(sum(r.length_m for r in got), 450.0)
