"""Boxes within boxes, points in them, and a cache that is read and taken up for many requests at once, against plain loops."""

import random

from roadloom.operators import boxes

B = "id long, min_lat double, min_lon double, max_lat double, max_lon double"


def some(seed, n, first=0):
    rng, out = random.Random(seed), []
    for i in range(n):
        lat, lon, size = 50 + rng.randrange(8) / 8, -2 + rng.randrange(8) / 8, rng.choice([0.0, 0.01, 0.125, 0.25, 0.5, 1.0, 40.0])
        out.append((first + i, lat, lon, lat + size, lon + size * rng.choice([1, 1, 0.5])))
    return out


def holds(o, i):
    return o[1] <= i[1] and o[2] <= i[2] and o[3] >= i[3] and o[4] >= i[4]


def test_containing_and_points(spark):
    inner, outer = some(1, 150), some(2, 150, 1000)
    got = sorted(map(tuple, boxes.containing(spark.createDataFrame(inner, B), spark.createDataFrame(outer, B)).collect()))
    assert got == sorted((i[0], o[0]) for i in inner for o in outer if holds(o, i)) and got
    points = [(f"p{k}", 50 + (k % 11) / 10, -2 + (k % 13) / 12) for k in range(120)]
    met = boxes.points_within(spark.createDataFrame(points, "name string, lat double, lon double"), spark.createDataFrame(outer, B))
    assert sorted((r.box, r.name) for r in met.collect()) == sorted((o[0], p[0]) for o in outer for p in points if o[1] <= p[1] <= o[3] and o[2] <= p[2] <= o[4])
    plan = boxes.containing(spark.createDataFrame(inner, B), spark.createDataFrame(outer, B))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert boxes.containing(spark.createDataFrame([], B), spark.createDataFrame(outer, B)).collect() == []


def test_refusals(spark):
    rows = [(1, 50.0, 0.0, 50.1, 0.1), (2, None, 0.0, 1.0, 1.0), (3, 50.0, 0.0, float("inf"), 1.0), (4, -91.0, 0.0, -90.5, 0.1), (5, 50.0, 0.1, 50.1, 0.1), (6, 50.0, 0.0, 50.7, 0.1)]
    got = {r.id: r.why for r in spark.createDataFrame(rows, B).select("id", boxes.refusal().alias("why")).collect()}
    assert got == {1: None, 2: "bbox must be [minLat, minLon, maxLat, maxLon]", 3: "bbox must be [minLat, minLon, maxLat, maxLon]", 4: "bbox out of range", 5: "bbox out of range", 6: "bbox larger than 0.6 degrees"}


def test_a_cache_takes_up_what_was_fetched(spark):
    coverage, fetched = [(*b, "old") for b in some(3, 12)], [(*b, "new") for b in some(4, 20, 100)]
    coverage = [c for c in coverage if c[3] > c[1]]
    fetched = [f for f in fetched if 0 < f[3] - f[1] <= 0.6]
    cached = [(f"p{k % 50}", 50 + (k % 9) / 8, -2 + (k % 7) / 8) for k in range(60)]
    found = [(f[0], f"n{k}", f[1], f[2]) for f in fetched for k in range(2)] + [(fetched[0][0], "p0", 50.0, -2.0)]

    def model(most):
        new = [f for f in fetched if not any(holds(o, f) and (o[0] < f[0] or not holds(f, o)) for o in fetched if o is not f)]
        new = [f for f in sorted(new)[: max(0, most - len(coverage))] if not any(holds(c, f) for c in coverage)]
        points = {p for p in cached if not any(f[1] <= p[1] <= f[3] and f[2] <= p[2] <= f[4] for f in new)} | {tuple(x[1:]) for x in found if x[0] in {f[0] for f in new}}
        return sorted(points), sorted([c for c in coverage if not any(holds(f, c) for f in new)] + new)

    frames = (spark.createDataFrame(cached, "name string, lat double, lon double"), spark.createDataFrame(coverage, B + ", fetched_at string"), spark.createDataFrame(fetched, B + ", fetched_at string"), spark.createDataFrame(found, "box long, name string, lat double, lon double"))
    for most in (300, len(coverage) + 2, 1):
        points, cover = boxes.taken_up(*frames, most=most)
        assert (sorted(map(tuple, points.collect())), sorted(map(tuple, cover.collect()))) == model(most)
