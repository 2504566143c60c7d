"""Events end to end, and the files around them."""

import json
import math
import random

from pyspark.sql import functions as F

from roadloom.operators import events, homes, publishing
from roadloom.sources import sheets

LAT0 = 52.8
TABLE = "ward string, ord long, road string, street string, status string, row_index long, residences double, size double, lon double, lat double, neighbours array<string>, points array<struct<lon:double,lat:double>>, length_m double, district string"


def road(name, lon, lat, homes, near, ward="W", status="Not_Started", ord_=0):
    line = [(lon - 0.0005, lat), (lon + 0.0005, lat)]
    return (ward, ord_, name, name, status, ord_, float(homes), float(homes), lon, lat, near, line, 67.0, "D")


def small_town(spark):
    """Two villages four kilometres apart, and a finished road."""
    rows = [
        road("Ash", -2.0, 52.8, 60, ["Birch"], ord_=0), road("Birch", -1.999, 52.8, 50, ["Ash", "Cedar"], ord_=1), road("Cedar", -1.998, 52.8, 40, ["Birch"], ord_=2),
        road("Done", -1.997, 52.8, 0, ["Cedar"], status="Complete", ord_=3), road("Elm", -1.94, 52.8, 70, [], ord_=4),
    ]
    return spark.createDataFrame(rows, TABLE)


def pois(spark, *rows):
    return spark.createDataFrame(list(rows), "district string, poi string, p_lon double, p_lat double")


def by_route(records):
    return {r.route: r for r in records.collect()}


def test_each_village_has_its_own_hub(spark):
    records, wards = events.multi_hub(small_town(spark), pois(spark, ("D", "Anchor", -2.0, 52.8), ("D", "Bell", -1.94, 52.8), ("E", "Crown", -2.0, 52.8)), LAT0)
    found = by_route(records)
    assert {k: ([x.name for x in r.roads], r.hub_id, r.kind, r.marker) for k, r in found.items()} == {"A": (["Ash", "Birch", "Cedar"], "H1", "walk", None), "B": (["Elm"], "H2", "walk", None)}
    assert found["A"].name == "Ash & Birch" and found["A"].start_hint == "Anchor (event start point)" and found["A"].residences == 150.0
    ward = wards.collect()[0]
    assert [h.label for h in ward.hubs] == ["Anchor", "Bell"] and ward.start.label == "Anchor" and ward.routes == 2
    assert (round(ward.bounds.min_lon, 6), round(ward.bounds.max_lon, 6)) == (-2.0005, -1.9395)


def test_hubs_of_one_name_nearby_are_one(spark):
    # one inn between the villages is the nearest of both: two settlements, one hub, routes that run on
    records, wards = events.multi_hub(small_town(spark), pois(spark, ("D", "Midway", -1.97, 52.8)), LAT0)
    found = by_route(records)
    assert {k: [x.name for x in r.roads] for k, r in found.items()} == {"A": ["Ash", "Birch", "Cedar"], "B": ["Elm"]}
    assert {r.hub_id for r in found.values()} == {"H1"} and [h.label for h in wards.collect()[0].hubs] == ["Midway"]
    assert all(r.kind == "drive" and r.marker is not None for r in found.values())
    assert found["A"].marker.label == "Birch" and found["A"].start_hint.startswith("Park on Birch")
    assert abs(found["A"].marker.lon + 1.999) < 1e-9


def test_general_routes_have_no_hub(spark):
    records, wards = events.multi_hub(small_town(spark), pois(spark, ("D", "Anchor", -2.0, 52.8)), LAT0, general=True)
    assert all(r.hub_id is None and r.marker is not None and r.kind == "walk" and r.start_hint.startswith("Start on ") for r in records.collect())
    ward = wards.collect()[0]
    assert ward.general and ward.hubs == [] and ward.start.label == "W ward" and abs(ward.start.lon + 1.97) < 1e-9


def test_without_points_of_interest_the_centre_is_the_hub(spark):
    records, _ = events.multi_hub(small_town(spark), pois(spark), LAT0)
    assert {r.start_hint for r in records.collect()} == {"Settlement 0 centre (event start point)", "Settlement 1 centre (event start point)"}


def hubs_by_pairs(centres, points):
    """Each settlement's nearest point, by comparing it with all of its district."""
    out = {}
    for ward, seq, district, lon, lat in centres:
        far = lambda p: math.sqrt(((lon - p[2]) * (111320.0 * math.cos(math.radians(lat)))) ** 2 + ((lat - p[3]) * 111320.0) ** 2)
        best = min(((far(p), *p[1:]) for p in points if p[0] == district and p[1] is not None), default=None)
        out[ward, seq] = best[1:] if best else (f"Settlement {seq} centre", lon, lat)
    return out


CENTRES = "ward string, hub_seq long, district string, lon double, lat double"


def test_nearest_hubs_at_any_distance(spark):
    rng = random.Random(5)
    centres, points = [], []
    # a town, a country, places all over the earth up to the poles, a far point alone, many points on a spot, no points
    for d, n, m, lon, lat, wide in (("town", 40, 80, -2.0, 52.8, 0.02), ("country", 40, 30, -2.0, 52.8, 3.0), ("earth", 60, 60, 0.0, 0.0, 89.0), ("far", 5, 1, 10.0, 40.0, 0.1), ("spot", 5, 20, 3.0, -30.0, 0.0), ("none", 3, 0, 1.0, 1.0, 0.1)):
        centres += [(d, i, d, lon + rng.uniform(-wide, wide) + (0.01 if d == "spot" else 0), lat + rng.uniform(-wide, wide)) for i in range(n)]
        points += [(d, None if i == 7 and d == "town" else f"P{rng.randrange(1000):03d}", lon + (60.0 if d == "far" else 0) + rng.uniform(-wide, wide), lat + rng.uniform(-wide, wide)) for i in range(m)]
    # equally far on both sides: the first name
    centres.append(("tie", 0, "tie", 0.0, 0.0))
    points += [("tie", "Z", 0.5, 0.0), ("tie", "A", -0.5, 0.0), ("tie", "B", 0.0, 0.5), ("lost", "L", 0.0, 0.0)]
    centres.append(("W", 0, None, 5.0, 5.0))
    want = hubs_by_pairs(centres, points)
    got = events.nearest_hubs(spark.createDataFrame(centres, CENTRES), pois(spark, *points, ("none", "Nowhere", None, None)))
    found = {(r.ward, r.hub_seq): (r.label, r.lon, r.lat) for r in got.collect()}
    assert found == want


def test_settlements_do_not_meet_all_points_of_their_district(spark):
    rng, n = random.Random(3), 800
    at = lambda: (-2.5 + rng.random() * 0.5, 52.6 + rng.random() * 0.4)
    centres = spark.createDataFrame([("W", i, "D", *at()) for i in range(n)], CENTRES)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan stays as it is made, with its counts
    try:
        got = events.nearest_hubs(centres, pois(spark, *[("D", f"P{i}", *at()) for i in range(n)]))
        assert len(got.collect()) == n
        made, left = [], [got._jdf.queryExecution().executedPlan()]
        while left:
            node = left.pop()
            left += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName():
                made.append(node.metrics().apply("numOutputRows").value())
        assert made and max(made) < n * n / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_single_hub(spark):
    starts = spark.createDataFrame([("W", "Hall", -2.0, 52.8)], "ward string, label string, lon double, lat double")
    records, wards = events.single_hub(small_town(spark), starts, LAT0)
    assert {k: (r.kind, r.hub_id) for k, r in by_route(records).items()} == {"A": ("walk", "H1"), "B": ("drive", "H1")}
    assert wards.collect()[0].start.label == "Hall"
    assert events.cover_stats(records).collect()[0].asDict() == {"ward": "W", "routes": 2, "residences": 220.0, "walk": 1, "hybrid": 0, "drive": 1}
    empty, none = events.single_hub(small_town(spark).limit(0), starts, LAT0)
    assert empty.count() == 0 and none.count() == 0


def test_home_index_comes_back(spark, tmp_path):
    index = spark.createDataFrame([("k1", [[250, 750], []]), ("k2", [[500]])], "row_key string, positions array<array<int>>")
    homes.write_home_index(index.repartition(2), str(tmp_path / "index"))
    read = sheets.read_home_index(spark, str(tmp_path / "index"), lines=True)
    assert sorted((r.row_key, r.positions) for r in read.collect()) == [("k1", [[250, 750], []]), ("k2", [[500]])]
    assert sheets.read_home_index(spark, str(tmp_path / "index"), version=2, lines=True).count() == 0


def test_registry_and_listing(spark, tmp_path):
    areas = [{"name": "North", "url": "n"}, {"name": "South"}]
    for name, content in (("list", areas), ("object", {"deployments": areas}), ("neither", {"areas": areas})):
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
        found = [r.deployment for r in sheets.read_deployments(spark, str(tmp_path / f"{name}.json")).collect()]
        assert found == ([] if name == "neither" else areas)
    listing = sheets.read_listing(spark, str(tmp_path))
    manifest = spark.createDataFrame([("list.json",), ("gone.html",)], "filename string")
    assert [r.filename for r in publishing.still_there(manifest, listing).collect()] == ["list.json"]
    assert [r.filename for r in publishing.vanished(manifest, listing).collect()] == ["gone.html"]
    assert listing.filter(F.col("bytes") > 0).count() == 3


def test_half_done_stretches_of_a_part(spark):
    segments = spark.createDataFrame([("r", 0, 0, -2.0, 52.8, -1.999, 52.8, 0.0)], "road string, piece int, seq int, a_lon double, a_lat double, b_lon double, b_lat double, from_m double")
    middles = spark.createDataFrame([("r", 1, -1.9995, 52.80002), ("r", 2, -1.9995, 52.8001), ("q", 3, -1.9995, 52.8)], "road string, pt int, lon double, lat double")
    assert [r.pt for r in homes.half_done_of_parts(middles, segments, LAT0).collect()] == [1]
