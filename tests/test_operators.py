import hashlib
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadloom.functions import intervals
from roadloom.operators import clusters, marks, network, poi, publishing, roads, spatial, tracks
from roadloom.plans import driver_queries
from roadloom.sources import sheets
from roadloom.streaming import progress

SHEET = '''Street,@lat,@lon,Ward,Local Authority District,Status,UPRN count,Road Geometry,Partial Geometry
"Alder
Road",52.8,-2.1,North,Demo,Not_Started,"1,234","LINESTRING(-2.1 52.8, -2.1 52.802)",-
"Birch ""B"" Close",x,-2.1,North,Demo,In_Progress,12,,seg0:0.0-0.4:B
###ROUTE_PLANNER_ONLY_BELOW###,,,,,,,,
Main Road,52.8,-2.1,North,Demo,Not_Started,-,"LINESTRING(-2.1 52.7, -2.0 52.7)",-
,52.8,-2.1,North,Demo,Not_Started,-,,-
'''


def test_sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text(SHEET)
    got = {r.row_index: r for r in sheets.read_sheet(spark, str(path)).collect()}
    assert {k: (r.street, r.residences, r.lat, r.is_network) for k, r in got.items()} == {2: ("Alder\nRoad", 1, 52.8, False), 3: ('Birch "B" Close', 12, None, False), 5: ("Main Road", 0, 52.8, True)}
    assert sheets.missing_fields(["Name", "lat"]) == ["lon", "ward_name", "status", "residences", "road_geometry", "partial_geometry"]


def test_other_sources(spark, tmp_path):
    (tmp_path / "points.csv").write_text("﻿UPRN,LATITUDE,LONGITUDE\n1,52.8,-2.1\n2,53.9,-2.1\n3,,\n")
    assert [r.lat for r in sheets.read_address_points(spark, str(tmp_path / "points.csv"), (52, -3, 53, -1)).collect()] == [52.8]
    (tmp_path / "cache.json").write_text(json.dumps({"coverage": [{"bbox": [1, 2, 3, 4], "fetchedAt": "2024-01-01"}], "pubs": [{"name": "A", "lat": 1.5, "lon": 2.5}]}))
    points, boxes = sheets.read_poi_cache(spark, str(tmp_path / "cache.json"))
    assert tuple(points.first()) == ("A", 1.5, 2.5) and boxes.first().max_lat == 3
    (tmp_path / "found.json").write_text(json.dumps({"elements": [{"type": "way", "center": {"lat": 1, "lon": 2}, "tags": {"amenity": "pub", "name": "W"}}, {"type": "way", "center": {"lat": 1, "lon": 2}, "tags": {"amenity": "bar", "name": "X"}}, {"type": "node", "lat": 3, "lon": 4, "tags": {"amenity": "bar", "name": "N"}}, {"type": "node", "lat": 3, "lon": 4, "tags": {"amenity": "pub"}}]}))
    assert sorted(tuple(r) for r in sheets.read_poi_response(spark, str(tmp_path / "found.json")).collect()) == [("N", 3, 4), ("W", 1, 2)]
    (tmp_path / "pages.json").write_text(json.dumps({"a.html": {"ward": "N", "constituency": "C", "generatedAt": "2024-01-01T00:00:00Z", "publishId": "p"}}))
    assert sheets.read_manifest(spark, str(tmp_path / "pages.json")).first().publish_id == "p"
    page = spark.createDataFrame([("<script>SHEET_ID = 'abc', TITLE: \"T\"</script>",)], "html string")
    assert sheets.tracker_settings(page).select("sheet_id", "title", "sheet_gid").first()[:] == ("abc", "T", None)


def test_nearest_joins_against_brute_force(spark):
    rng = random.Random(2)
    place = lambda: (-2.1 + rng.random() * 0.02, 52.8 + rng.random() * 0.01)
    vertices = [(f"r{i % 60}", *place()) for i in range(300)]
    ends = [(i, f"r{i % 60}", *place()) for i in range(200)]
    kx = 111320 * math.cos(math.radians(52.8))
    want = {}
    for e, road, lon, lat in ends:
        best = min((math.sqrt(((lon - x) * kx) ** 2 + ((lat - y) * 111320) ** 2), other) for other, x, y in vertices if other != road)
        if best[0] <= 50:
            want[e] = best[1]
    got = spatial.nearest_vertices(spark.createDataFrame(ends, "end int, road string, lon double, lat double"), spark.createDataFrame(vertices, "road string, lon double, lat double"), 52.8)
    assert {r.end: r.other for r in got.collect()} == want and want
    edges = spatial.adjacency(got)
    assert edges.count() == edges.select("dst", "src").intersect(edges).count()

    segments = [(i, *place()) for i in range(80)]
    segments = [(i, x, y, x + rng.uniform(-0.004, 0.004), y + rng.uniform(-0.002, 0.002)) for i, x, y in segments]
    points = [(i, *place()) for i in range(300)]
    ky, want = 110540, {}
    for p, lon, lat in points:
        found = []
        for s, ax, ay, bx, by in segments:
            ux, uy, px, py = (bx - ax) * kx, (by - ay) * ky, (lon - ax) * kx, (lat - ay) * ky
            t = min(max((px * ux + py * uy) / (ux * ux + uy * uy), 0), 1)
            found.append((math.hypot(px - ux * t, py - uy * t), s))
        if min(found)[0] <= 250:
            want[p] = min(found)[1]
    got = spatial.match_homes(spark.createDataFrame(points, "pt int, lon double, lat double"), spark.createDataFrame(segments, "seg int, a_lon double, a_lat double, b_lon double, b_lat double"), 52.8)
    assert {r.pt: r.seg for r in got.collect()} == want


def test_components_and_distances(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    near = {i: set() for i in range(60)}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    root = {}
    for i in range(60):
        todo = [i]
        while todo:
            n = todo.pop()
            if n not in root:
                root[n] = i
                todo += near[n]
    edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src long, dst long").distinct()
    nodes = spark.range(60).withColumnRenamed("id", "node")
    assert {r.node: r.component for r in network.connected(nodes, edges).collect()} == root
    size = {i: 1.0 + i % 7 for i in range(60)}
    best = {0: 5.0}
    changed = True
    while changed:
        changed = False
        for n in list(best):
            for m in near[n]:
                if best[n] + size[m] < best.get(m, 1e9):
                    best[m] = best[n] + size[m]
                    changed = True
    got = network.network_distances(spark.createDataFrame(list(size.items()), "road long, length_m double"), edges, spark.createDataFrame([(0, 5.0), (0, 9.0)], "road long, dist_m double"))
    assert {r.road: r.dist_m for r in got.collect()} == best


def test_clusters(spark):
    rows = [("W", i, f"r{i:02d}", float(20 + i % 5 * 10), float(20 + i % 5 * 10), i * 60.0, -2.1 + i * 0.001, 52.8, [f"r{j:02d}" for j in (i - 1, i + 1) if 0 <= j < 30]) for i in range(30)]
    got = clusters.cluster_roads(spark.createDataFrame(rows, clusters.ROADS), 150).toPandas()
    assert sorted(got.road) == [r[2] for r in rows]
    sizes = got.groupby("cluster").residences.sum()
    assert sizes.max() <= clusters.MERGE_CAP and sizes.min() >= 150 * 0.75
    assert list(got.groupby("cluster").min_dist_m.first()) == sorted(got.groupby("cluster").min_dist_m.first())
    assert set(got[got.min_dist_m <= 700].kind) == {"walk"}
    towns = clusters.find_settlements(spark.createDataFrame(rows, clusters.ROADS)).toPandas()
    assert sorted(towns.road) == [r[2] for r in rows] and towns.groupby("settlement").residences.sum().min() >= 60


def test_rows_and_pages(spark):
    rows = spark.createDataFrame([("N", "A", 2, 5), ("N", "B", 3, 6), ("N", "A", 4, 7)], "ward_name string, street string, row_index int, residences int")
    assert sorted((r.street, r.residences, r.ord) for r in roads.last_of_street(rows).collect()) == [("A", 7, 2), ("B", 6, 3)]
    taken = spark.createDataFrame([("base.html",), ("base2.html",)], "name string")
    assert publishing.free_name(taken, "base").first().name == "base1.html"
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, "1"), (5.0, 5.0, 6.0, 6.0, "2")], "min_lat double, min_lon double, max_lat double, max_lon double, fetched_at string")
    assert [r.fetched_at for r in poi.coverage_upsert(boxes, (-1.0, -1.0, 2.0, 2.0), "3").collect()] == ["3", "2"]
    share = spark.range(1).select(*[roads.remaining_share(F.lit(s), F.lit(100.0), F.lit(20.0), F.lit(10.0)).alias(n) for n, s in (("a", "Complete"), ("b", "In_Progress"), ("c", "?"))]).first()
    assert tuple(share) == (0.0, 0.75, 1.0)


def test_progress_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 5, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=40 * i), i * 3.0 + rng.uniform(-60, 60), rng.uniform(0, 45), 15.0) for i in range(200)]
    for k in range(4):
        pd.DataFrame(rows[k * 50 : k * 50 + 50], columns=["walker", "ts", "pos", "off_m", "accuracy"]).assign(walker=lambda d: d.walker.astype("int64")).to_parquet(tmp_path / f"{k}.parquet", coerce_timestamps="us")
    schema = progress.FIXES
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    run = progress.progress_stream(stream).writeStream.format("memory").queryName("fixes").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    order = lambda df: sorted(map(tuple, df.select("walker", "ts", "pos", "matched", "accepted").collect()))
    batch = order(progress.progress_batch(spark.read.schema(schema).parquet(str(tmp_path))))
    assert order(spark.table("fixes")) == batch and 0 < sum(r[4] for r in batch) < 200


def test_publishing_stream_takes_an_identifier_once(spark, tmp_path):
    pd.DataFrame({"publish_id": ["a", "b", "a"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:02"])}).to_parquet(tmp_path / "0.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("publish_id string, ts timestamp").parquet(str(tmp_path))
    run = progress.published_once(stream).writeStream.format("memory").queryName("pages").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.publish_id for r in spark.table("pages").collect()) == ["a", "b"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_users_intervals_are_no_array(spark, tmp_path):
    # a third of all events are one user's
    rng = random.Random(5)
    rows = [(i, 0 if i % 3 == 0 else i % 40, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=rng.randrange(10**6))) for i in rng.sample(range(10**5), 300)]
    pd.DataFrame(rows, columns=["event_id", "user_id", "ts"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    lists = driver_queries.event_ranges(spark, str(tmp_path)).groupBy("user_id").agg(F.collect_list(F.struct("a", "b")).alias("items"))
    fixed = F.array(*[intervals.interval(F.lit(a), F.lit(b)) for a, b in ((0.1, 0.45), (0.5, 0.51), (0.6, 0.95))])
    by_arrays = {"interval_subtract": intervals.complement(F.col("items")), "interval_intersect": intervals.intersected(intervals.merged(F.col("items")), fixed), "close_gaps": intervals.gaps_closed(F.col("items"), F.lit(333.0))}
    for name, items in by_arrays.items():
        got = driver_queries.QUERIES[name](spark, str(tmp_path))
        assert "collect_list" not in plan_of(got)
        want = lists.select("user_id", F.explode(items).alias("x")).select("user_id", F.round("x.a", 6), F.round("x.b", 6))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_progress_carries_its_state_over_batches(spark):
    rng = random.Random(6)
    walkers = [None, 2**60 + 1, 2**60 + 2]
    rows = [(walkers[0 if i % 2 else rng.randrange(3)], pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=40 * i), i * 3.0 + rng.uniform(-60, 60), rng.uniform(0, 45), 15.0) for i in range(200)]
    want = []
    for w in walkers:
        own = pd.DataFrame([r for r in rows if r[0] == w], columns=["walker", "ts", "pos", "off_m", "accuracy"])
        want += [(w, p, m, t) for p, m, t in progress.match_fixes(own, 0.0, None)[0][["pos", "matched", "accepted"]].itertuples(index=False)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = progress.progress_batch(spark.createDataFrame([(w, t.to_pydatetime(), *x) for w, t, *x in rows], progress.FIXES))
        assert "FlatMapGroupsInPandas" not in plan_of(got)
        assert sorted([(r.walker, r.pos, r.matched, r.accepted) for r in got.collect()], key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_crowded_ward(spark, monkeypatch):
    # the numbers were taken from loops that compare every road and group with every other
    rng, n, calls, metres = random.Random(9), 1500, [], clusters._metres
    rows = [("W", i, f"r{i:04d}", *[float(rng.randrange(60))] * 2, i * 5.0, -2.5 + rng.random() * 0.4, 52.6 + rng.random() * 0.4, [f"r{j:04d}" for j in (i - 1, i + 1) if 0 <= j < n and rng.random() < 0.6]) for i in range(n)]
    ward = pd.DataFrame(rows, columns=[c.split()[0] for c in clusters.ROADS.split(", ")])
    monkeypatch.setattr(clusters, "_metres", lambda *x: calls.append(1) or metres(*x))
    digest = lambda df: hashlib.sha256(repr(df.values.tolist()).encode()).hexdigest()[:16]
    assert digest(clusters.cluster_ward(ward, 150, 112.5, 337.5, False, 1000.0, False)) == "bed2811183382107"
    assert digest(clusters.settle_ward(ward, 1000.0, 1300.0, 60.0)) == "4112879f061e7150"
    assert len(calls) < 40 * n


def test_unfinished_distances_are_an_error(spark):
    roads_of = spark.createDataFrame([(i, 1.0) for i in range(4)], "road long, length_m double")
    edges = spark.createDataFrame([(i, i + 1) for i in range(3)], "src long, dst long")
    entries = spark.createDataFrame([(0, 0.0)], "road long, dist_m double")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        network.network_distances(roads_of, edges, entries, most_rounds=2)
    assert {r.road: r.dist_m for r in network.network_distances(roads_of, edges, entries, most_rounds=4).collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}


def test_rows_are_complete_when_all_fragments_are_done_on_both_sides(spark):
    """A row of two fragments, sides done one by one, small gaps, the flag of a route, and moments that tie."""
    log = [
        (1, 1, "add", "seg0:0.0000-1.0000:B", False), (1, 2, "add", "seg1:0.5000-0.6000:B", False),
        (2, 1, "add", "seg0:0.0000-1.0000:S", False), (2, 2, "add", "seg0:0.0000-1.0000:F", False),
        (3, 1, "add", "seg0:0.0000-0.4950:B", False), (3, 2, "add", "seg0:0.5000-0.9990:B", False),
        (4, 1, "add", "seg0:0.0000-0.4950:B", False), (4, 2, "add", "seg0:0.5000-0.9990:B", False),
        (5, 1, "add", "seg0:0.1000-0.2000:B", True), (6, 1, "add", "seg0:0.1000-0.2000:B", True), (6, 2, "remove", "seg0:0.3000-0.4000:B", False),
        (7, 5, "add", "seg0:0.1000-0.2000:B", False), (7, 1, "add", "seg0:0.4000-0.5000:S", False), (7, 9, "remove", "seg0:0.1000-0.2000:B", False), (7, 9, "add", "seg0:0.1000-0.2000:B", False), (7, 10, "add", "seg0:0.1000-0.2000:B", False),
        (8, 1, "add", "seg0:0.0000-1.0000:B", False), (8, 1, "remove", "seg0:0.0000-1.0000:B", False), (9, 1, "add", "gone", False),
    ]
    changes = spark.createDataFrame(log, "row_index long, at long, action string, token string, complete boolean")
    fragments = spark.createDataFrame([(1, 0, None), (1, 1, None), (2, 0, 80.0), (3, 0, 1000.0), (4, 0, None), (5, 0, 9.0), (6, 0, 9.0), (7, 0, 90.0), (8, 0, 1.0)], "row_index long, frag int, length_m double")
    got = {r.row_index: (r.partial_geometry, r.status) for r in marks.accumulated(changes, fragments).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "In_Progress", 2: "Complete", 3: "Complete", 4: "In_Progress", 5: "Complete", 6: "In_Progress", 7: "In_Progress", 8: "Not_Started", 9: "In_Progress"}
    assert got[7][0] == "seg0:0.4000-0.5000:S|seg0:0.1000-0.2000:B" and got[8][0] == "-"


def test_fixes_of_any_accuracy_keep_their_candidates(spark):
    kx = 111320 * math.cos(math.radians(52.8))
    segments = spark.createDataFrame([("t", 1, "both", 0.0, 0.0, 0, -2.0, 52.8, -2.0 + 500 / kx, 52.8)], "track string, n int, pavement string, start_m double, from_m double, seq int, a_lon double, a_lat double, b_lon double, b_lat double")
    fixes = [(1, 290.0, 150.0), (2, 1700.0, 1000.0), (3, 310.0, 150.0), (4, 29.0, 1.0), (5, 31.0, 1.0), (6, 90_000.0, 50_000.0)]
    rows = spark.createDataFrame([(k, "t", -2.0 + 250 / kx, 52.8 + off / 110540, 0.0, None, acc) for k, off, acc in fixes], "fix int, track string, lon double, lat double, from_pos double, elapsed_s double, accuracy double")
    assert {r.fix: round(r.pos) for r in tracks.located(rows, segments, 52.8).collect()} == {1: 250, 2: 250, 4: 250, 6: 250}


def test_equal_positions_come_back_as_often_as_given(spark):
    pieces = spark.createDataFrame([("t", 0, 1, 0.0, 10.0), ("t", 1, 2, 10.0, 5.0), ("t", 2, 1, 15.0, 5.0)], "track string, seq int, n int, start_m double, length_m double")
    positions = spark.createDataFrame([("t", 12.0), ("t", 12.0), ("t", 99.0)], "track string, pos double")
    assert sorted(map(tuple, tracks.at_positions(positions, pieces).collect())) == [("t", 12.0, 2, 2.0, 3.0), ("t", 12.0, 2, 2.0, 3.0), ("t", 99.0, 1, 5.0, 0.0)]
    assert {(r.n, r.start_m) for r in tracks.step_starts(pieces).collect()} == {(1, 0.0), (2, 10.0)}


def test_long_diagonals_stand_in_few_cells(spark):
    kx = 111320 * math.cos(math.radians(52.8))
    long = spark.createDataFrame([(1, -2.0, 52.8, -2.0 + 3000 / kx, 52.8 + 3000 / 110540)], "seg int, a_lon double, a_lat double, b_lon double, b_lat double")
    assert spatial.segment_cells(long, 52.8, 20.0).count() < 3 * 150 + 10
    rng = random.Random(4)
    segments = [(k, *(c for _ in range(2) for c in (-2.0 + rng.uniform(0, 900) / kx, 52.8 + rng.uniform(0, 900) / 110540))) for k in range(60)]
    points = [(k, -2.0 + rng.uniform(0, 900) / kx, 52.8 + rng.uniform(0, 900) / 110540) for k in range(80)]

    def far(p, s):
        ax, ay, bx, by = s[1] * kx, s[2] * 110540, s[3] * kx, s[4] * 110540
        px, py = p[1] * kx, p[2] * 110540
        t = max(0, min(1, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))

    want = {p[0]: min((far(p, s), s[0]) for s in segments)[1] for p in points if min(far(p, s) for s in segments) <= 20}
    got = spatial.nearest_segments(spark.createDataFrame(points, "pt int, lon double, lat double"), spark.createDataFrame(segments, "seg int, a_lon double, a_lat double, b_lon double, b_lat double"), 52.8, 20.0)
    assert {r.pt: r.seg for r in got.collect()} == want
