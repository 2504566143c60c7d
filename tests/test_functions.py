import random

from pyspark.sql import functions as F

from roadloom.functions import geo, intervals, parse, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def brute_merge(items, gap=1e-9):
    out = []
    for a, b in sorted(items):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def test_interval_algebra(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        lists = [[tuple(sorted((rng.randrange(50) / 50, rng.randrange(50) / 50))) for _ in range(rng.randrange(6))] for _ in range(2)]
        rows.append((i, *[[x for x in items if x[0] < x[1]] for items in lists]))
    df = spark.createDataFrame(rows, f"i int, x {intervals.LIST}, y {intervals.LIST}")
    got = df.select("i", "x", "y", intervals.merged(F.col("x")).alias("m"), intervals.intersected(F.col("x"), F.col("y")).alias("n"), intervals.subtracted(F.col("x"), F.col("y")).alias("s"), intervals.complement(F.col("x")).alias("c")).collect()
    size = lambda items: sum(b - a for a, b in items)
    for r in got:
        merged = brute_merge([tuple(v) for v in r.x])
        assert [tuple(v) for v in r.m] == merged
        both = brute_merge([(max(a, c), min(b, d)) for a, b in merged for c, d in brute_merge([tuple(v) for v in r.y]) if max(a, c) < min(b, d)])
        assert abs(size(r.n) - size(both)) < 1e-9
        # a list is its intersection with another and what that leaves of it
        assert abs(size(r.n) + size(r.s) - size(merged)) < 1e-9
        assert abs(size(r.c) + size(merged) - 1) < 1e-9


def test_gaps_of_ten_metres(spark):
    items = lambda *x: F.array(*[intervals.interval(F.lit(a), F.lit(b)) for a, b in x])
    r = one(
        spark,
        intervals.gaps_closed(items((0.0101, 0.3), (0.3099, 0.5), (0.5101, 0.9)), F.lit(1000.0)).alias("g"),
        intervals.without_tiny(items((0.1, 0.10999), (0.2, 0.21001)), F.lit(1000.0)).alias("t"),
        intervals.done(items((0.0, 0.2)), items((0.3, 0.7)), items((0.5, 0.9)), F.lit(1000.0)).alias("d"),
        intervals.half_done(items((0.3, 0.7)), items((0.5, 0.7)), F.lit(1000.0)).alias("h"),
    )
    assert [tuple(x) for x in r.g] == [(0.0101, 0.5), (0.5101, 0.9)]
    assert [tuple(x) for x in r.t] == [(0.2, 0.21001)]
    assert [tuple(x) for x in r.d] == [(0.0, 0.2), (0.5, 0.7)]
    assert [tuple(x) for x in r.h] == [(0.3, 0.5)]


def test_notations(spark):
    wkt = "LINESTRING(-2.1  52.8, -2.2 52.9)|LINESTRING(oops)|linestring(1 2,3 4)"
    r = one(
        spark,
        parse.linestrings(F.lit(wkt)).alias("t"), parse.linestrings(F.lit(wkt), "keep_index").alias("k"), parse.linestrings(F.lit(wkt), "all_or_nothing").alias("a"), parse.linestrings(F.lit("-")).alias("n"),
        parse.partial_ranges(F.lit("seg0:0.4-0.1:S|seg2:0-1:Q|x|seg1:0.5-0.6:F")).alias("p"), parse.partial_ranges(F.lit("-")).alias("q"),
        parse.coordinate_paste(F.lit("Latitude: 52.8, Longitude: -2.1")).alias("c"), parse.coordinate_paste(F.lit("nothing")).alias("d"),
    )
    assert [len(f) for f in r.t] == [2, 2] and [len(f) for f in r.k] == [2, 0, 2] and r.a == [] and r.n == []
    assert r.t[0][0].lat == 52.8
    assert [tuple(x) for x in r.p] == [(0, 0.1, 0.4, "S"), (2, 0.0, 1.0, "B"), (1, 0.5, 0.6, "F")] and r.q == []
    assert tuple(r.c) == (52.8, -2.1) and r.d is None
    shown = one(spark, parse.partial_text(F.expr("array(named_struct('frag', 1, 'a', 0.25D, 'b', 0.5D, 'side', 'B'))")).alias("x"), parse.partial_text(parse.partial_ranges(F.lit("-"))).alias("y"))
    assert tuple(shown) == ("seg1:0.2500-0.5000:B", "-")


def test_strings(spark):
    def fnv(s):
        h = 2166136261
        data = s.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = (h ^ int.from_bytes(data[i : i + 2], "little")) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    words = ["hello", "", "Straße é", "a😀b"]
    df = spark.createDataFrame([(w,) for w in words], "s string").select("s", text.fingerprint(F.col("s")).alias("f"))
    assert {r.s: r.f for r in df.collect()} == {w: fnv(w) for w in words}
    cells = [("1,234", 1), ("12abc", 12), ("-", 0), (None, 0), (" -7", -7), ("x9", 0)]
    got = spark.createDataFrame([(c,) for c, _ in cells], "s string").select(text.leading_int(F.col("s")).alias("n")).collect()
    assert [r.n for r in got] == [n for _, n in cells]
    ids = [r.x for r in spark.range(0, 18278).select(text.letters_id(F.col("id")).alias("x")).collect()]
    assert ids[:2] + ids[25:28] + ids[701:703] == ["A", "B", "Z", "AA", "AB", "ZZ", "AAA"] and len(set(ids)) == 18278
    r = one(spark, text.base_name(F.lit("High St (part 1) (part 2)")).alias("a"), text.slug(F.lit(" A & B--C! ")).alias("b"), text.non_residential(F.lit("Old Track"), F.lit(50)).alias("c"), text.non_residential(F.lit("Stone 12"), F.lit(6)).alias("d"))
    assert tuple(r) == ("High St (part 1)", "a-b-c", True, False)


def test_geometry(spark):
    line = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.001, 0.0), (0.001, 0.001))])
    r = one(spark, geo.line_length(line, F.lit(0.0)).alias("n"), geo.point_at(line, F.lit(0.75), F.lit(0.0)).alias("p"), geo.compass(F.lit(359.0)).alias("c"), geo.turn(F.lit(350.0), F.lit(80.0)).alias("t"), geo.halves_up(F.lit(-2.5)).alias("h"), geo.effort_weight(F.lit(15.0), F.lit(1000.0)).alias("w"))
    assert abs(r.n - 222.64) < 1e-6 and abs(r.p.lat - 0.0005) < 1e-9 and r.p.lon == 0.001
    assert (r.c, r.t, r.h, r.w) == ("N", "right", -2.0, 6.25)


def test_letters_of_any_length(spark):
    def brute(n):
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    places = [0, 25, 26, 701, 702, 18277, 18278, 19999, 475253, 475254, 2**31, 2**53 + 1, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in [*places, None]], "n long").select("n", text.letters_id(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == {n: brute(n) for n in places} | {None: None}
    assert brute(18278) == "AAAA"


def test_table_functions_give_the_rows_of_the_expressions(spark):
    from roadloom.functions import sql

    sql.register(spark)
    texts = ["LINESTRING(1 2, 3 4)", "LINESTRING(1 2, 3 4)|LINESTRING(5 6, 7 8, 9 10)", "linestring ( 1 2 , 3   4 )", "LINESTRING(1 x, 2 3)|LINESTRING(1 1, 2 2)", "POINT(1 2)", "-", "", None, "LINESTRING()", "LINESTRING(1, 2)", "|LINESTRING(0 0, 1 1)|"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows.createOrReplaceTempView("texts")
    got = sorted(map(tuple, spark.sql("SELECT k, frag, idx, lon, lat FROM texts, LATERAL wkt_vertices(t)").collect()))
    spread = rows.select("k", F.posexplode(parse.linestrings(F.col("t"))).alias("frag", "f")).select("k", "frag", F.posexplode("f").alias("idx", "p"))
    assert got == sorted(map(tuple, spread.select("k", "frag", "idx", "p.lon", "p.lat").collect())) and len(got) > 10
    marks = ["seg0:0.1-0.5:B", "seg1:0.9-0.2:S|seg0:0.0-1.0:F|seg2:0.1-0.2:X", "nonsense|seg3:.5-.6:B", "-", "", None, "seg0:1.2.3-0.4:B"]
    spark.createDataFrame(list(enumerate(marks)), "k int, t string").createOrReplaceTempView("texts")
    got = sorted(map(str, spark.sql("SELECT k, place, frag, a, b, side FROM texts, LATERAL stretches(t)").collect()))
    spread = spark.table("texts").select("k", F.posexplode(parse.partial_ranges(F.col("t"))).alias("place", "r"))
    assert got == sorted(map(str, spread.select("k", "place", "r.frag", "r.a", "r.b", "r.side").collect())) and len(got) == 6
