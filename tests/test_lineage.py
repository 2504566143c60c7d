"""Lineage of split roads: a part of a part, turned pieces, circles, rows trimmed to homes, and what reports on parts write."""

from roadloom.operators import lineage

CUTS = "line string, parent string, a double, b double"


def test_parts_of_parts_compose(spark):
    rows = [("p", "row", 0.2, 0.6), ("q", "p", 0.5, 1.0), ("r", "q", 1.0, 0.0), ("s", "r", 0.25, 0.5), ("x", "y", 0.0, 1.0), ("y", "x", 0.0, 1.0), ("z", "x", 0.0, 0.5)]
    got = {r.line: (r.root, round(r.a, 9), round(r.b, 9), r.cuts) for r in lineage.origins(spark.createDataFrame(rows, CUTS)).collect()}
    assert got == {"p": ("row", 0.2, 0.6, 1), "q": ("row", 0.4, 0.6, 2), "r": ("row", 0.6, 0.4, 3), "s": ("row", 0.55, 0.5, 4)}
    assert lineage.origins(spark.createDataFrame([], CUTS)).collect() == []


def test_long_chains_take_few_rounds(spark):
    rows = [(str(i), str(i - 1), 0.0, 1.0) for i in range(1, 41)]
    got = lineage.origins(spark.createDataFrame(rows, CUTS)).collect()
    assert {(r.root, r.a, r.b) for r in got} == {("0", 0.0, 1.0)} and {int(r.line): r.cuts for r in got} == {i: i for i in range(1, 41)}


def test_a_part_reports_ranges_of_its_own_row(spark):
    kept = lineage.captured(spark.createDataFrame([("Lane", 7, ["f", "g"], None), ("Road", 8, ["f"], "seg0:0.1-0.2:B")], "road string, row_index int, fragments array<string>, partial_geometry string"))
    lines = kept.selectExpr("*", "explode(sequence(0, fragments - 1)) as frag").selectExpr("*", "concat(root, frag) as line")
    cuts = [("a", "Lane1", 0.5, 0.1), ("b", "Lane0", 0.0, 1.0), ("c", "b", 0.25, 0.75)]
    parts = spark.createDataFrame([("Lane (part 1)", "a", 1), ("Lane (part 1)", "c", 0)], "road string, line string, place int")
    made = lineage.part_lineage(parts, lineage.origins(spark.createDataFrame(cuts, CUTS)), lines)
    row = made.select("*", lineage.range_tokens(made.original_ranges).alias("tokens")).collect()
    assert [(r.road, r.root_name, r.row_index, r.current_partial, r.tokens) for r in row] == [("Lane (part 1)", "Lane", 7, "-", ["seg0:0.2500-0.7500:B", "seg1:0.1000-0.5000:B"])]


def test_trimmed_rows_are_whole_when_all_parts_are_reported(spark):
    ranges = [("r", 0, 1, 0.2, 0.3), ("r", 1, 1, 0.5, 0.6), ("r", 2, 4, 0.1, 0.9), ("r", 3, 4, 0.8, 0.95), ("s", 0, 0, 0.0, 1.0)]
    fragments = spark.createDataFrame([("r", i) for i in range(7)] + [("s", 0), ("lone", 0)], "root string, frag int")
    got = sorted(map(tuple, lineage.reported_ranges(spark.createDataFrame(ranges, "root string, part int, frag int, a double, b double"), fragments).collect()))
    # fragment 0 and 2 are nearest to 1, fragment 3 to 4; the one before wins a tie; overlaps stay
    assert got == [("r", 0, 0, 0.0, 1.0), ("r", 0, 1, 0.0, 0.4), ("r", 0, 2, 0.0, 1.0), ("r", 1, 1, 0.4, 1.0), ("r", 2, 3, 0.0, 1.0), ("r", 2, 4, 0.0, 0.9), ("r", 2, 5, 0.0, 1.0), ("r", 2, 6, 0.0, 1.0), ("r", 3, 4, 0.8, 1.0), ("s", 0, 0, 0.0, 1.0)]
