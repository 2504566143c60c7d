"""Streams against their batch versions: reports in any order, replayed batches, late and shuffled fixes."""

import datetime
import math
import random

from pyspark.sql import functions as F

from roadloom.operators import marks, tracks
from roadloom.streaming import progress, ranges

LOG = "row_index long, at long, action string, token string, complete boolean"


def reports(seed, n=400):
    rng = random.Random(seed)
    tokens = [f"seg{f}:{a:.4f}-{a + 0.25:.4f}:{s}" for f in range(2) for a in (0.0, 0.25, 0.5, 0.75) for s in "BSF"]
    return [(rng.randrange(12), rng.randrange(60), rng.choice(["add", "add", "add", "remove"]), rng.choice(tokens), rng.random() < 0.03) for _ in range(n)]


def fragments(spark):
    return spark.createDataFrame([(r, f, None) for r in range(12) for f in range(1 + r % 2)], "row_index long, frag int, length_m double")


def run(spark, folder, ledger, files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        ranges.token_changes(stream).writeStream.foreachBatch(ledger).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()


def test_reports_in_any_order_add_up_to_the_batch(spark, tmp_path):
    log = reports(1)
    want = sorted(map(tuple, marks.accumulated(spark.createDataFrame(log, LOG), fragments(spark)).collect()))
    assert {w[2] for w in want} >= {"Complete", "In_Progress"}
    # twice and in pieces, the earliest last
    files = [log[250:], log[100:300], [*log[:150], (None, 1, "add", "x", False), (1, None, "add", "x", False), (1, 2, "none", "x", False)]]
    ledger = ranges.Ledger(f"{tmp_path}/ledger", ranges.CHANGES)
    assert ledger.read(spark).collect() == []
    run(spark, tmp_path, ledger, files)
    changes = ledger.read(spark).cache()
    assert sorted(map(tuple, ranges.recorded_rows(changes, fragments(spark)).collect())) == want

    def covered(spans, at):
        return sum(a < at < b for a, b in spans)

    standing = {}
    for r in marks.recorded_tokens(spark.createDataFrame(log, LOG)).collect():
        frag, span, side = r.token[3:].split(":")
        standing.setdefault((r.row_index, int(frag), side), []).append(tuple(map(float, span.split("-"))))
    got = {}
    for r in ranges.coverage(changes).collect():
        got.setdefault((r.row_index, r.frag, r.side), []).append((r.a, r.b, r.times))
    assert set(got) == set(standing)
    for key, spans in standing.items():
        for at in (0.1, 0.3, 0.6, 0.9):
            assert sum(n for a, b, n in got[key] if a < at < b) == covered(spans, at)


def test_a_batch_counts_once_and_only_when_finished(spark, tmp_path):
    ledger = ranges.Ledger(f"{tmp_path}/ledger", ranges.CHANGES)
    one = spark.createDataFrame([(1, "seg0:0.0000-1.0000:B", 1, 1, 5, None, None)], ranges.CHANGES)
    other = spark.createDataFrame([(2, "seg0:0.0000-1.0000:B", 1, 1, 5, None, None)], ranges.CHANGES)
    ledger(one, 0)
    ledger(one.union(other), 0)  # a replay: the batch stands as it was first finished
    assert [r.row_index for r in ledger.read(spark).collect()] == [1]
    other.write.parquet(f"{tmp_path}/ledger/rows/batch_id=1")  # a batch that failed before it was finished
    assert ledger.read(spark).count() == 1
    ledger(other, 1)
    assert sorted(r.row_index for r in ledger.read(spark).collect()) == [1, 2]


def test_a_batch_calls_for_buckets_not_for_tokens(spark, tmp_path):
    token = F.format_string("seg0:%.4f-%.4f:B", F.col("id") / 20000, F.col("id") / 20000 + 0.5)
    many = spark.range(10000).select((F.col("id") % 500).alias("row_index"), F.col("id").alias("at"), F.lit("add").alias("action"), token.alias("token"), F.lit(None).cast("boolean").alias("complete"))
    many.coalesce(1).write.parquet(f"{tmp_path}/in")
    ledger = ranges.Ledger(f"{tmp_path}/ledger", ranges.CHANGES)
    stream = spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")
    query = ranges.token_changes(stream).writeStream.foreachBatch(ledger).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8192
    assert ledger.read(spark).filter("delta = 1 and version = 1").count() == 10000


FIXES = "walker long, fix long, ts timestamp, track string, lon double, lat double, accuracy double"
SEGMENTS = "track string, n long, pavement string, start_m double, from_m double, seq long, a_lon double, a_lat double, b_lon double, b_lat double"
KX = 111320 * math.cos(math.radians(52.8))
START = datetime.datetime(2024, 5, 1, 12)


def track(spark):
    """Up one side of a street, a walk between areas, then back down the other side and round a corner."""
    ll = lambda x, y: (-2.1 + x / KX, 52.8 + y / 110540)
    lines = [(1, "left", 0, 0, (0, 0), (300, 0)), (None, None, 300, 1, (300, 0), (300, 40)), (2, "right", 340, 2, (300, 40), (0, 40)), (3, "both", 640, 3, (0, 40), (0, 140))]
    bend = (3, "both", 640, 100.0, 4, (0, 140), (100, 140))
    rows = [("t", n, side, float(start), 0.0, seq, *ll(*a), *ll(*b)) for n, side, start, seq, a, b in lines] + [("t", bend[0], bend[1], float(bend[2]), bend[3], bend[4], *ll(*bend[5]), *ll(*bend[6]))]
    return spark.createDataFrame(rows, SEGMENTS)


def fixes(seed, walkers=4, n=25):
    rng, out = random.Random(seed), []
    for w in range(walkers):
        pos, at = 0.0, 0
        for i in range(n):
            at += rng.choice([20, 40, 90])
            pos = min(pos + rng.uniform(15, 60), 830)
            x, y = (pos, 0) if pos < 300 else (300, pos - 300) if pos < 340 else (640 - pos, 40) if pos < 640 else (0, pos - 600) if pos < 740 else (pos - 740, 140)
            far = 900 if rng.random() < 0.1 else 0
            out.append((w, 100 * w + i, START + datetime.timedelta(seconds=at), "t", -2.1 + (x + rng.uniform(-9, 9)) / KX, 52.8 + (y + far + rng.uniform(-9, 9)) / 110540, rng.choice([4.0, 12.0, 60.0, 700.0])))
    return out


def streamed(spark, folder, files, late):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in files:
            spark.createDataFrame(rows, FIXES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = progress.scored_stream(spark.readStream.schema(FIXES).parquet(f"{folder}/in"), track(spark), 52.8, late)
            stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return sorted(map(tuple, spark.read.schema(progress.SCORED).parquet(f"{folder}/out").filter("walker >= 0").collect()), key=str)


def test_shuffled_and_late_fixes_score_as_in_the_batch(spark, tmp_path):
    rows = fixes(3)
    want = sorted(map(tuple, progress.scored_batch(spark.createDataFrame(rows, FIXES), track(spark), 52.8).collect()), key=str)
    found = [w for w in want if w[3] is not None]
    assert len(want) == 100 and len({w[3] for w in found}) == 3 and 0 < len(want) - len(found) < 50
    rng, mixed = random.Random(5), rows[:]
    rng.shuffle(mixed)
    end = (-1, -1, START + datetime.timedelta(days=30), "t", 0.0, 0.0, 1.0)
    odd = [(None, 1, START, "t", 0.0, 0.0, 1.0), (1, None, START, "t", 0.0, 0.0, 1.0), (1, 7, None, "t", 0.0, 0.0, 1.0)]
    assert streamed(spark, tmp_path, [mixed[:40], mixed[40:70] + odd, mixed[70:], [end]], "2 hours") == want


def test_fixes_later_than_the_watermark_are_left_out(spark, tmp_path):
    rows = [r for r in fixes(4, walkers=1, n=12)]
    end = (-1, -1, START + datetime.timedelta(days=1), "t", 0.0, 0.0, 1.0)
    late = rows[2]
    got = streamed(spark, tmp_path, [rows[:2] + rows[3:] + [end], [late, (-1, -2, START + datetime.timedelta(days=2), "t", 0.0, 0.0, 1.0)]], "1 minute")
    kept = progress.scored_batch(spark.createDataFrame(rows[:2] + rows[3:], FIXES), track(spark), 52.8)
    assert got == sorted(map(tuple, kept.collect()), key=str) and len(got) == 11


def test_the_fold_scores_as_the_candidates_do(spark):
    for row in fixes(6, walkers=3, n=1):
        one = spark.createDataFrame([row], FIXES)
        best = tracks.located(one.selectExpr("fix", "track", "lon", "lat", "0.0 as from_pos", "cast(null as double) as elapsed_s", "accuracy"), track(spark), 52.8).filter("rank = 1").collect()
        got = progress.scored_batch(one, track(spark), 52.8).collect()
        assert [(r.n, round(r.pos, 6), round(r.score, 6)) for r in got if r.n is not None] == [(r.n, round(r.pos, 6), round(r.score, 6)) for r in best]
