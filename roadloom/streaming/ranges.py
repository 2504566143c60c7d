"""Reports of done stretches as a stream: what each token stands at is state, what changes is a ledger of batches.

Reports come late, twice and in any order. A token's state is its last removal and its additions since, so the order in which they
come changes nothing in the end; tokens are dealt to keys by a hash, so a row that everybody reports on is not one task's. Changes of
state are written once for each batch, and rows and coverage are read from the finished batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from roadloom.functions import parse
from roadloom.operators import marks

CHANGES = "row_index long, token string, version long, delta int, since long, removed_at long, complete_at long"
#: A moment before all others, for what has not been.
NEVER = -(1 << 62)
#: Tokens are dealt by a hash to so many keys of the state, since a call for each key costs far more than the reports in it.
BUCKETS = 8192
_STATE = "tokens string"


def _folded(state: tuple, reports: list[tuple]) -> tuple:
    """(removed, complete, version, adds) after reports (at, action, complete) in any order."""
    removed, complete, version, adds = state
    removed = max([removed, *(at for at, action, _ in reports if action == "remove")])
    complete = max([complete, *(at for at, action, done in reports if action == "add" and done)])
    return removed, complete, version + 1, sorted(x for x in {*adds, *(at for at, action, _ in reports if action == "add")} if x > removed)


def token_changes(reports: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of what reports (row_index, at, action add or remove, token, complete) change; see CHANGES.

    delta is 1 where a token comes to stand, -1 where it goes, else 0; since, removed_at and complete_at are its state's. A report
    that changes nothing gives no row. Reports without a row, token or moment are left out. A batch reads and writes the buckets that
    its tokens are in, so a stream of very many tokens and small batches wants more of them; a checkpoint keeps the number that it began with.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {(row, token): tuple(rest) for row, token, *rest in json.loads(state.get[0])} if state.exists else {}
        told: dict[tuple, list[tuple]] = {}
        for pdf in batches:
            for row, token, *report in zip(*[pdf[c].tolist() for c in ("row_index", "token", "at", "action", "complete")]):
                told.setdefault((row, token), []).append(tuple(report))
        rows = []
        for own, given in told.items():
            before = held.get(own, (NEVER, NEVER, 0, []))
            after = _folded(before, given)
            if (after[0], after[1], after[3]) != (before[0], before[1], before[3]):
                held[own] = after
                adds = after[3]
                rows.append((*own, after[2], bool(adds) - bool(before[3]), adds[0] if adds else NEVER, after[0], after[1]))
        if rows:
            state.update((json.dumps([(*own, *rest) for own, rest in held.items()]),))
            yield pd.DataFrame(rows, columns=["row_index", "token", "version", "delta", "since", "removed_at", "complete_at"])

    kept = reports.filter("row_index is not null and token is not null and at is not null and action in ('add', 'remove')")
    asked = kept.select(F.col("row_index").cast("long").alias("row_index"), "token", F.col("at").cast("long").alias("at"), "action", "complete")
    dealt = asked.withColumn("_bucket", F.pmod(F.xxhash64("row_index", "token"), F.lit(buckets)).cast("int"))
    changed = dealt.groupBy("_bucket").applyInPandasWithState(run, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)
    return changed.select("row_index", "token", "version", "delta", *[F.nullif(c, F.lit(NEVER)).alias(c) for c in ("since", "removed_at", "complete_at")])


class Ledger:
    """A sink for foreachBatch that takes each batch once, and the finished batches as a table.

    A batch's rows stand under its number and count once the number is in the list of finished ones, so a batch that
    failed half-way is written anew when it comes again, and one that is finished is not.
    """

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path.rstrip("/"), schema

    def finished(self, spark: SparkSession) -> DataFrame:
        try:
            return spark.read.schema("batch_id long").parquet(f"{self.path}/finished").distinct()
        except AnalysisException:  # nothing has been finished yet
            return spark.createDataFrame([], "batch_id long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not self.finished(spark).filter(F.col("batch_id") == batch_id).isEmpty():
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/rows/batch_id={batch_id}")
        spark.range(batch_id, batch_id + 1).withColumnRenamed("id", "batch_id").coalesce(1).write.mode("append").parquet(f"{self.path}/finished")

    def read(self, spark: SparkSession) -> DataFrame:
        done = self.finished(spark)
        if done.isEmpty():
            return spark.createDataFrame([], StructType.fromDDL(f"{self.schema}, batch_id long"))
        rows = spark.read.schema(f"{self.schema}, batch_id long").parquet(f"{self.path}/rows")
        return rows.join(done, "batch_id", "left_semi")


def standing_tokens(changes: DataFrame) -> DataFrame:
    """row_index, token, since of the tokens that stand after a ledger's changes: their increments add up to one."""
    last = changes.groupBy("row_index", "token").agg(F.sum("delta").alias("_n"), F.max_by("since", "version").alias("since"))
    return last.filter("_n > 0").select("row_index", "token", "since")


def recorded_rows(changes: DataFrame, fragments: DataFrame) -> DataFrame:
    """row_index, partial_geometry, status after a ledger's changes; see ``marks.accumulated``."""
    told = changes.groupBy("row_index").agg(F.max("complete_at").alias("complete_at"), F.max("removed_at").alias("removed_at"))
    return marks.row_status(standing_tokens(changes), fragments, told)


def coverage(changes: DataFrame) -> DataFrame:
    """row_index, frag, side, a, b, times: how many standing tokens cover each stretch, by running sums of signed endpoints.

    An increment adds its sign at a stretch's beginning and takes it off at its end; increments of any batches add up, so ledgers merge.
    """
    spans = changes.filter("delta <> 0").select("row_index", "delta", F.explode(parse.partial_ranges(F.col("token"))).alias("r"))
    ends = spans.select("row_index", "r.frag", "r.side", F.explode(F.array(F.struct(F.col("r.a").alias("at"), F.col("delta").alias("d")), F.struct(F.col("r.b").alias("at"), (-F.col("delta")).alias("d")))).alias("e"))
    key = ("row_index", "frag", "side")
    summed = ends.groupBy(*key, F.col("e.at").alias("a")).agg(F.sum("e.d").alias("_d")).filter("_d <> 0")
    order = Window.partitionBy(*key).orderBy("a")
    run = summed.select(*key, "a", F.lead("a").over(order).alias("b"), F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("times"))
    return run.filter("times > 0")
