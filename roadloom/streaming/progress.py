"""Streams: a walker's progress along a track, and publishing once for each identifier.

Progress comes twice: ``progress_stream`` takes positions that are known already, ``scored_stream`` takes position fixes, holds
them until the watermark has passed, and scores them in order against the pieces of the walker's track.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupStateTimeout

from roadloom.operators import tracks

PACE_MPS, BEHIND_M, AHEAD_M = 0.45, 40.0, 150.0
OFF_LINE_M = 30.0
FIXES = "walker long, ts timestamp, pos double, off_m double, accuracy double"
MATCHED = "walker long, ts timestamp, pos double, matched double, accepted boolean"


def match_fixes(fixes: pd.DataFrame, last: float, last_s: float | None) -> tuple[pd.DataFrame, float, float | None]:
    """Fixes of one walker in time order: each is taken if it lies in the window that the pace allows.

    The window runs from 40 m behind the last position to 2.5 times the expected way and 150 m ahead; a fix
    further off the line than 30 m and twice its accuracy is not taken.
    """
    rows = []
    for f in fixes.itertuples():
        now = f.ts.timestamp()
        gone = None if last_s is None else max(0.0, now - last_s)
        top = float("inf") if gone is None else last + 2.5 * PACE_MPS * gone + AHEAD_M
        taken = last - BEHIND_M <= f.pos <= top and f.off_m <= max(OFF_LINE_M, 2 * f.accuracy)
        if taken:
            last, last_s = f.pos, now
        rows.append((f.walker, f.ts, f.pos, last, taken))
    return pd.DataFrame(rows, columns=["walker", "ts", "pos", "matched", "accepted"]), last, last_s


def progress_batch(fixes: DataFrame) -> DataFrame:
    """The batch twin: every walker from the start of the track.

    Each task goes over its sorted fixes in Arrow batches and carries only the walker, the last position and its time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last, last_s = None, 0.0, None
        for pdf in batches:
            out = []
            for key, part in pdf.groupby(["unknown", "walker"], sort=False):
                if key != who:
                    who, last, last_s = key, 0.0, None
                done, last, last_s = match_fixes(part, last, last_s)
                out.append(done.assign(unknown=key[0]))
            if out:
                yield pd.concat(out)

    # a null walker is one of its own, and nulls would turn the identifiers of its batch into doubles
    named = fixes.select(F.coalesce("walker", F.lit(0)).alias("walker"), "ts", "pos", "off_m", "accuracy", F.col("walker").isNull().alias("unknown"))
    order = ("unknown", "walker", "ts", "pos", "off_m", "accuracy")
    done = named.repartition("unknown", "walker").sortWithinPartitions(*order).mapInPandas(run, f"{MATCHED}, unknown boolean")
    return done.withColumn("walker", F.when(~F.col("unknown"), F.col("walker"))).drop("unknown")


def progress_stream(fixes: DataFrame) -> DataFrame:
    """A stream of fixes with the position after each; the state is the last position and its time."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, last_s = state.get if state.exists else (0.0, None)
        out, last, last_s = match_fixes(pd.concat(list(batches)).sort_values(["ts", "pos"]), last, last_s)
        state.update((last, last_s))
        yield out

    return fixes.groupBy("walker").applyInPandasWithState(run, MATCHED, "last double, last_s double", "append", GroupStateTimeout.NoTimeout)


#: What a fix meets: one row for each segment within reach, or one without a step.
MET = "walker long, fix long, ts timestamp, accuracy double, n long, piece double, seq long, pavement string, pos double, d double, side double"
SCORED = "walker long, fix long, ts timestamp, n long, pos double, score double"
#: Levels of cells of the stream's static side: reaches from 30 m to 61 km; fixes beyond are not located.
LEVELS = 12


def met_segments(fixes: DataFrame, segments: DataFrame, lat0: float) -> DataFrame:
    """MET for fixes (walker, fix, ts, track, lon, lat, accuracy), a table or a stream; segments as of ``tracks.located``."""
    levels = segments.select(F.col("track").alias("_track")).distinct().withColumn("_size", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    met = tracks.beside(tracks.in_cells(fixes, lat0), tracks.placed_segments(segments, levels, lat0), lat0, "left")
    near = F.greatest(F.lit(tracks.LEAST_REACH_M), F.col("accuracy") * 2)
    within = F.col("n").isNotNull() & (F.col("d") <= near)
    hit = lambda c, kind: F.when(within, c).cast(kind)
    return met.select(
        F.col("walker").cast("long").alias("walker"), F.col("fix").cast("long").alias("fix"), "ts", "accuracy", hit(F.col("n"), "long").alias("n"), hit(F.col("start_m"), "double").alias("piece"), hit(F.col("seq"), "long").alias("seq"),
        hit(F.col("pavement"), "string").alias("pavement"), hit(F.col("start_m") + F.col("s"), "double").alias("pos"), hit(F.col("d"), "double").alias("d"), hit(F.col("side"), "double").alias("side"),
    )


def best_step(hits: list[tuple], accuracy: float, last: float, gone: float | None) -> tuple[float, int, float] | None:
    """(score, n, pos) of the likeliest of a fix's hits (n, piece, seq, pavement, pos, d, side), or None; see ``tracks.located``."""
    near, spread = max(tracks.LEAST_REACH_M, 2 * accuracy), tracks.SPREAD_M
    expected, top = last, math.inf
    if gone is not None:
        way = gone * tracks.PACE_MPS
        expected, top, spread = last + way, last + way * 2.5 + 150, max(120.0, way * 0.6)
    pieces: dict[tuple, tuple] = {}
    for n, piece, seq, pavement, pos, d, side in hits:
        if n is not None:
            key = (n, piece)
            pieces[key] = min(pieces.get(key, (math.inf,)), (d, seq, pos, side, pavement))
    found = []
    for (n, _), (d, _, pos, side, pavement) in pieces.items():
        if last - tracks.BEHIND_M <= pos <= top:
            usual = {"right": -tracks.PAVEMENT_M, "left": tracks.PAVEMENT_M}.get(pavement, 0.0)
            found.append(((d / near) ** 2 + ((side - usual) / (accuracy + 6)) ** 2 + ((pos - expected) / spread) ** 2 + max(0.0, pos - expected) / spread * 0.5, n, pos))
    return min(found, default=None)


def _in_order(rows: list[tuple], last: float, last_ms: int | None) -> tuple[list[tuple], float, int | None]:
    """Results of rows of MET without the walker, given in order of time and fix; a fix that is nowhere leaves the position as it was."""
    out, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][:2] == rows[at][:2]:
            end += 1
        ms, fix, accuracy = rows[at][:3]
        gone = None if last_ms is None else (ms - last_ms) / 1000
        best = best_step([r[3:] for r in rows[at:end]], accuracy, last, gone)
        if best is None:
            out.append((fix, ms, None, None, None))
        else:
            out.append((fix, ms, best[1], best[2], best[0]))
            last, last_ms = best[2], ms
        at = end
    return out, last, last_ms


def _rows(frame: pd.DataFrame) -> list[tuple]:
    """(ms, fix, accuracy, n, …) of rows of MET, with None for what is missing."""
    known = frame.astype(object).where(frame.notna(), None)
    ms = (frame.ts.astype("datetime64[ms]").astype("int64")).tolist()
    whole = lambda v: None if v is None else int(v)
    return [(m, int(f), 0.0 if a is None else a, whole(n), p, whole(q), v, pos, d, side) for m, f, a, n, p, q, v, pos, d, side in zip(ms, frame.fix, known.accuracy, known.n, known.piece, known.seq, known.pavement, known.pos, known.d, known.side)]


def _results(walker: int, done: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame([(walker, *r) for r in done], columns=["walker", "fix", "ts", "n", "pos", "score"])
    return out.assign(ts=pd.to_datetime(out.ts, unit="ms"), n=out.n.astype("Int64"), pos=out.pos.astype(float), score=out.score.astype(float))


def scored_batch(fixes: DataFrame, segments: DataFrame, lat0: float) -> DataFrame:
    """SCORED of a table of fixes: every walker from the start of the track, in order of time.

    A task goes over its sorted rows and carries the walker's last position and the rows of one fix.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last, last_ms, held = None, 0.0, None, []
        for pdf in batches:
            out = []
            for walker, part in pdf.groupby("walker", sort=False):
                if walker != who:
                    if held:
                        out.append(_results(who, _in_order(held, last, last_ms)[0]))
                    who, last, last_ms, held = walker, 0.0, None, []
                rows = [*held, *_rows(part)]
                # the last fix may go on in the next batch
                cut = next((k for k in range(len(rows), 0, -1) if rows[k - 1][:2] != rows[-1][:2]), 0)
                done, last, last_ms = _in_order(rows[:cut], last, last_ms)
                held = rows[cut:]
                if done:
                    out.append(_results(who, done))
            if out:
                yield pd.concat(out)
        if held:
            yield _results(who, _in_order(held, last, last_ms)[0])

    met = met_segments(fixes, segments, lat0).filter("walker is not null and fix is not null and ts is not null")
    return met.repartition("walker").sortWithinPartitions("walker", "ts", "fix").mapInPandas(run, SCORED)


class _Scorer(StatefulProcessor):
    """Holds what fixes met until the watermark passes them, then scores them in order; the value state is the last position and its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "pos double, ms long")
        self.held = handle.getListState("held", "ms long, fix long, accuracy double, n long, piece double, seq long, pavement string, pos double, d double, side double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = _rows(pdf)
            if new:
                self.held.appendList(new)
                # one timer does all that has passed and sets the next one
                self.handle.registerTimer(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, kept = timerValues.getCurrentWatermarkInMs(), [tuple(r) for r in self.held.get()]
        ready = sorted((r for r in kept if r[0] <= passed), key=lambda r: r[:2])
        if not ready:  # another timer has done them
            return
        left = [r for r in kept if r[0] > passed]
        last, last_ms = self.last.get() if self.last.exists() else (0.0, None)
        done, last, last_ms = _in_order(ready, last, last_ms)
        if last_ms is not None:
            self.last.update((last, last_ms))
        self.held.clear()
        if left:
            self.held.put(left)
            self.handle.registerTimer(min(r[0] for r in left))
        yield _results(key[0], done)

    def close(self) -> None:
        pass


def scored_stream(fixes: DataFrame, segments: DataFrame, lat0: float, late: str = "10 minutes") -> DataFrame:
    """SCORED of a stream of fixes, each once the watermark has passed it; equal to ``scored_batch`` for fixes that are not later than ``late``.

    Fixes that are later are left out. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    met = met_segments(fixes.filter("walker is not null and fix is not null and ts is not null").withWatermark("ts", late), segments, lat0)
    return met.groupBy("walker").transformWithStateInPandas(_Scorer(), SCORED, "append", "eventTime")


def published_once(requests: DataFrame, key: str = "publish_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream of requests, each identifier once; a retry within the watermark is dropped."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def routed(changes: DataFrame, authorised: Column) -> tuple[DataFrame, DataFrame]:
    """Changes to write at once, and changes for the review queue."""
    allowed = F.coalesce(authorised, F.lit(False))
    return changes.filter(allowed), changes.filter(~allowed)
