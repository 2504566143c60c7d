"""Packing token sequences into as few fixed-length sequences as possible.

Lengths are at most ``limit``, so the whole corpus is planned from a histogram of that many counts, whatever
its size. The plan is a list of runs: "the pieces of this length with these ranks go to these sequences at
this offset". Ranks come from counts per task, so no length has to fit into one task.

Defined cases: a null text is an empty one and gives one piece with the closing id alone; repeated rows are
packed each; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, lean
from roadloom.llm.word_tokens import word_tokens

LIMIT = 4096
CLOSING_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row for each piece; ``task`` and ``nth`` number the pieces of one length within a task."""
    closing = np.uint32(closing_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = word_tokens(tokenizer).ids_bytes, TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + closing
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    n = len(part) // 4
                    for column, value in zip(out, (doc, piece, at // 4, n, zlib.crc32(part), task, seen[n])):
                        column.append(value)
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select("doc_id", "text").mapInArrow(lean(cut), _PIECES)


class _Plan:
    """Runs of (length, first rank, pieces, first sequence, offset)."""

    def __init__(self, counts: np.ndarray):
        self.left, self.limit = counts.copy(), len(counts) - 1
        self.next_rank, self.sequences = np.zeros(len(counts), np.int64), 0
        self.runs: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.runs.append((length, int(self.next_rank[length]), times, sequence, offset))
        self.next_rank[length] += times
        self.left[length] -= times

    def fill(self, lengths: list[int], times: int) -> None:
        offset = 0
        for length in lengths:
            self.put(length, times, self.sequences, offset)
            offset += length
        self.sequences += times

    def complement(self, first: int) -> list[int] | None:
        """Up to three available lengths that fill the gap beside ``first`` exactly, the longest ones first."""
        have, gap = self.left.copy(), self.limit - first
        have[first] -= 1
        if gap == 0:
            return []
        if have[gap] > 0:
            return [gap]
        there = have > 0

        def pair(total: int, counts: np.ndarray) -> list[int] | None:
            low = np.arange(1, total // 2 + 1)
            good = low[(counts[low] > 0) & (counts[total - low] > 0)]
            good = good[(2 * good != total) | (counts[good] > 1)]
            return [total - int(good[-1]), int(good[-1])] if len(good) else None

        if gap >= 2 and (two := pair(gap, have)):
            return two
        # sums of two available lengths, as an index over all totals up to the gap
        size = 1 << (2 * gap + 2).bit_length()
        row = np.zeros(size)
        row[: gap + 1] = there[: gap + 1]
        sums = np.fft.irfft(np.fft.rfft(row) ** 2, size)[: gap + 1] > 0.5
        third = np.flatnonzero(there[: gap + 1])
        for length in third[sums[gap - third]][::-1]:
            rest = have.copy()
            rest[length] -= 1
            if two := pair(gap - int(length), rest):
                return [int(length), *two]
        return None

    def exact(self) -> None:
        for length in range(self.limit, 0, -1):
            while self.left[length] > 0 and 4 * length >= self.limit:
                rest = self.complement(length)
                if rest is None:
                    break
                used, times = np.unique([length, *rest], return_counts=True)
                self.fill([length, *rest], int((self.left[used] // times).min()))

    def best_fit(self) -> None:
        """What is left, the longest first, each into the fullest open sequence that can take it."""
        open_by_gap: dict[int, list[tuple[int, int]]] = {}
        for length in range(self.limit, 0, -1):
            while self.left[length] > 0:
                gaps = [g for g in open_by_gap if g >= length]
                if gaps:
                    gap = min(gaps)
                    first, count = open_by_gap[gap].pop()
                    if not open_by_gap[gap]:
                        del open_by_gap[gap]
                else:
                    gap, first = self.limit, self.sequences
                    count = max(1, -(-int(self.left[length]) // (gap // length)))
                    self.sequences += count
                each = min(gap // length, int(self.left[length]))
                whole = min(count, int(self.left[length]) // each)
                for k in range(each):
                    self.put(length, whole, first, self.limit - gap + k * length)
                if whole < count:
                    open_by_gap.setdefault(gap, []).append((first + whole, count - whole))
                if gap > each * length:
                    open_by_gap.setdefault(gap - each * length, []).append((first, whole))


def plan_runs(counts: np.ndarray) -> np.ndarray:
    """counts[n] pieces of length n. Exact fills by one, two or three others, then best fit; sorted by length and rank."""
    plan = _Plan(counts)
    plan.exact()
    plan.best_fit()
    runs = np.array(plan.runs, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = LIMIT, closing_id: int = CLOSING_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text)."""
    spark = docs.sparkSession
    pieces = Scratch(spark).write(cut_pieces(docs, tokenizer, limit, closing_id), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(limit + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``limit`` rows
        counts[row.length] = row.n
    runs = spark.sparkContext.broadcast(plan_runs(counts))  # its size depends on the limit, not on the documents
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select(F.col("length").alias("_l"), F.col("task").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (F.col("length") == F.col("_l")) & (F.col("task") == F.col("_t"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        firsts = np.searchsorted(table[:, 0], np.arange(limit + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = firsts[n] + np.searchsorted(table[firsts[n] : firsts[n + 1], 1], rank[own], side="right") - 1
            run = table[at]
            sequence = run[:, 3] + rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(run[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
