"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes sets the chunk borders; they are normalised, that is, harder to meet before
the usual size and easier after it. A fingerprint is the set of chunk digests with the chunks' lengths, so a
passage keeps its chunks wherever it stands; likeness is the shared length over that of the smaller set.

Defined cases: a null text is an empty one, with an empty fingerprint; two empty texts are alike (1), an empty
and another are not (0); rows with one doc_id stand in the order of their texts; a null doc_id sorts below all;
a single document is its own next one; an empty table gives no rows; further columns are ignored; a long text is
walked in blocks of BLOCK bytes. Rows without a doc_id, or with one that very many share, stand in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import byte_table, lean, mix64

LEAST, USUAL, MOST = 32, 96, 384
#: Ranges of identifiers for each partition, dealt by a hash; and the bytes of text that weigh as much as a row in choosing them.
PLACES, PAGE_BYTES = 16, 4096
_HARD, _EASY = np.uint32(0xFE000000), np.uint32(0xF8000000)  # before and after the usual size
_GEAR = byte_table(7)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


#: A long text is walked in blocks of this many bytes.
BLOCK = 1 << 20
_UP, _DOWN = _powers(_FACTOR, BLOCK + 512), _powers(_INVERSE, BLOCK + 512)


def _borders_of(raw: np.ndarray) -> tuple[list[int], list[int]]:
    """Last bytes of possible chunks, by the easy and by the hard condition."""
    easy, hard = [], []
    for at in range(0, len(raw), BLOCK):
        before = min(at, 31)
        h = (_GEAR[raw[at - before : at + BLOCK]] >> np.uint64(17)).astype(np.uint32)
        for step in (1, 2, 4, 8, 16):  # h[i] sums the gears of the last 2 * step bytes, each shifted by its distance
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
            h = more
        h = h[before:]
        found = np.flatnonzero((h & _EASY) == 0)
        hard += (at + found[(h[found] & _HARD) == 0]).tolist()
        easy += (at + found).tolist()
    return easy, hard


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Borders (from 0 to the end) and a digest for each chunk."""
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    easy, hard = _borders_of(raw)
    borders, at, i, j = [0], 0, 0, 0
    while n - at > LEAST:
        while i < len(hard) and hard[i] < at + LEAST - 1:
            i += 1
        if i < len(hard) and hard[i] < at + USUAL:
            at = hard[i] + 1
        else:
            while j < len(easy) and easy[j] < at + USUAL:
                j += 1
            at = min(easy[j] + 1 if j < len(easy) else n, at + MOST, n)
        borders.append(at)
    if borders[-1] < n:
        borders.append(n)
    edge, digests, first = np.array(borders, np.int64), [], 0
    while first < len(edge) - 1:
        # chunks of a block together
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + BLOCK, side="right")) - 1)
        own = edge[first : last + 1] - edge[first]
        sums = np.zeros(own[-1] + 1, np.uint64)
        np.cumsum(_GEAR[raw[edge[first] : edge[last]]] * _UP[: own[-1]], out=sums[1:])
        digests.append(mix64((sums[own[1:]] - sums[own[:-1]]) * _DOWN[own[:-1]] + np.diff(own).astype(np.uint64)))
        first = last
    return edge, np.concatenate(digests)


def fingerprint(data: bytes) -> np.ndarray:
    """Sorted distinct 64-bit words: 52 bits of a chunk's digest above 12 of its length."""
    edge, digest = chunks(data)
    return np.unique(digest & np.uint64(0xFFFFFFFFFFFFF000) | np.diff(edge).astype(np.uint64))


def shown(prints: np.ndarray) -> str:
    """Sixteen hexadecimal digits for each chunk."""
    return prints.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller set in the larger, weighted by length."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    size = lambda x: int((x & np.uint64(0xFFF)).sum())
    return size(np.intersect1d(a, b, assume_unique=True)) / min(size(a), size(b))


def with_edited(text: str, following: str) -> str:
    """The second half of a text replaced by the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text of docs (doc_id, text) and of its edited text, and their likeness.

    The edited text takes its second half from the next document in descending order of doc_id.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # an identifier counts as often as its text has pages, so places hold about equally many bytes
    pages = rows.select("key", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("text") / PAGE_BYTES).cast("int"))))
    places = PLACES * parts
    found = pages.agg(F.percentile_approx("key", [i / places for i in range(1, places)], 10 * places).alias("b")).first().b
    bounds = [int(x) for x in np.unique(np.array(found or [], np.int64))]
    # the places of the ranges, the highest ids first
    place = (len(bounds) - F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key")))) if bounds else F.lit(0)
    placed = rows.withColumn("place", place.cast("int"))
    # the first document of each place stands at the end of the place before it: one row for each place. Its
    # identifier is found first, as that reads no texts
    order = Window.orderBy("place")  # over as many rows as there are places
    heads = placed.groupBy("place").agg(F.max("key").alias("_key")).select(
        F.col("place").alias("_place"), "_key", F.lag("place").over(order).isNull().alias("round"),
        F.coalesce(F.lag("place").over(order), F.max("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("to"),
    )
    met = placed.join(F.broadcast(heads), (F.col("place") == F.col("_place")) & (F.col("key") == F.col("_key")))
    guests = met.groupBy("to", "round", "key").agg(F.max("text").alias("text")).select(F.col("to").alias("place"), F.lit(True).alias("guest"), "round", "key", F.lit(None).cast("long").alias("doc_id"), "text")
    both = placed.select("place", F.lit(False).alias("guest"), F.lit(False).alias("round"), "key", "doc_id", "text").unionByName(guests)
    sorted_rows = both.repartition(parts, "place").sortWithinPartitions("place", "guest", "round", F.col("key").desc(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # place, doc_id, text, fingerprint of the row whose next one has yet to come
        out: list[list] = [[] for _ in range(7)]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for place, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                prints = fingerprint(text.encode())
                if before is not None and before[0] == place:
                    _, own_doc, own, own_prints = before
                    edited = with_edited(own, text).encode()
                    edited_prints = fingerprint(edited)
                    made = (own_doc, len(own), hashlib.sha256(edited).hexdigest(), shown(own_prints), shown(edited_prints), likeness(own_prints, edited_prints), likeness(own_prints, prints))
                    for column, value in zip(out, made):
                        column.append(value)
                before = None if guest else (place, doc, text, prints)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            out = [[] for _ in range(7)]

    return sorted_rows.select("place", "guest", "doc_id", "text").mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
