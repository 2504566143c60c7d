"""Removal of passages that stand earlier in the corpus, by longest-previous-factor arrays.

Every string of ``length`` bytes has an anchor, its least k-gram by hash, so equal strings have equal anchors
at the same offset. A stretch of places that share an anchor is one record: a hash of the k-gram, and one of
the stretch's bytes. Records of a k-gram meet in one task. Stretches that are equal throughout are decided
there: all but the first are repeats. Only where one k-gram has several different stretches are bytes fetched.
Their places are brought into suffix order, and within a run of places that agree on ``length`` bytes one
whose position has a smaller one before or after it in that order (previous and next smaller value) has a
longest previous factor of at least that length.

The stretches of a k-gram with more than ``GROUP_RECORDS`` different ones are not brought together: their places
are dealt out by their own strings, of which each task sends on only the first, and what meets there is put in
suffix order like any other group. The number sets how work is dealt, not what is found.

Stretches of one k-gram are told apart by 96 bits of hash, and the bytes themselves in suffix order. Rows with
one doc_id are told apart by 32 bits of a hash of their texts.

Defined cases: a null text is an empty one; a text shorter than ``length`` keeps all; rows with one doc_id and
one text are one document, other rows with one doc_id are different documents in the order of a hash of their
texts; a null doc_id stands after all others; an empty table gives no rows; further columns are ignored (or stay,
in ``without_repeats``, whatever their names); a long text is walked in overlapping blocks of BLOCK places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, byte_table, lean, mix64, row_groups, shuffle_parts, utf8_batch

LENGTH, GRAM = 100, 28
BLOCK, FLUSH = 1 << 18, 200_000
GROUP_RECORDS = 10_000
CHUNK_BYTES = 2 << 20
LAST = (1 << 63) - 1
_FACTOR = 0x9E3779B97F4A7C15
_BYTES = byte_table(23)
_POWERS: dict[str, np.ndarray] = {}
_FIELDS = (("h", "<u4"), ("c", "<u8"), ("key", "<i8"), ("text", "<u4"), ("start", "<i8"), ("n", "u1"), ("lead", "u1"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            out = np.ones(max(n, BLOCK + 1), np.uint64)
            have = 1
            while have < len(out):
                more = min(have, len(out) - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def blocks(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of about BLOCK bytes together, or a part of a longer text: the first one's number, its offset, bytes, bounds.

    Every string of ``length`` bytes of a long text is in one of its parts.
    """
    raw, bounds = utf8_batch(column)
    first = 0
    while first < len(bounds) - 1:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        part = raw[bounds[first] : bounds[end]]
        if len(part) <= 2 * BLOCK:
            yield first, 0, part, bounds[first : end + 1] - bounds[first]
        else:
            for at in range(0, len(part) - length + 1, BLOCK):
                piece = part[at : at + BLOCK + length - 1]
                yield first, at, piece, np.array([0, len(piece)])
        first = end


def records(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Stretches of places with one anchor."""
    sums = _sums(raw)
    n, width = len(raw) - gram + 1, length - gram + 1
    size = np.diff(bounds)
    if n < width:
        return {}
    place = np.arange(n)
    # the k-gram's hash above its position: the least of them is the leftmost of the least
    low = np.uint64((1 << max(21, len(raw).bit_length())) - 1)
    least = (_hashes(sums, place, place + gram) & ~low) | place.astype(np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & low).astype(np.int64)
    places = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(size)), places)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places) + bounds[owner]
    if not len(inside):
        return {}
    anchor = anchor[inside]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[new, len(anchor)])
    start, anchor, owner = inside[new], anchor[new], owner[new]
    lead = anchor - start
    whole = _hashes(sums, start, start + count - 1 + length)
    return {
        "h": _hashes(sums, anchor, anchor + gram),
        "c": mix64(whole ^ mix64((lead * 256 + count).astype(np.uint64))),
        "owner": owner,
        "start": start - bounds[owner],
        "n": count.astype(np.uint8),
        "lead": lead.astype(np.uint8),
    }


def _packed(table: dict[str, np.ndarray], bucket: np.ndarray, names: list[str]) -> pa.RecordBatch:
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    there, first = np.unique(bucket, return_index=True)
    blobs = []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        part = {k: table[k][a:b].astype(t) for k, t in _FIELDS}
        with np.errstate(over="ignore"):
            part["key"] = np.diff(part["key"], prepend=np.int64(0))
        flat = b"".join(part[k].tobytes() for k in ("key", "text", "start", "n", "lead"))
        blobs.append(np.int64(b - a).tobytes() + part["h"].tobytes() + part["c"].tobytes() + press(flat))
    none = pa.array([None] * len(there), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), none, none, none, none, pa.array(blobs, pa.binary())], names=names)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    import zstandard

    parts: dict[str, list] = {k: [] for k, _ in _FIELDS}
    kinds = dict(_FIELDS)
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        parts["h"].append(np.frombuffer(blob, "<u4", n, 8))
        parts["c"].append(np.frombuffer(blob, "<u8", n, 8 + 4 * n))
        flat, at = zstandard.ZstdDecompressor().decompress(blob[8 + 12 * n :]), 0
        for k in ("key", "text", "start", "n", "lead"):
            own = np.frombuffer(flat, kinds[k], n, at)
            at += own.nbytes
            parts[k].append(np.cumsum(own) if k == "key" else own)
    return {k: np.concatenate(v) for k, v in parts.items()}


def _later(table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by equal stretches and place, and which rows in that order have an equal one before them."""
    order = np.lexsort((table["start"], table["text"], table["key"], table["h"], table["c"]))
    h, c = table["h"][order], table["c"][order]
    same = np.r_[False, (h[1:] == h[:-1]) & (c[1:] == c[:-1])]
    # one document given twice has its records twice: those are not later, but the same
    twin = np.ones(len(order), bool)
    for k in ("key", "text", "start"):
        twin &= np.r_[False, table[k][order][1:] == table[k][order][:-1]]
    fresh = np.maximum.accumulate(np.where(~(same & twin), np.arange(len(order)), 0))
    return order[~(same & twin)], same[fresh][~(same & twin)]


def _merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one owner as one; rows sorted by owner and start."""
    if not len(owner):
        return owner, start, end
    shift = owner.astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.r_[True, start[1:] + shift[1:] > reach[:-1]])
    last = np.r_[new[1:], len(owner)] - 1
    return owner[new], start[new], reach[last] - shift[last]


def _recorded(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Packed records by bucket of their k-gram; spans (key, text, start, end) already known from one task's texts."""
    names = ["bucket", "key", "text", "start", "end", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            table = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            order, later = _later(table)
            gone = np.sort(order[later])  # as they stood: by text and place
            if len(gone):
                key, text, start = (table[k][gone] for k in ("key", "text", "start"))
                sort = np.lexsort((start, text, key))
                key, text, start, end = key[sort], text[sort], start[sort], (start + table["n"][gone] - 1 + length)[sort]
                owner = np.cumsum(np.r_[0, (key[1:] != key[:-1]) | (text[1:] != text[:-1])])
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                owner, start, end = _merged(owner, start, end)
                # known spans only pass through: dealt evenly by document, as most of them begin at 0
                bucket = pa.array((mix64(key[first][owner].view(np.uint64) + start.view(np.uint64)) % np.uint64(buckets)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, pa.array(key[first][owner]), pa.array(text[first][owner].astype(np.int64)), pa.array(start), pa.array(end), pa.array([None] * len(start), pa.binary())], names=names)
            left = order[~later]
            bucket = (table["h"][left] % np.uint64(buckets)).astype(np.int32)
            sort = np.lexsort((table["start"][left], table["key"][left], bucket))
            left, bucket = left[sort], bucket[sort]
            yield _packed({k: (table[k][left] >> np.uint64(32)) if k == "h" else table[k][left] for k, _ in _FIELDS}, bucket, names)

        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32)
            for first, offset, raw, bounds in blocks(batch.column(2), length):
                found = records(raw, bounds, length, gram)
                if found:
                    own = first + found.pop("owner")
                    found["key"], found["text"], found["start"] = keys[own], texts[own], found["start"] + offset
                    held.append(found)
                    size += len(found["h"])
            if size > FLUSH:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    return docs.mapInArrow(lean(run), "bucket int, key long, text long, start long, end long, payload binary")


def _decided(recorded: DataFrame, length: int, most: int) -> DataFrame:
    """Spans (grp null) and the records of k-grams that have several different stretches (grp, n, lead, hot)."""
    names = ["key", "text", "start", "end", "grp", "lead", "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, bucket = [], {}
        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            if known.num_rows:
                none = [None] * known.num_rows
                yield pa.RecordBatch.from_arrays([*known.columns[1:5], pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.bool_())], names=names)
            rest = batch.filter(batch.column(5).is_valid())
            for b, x in zip(rest.column(0).to_pylist(), rest.column(5).to_pylist()):
                bucket.setdefault(b, []).append(x)
        while bucket:
            number, blobs = bucket.popitem()
            table = _unpacked(blobs)
            order, later = _later(table)
            first = order[~later]
            first = first[np.argsort(table["h"][first], kind="stable")]
            h = table["h"][first]
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            count = np.repeat(np.diff(np.r_[start, len(h)]), np.diff(np.r_[start, len(h)]))
            for rows, grouped in ((order[later], False), (first[count > 1], True)):
                hot = count[count > 1] > most
                for at in range(0, len(rows), 1 << 16):
                    own = rows[at : at + (1 << 16)]
                    end = table["start"][own] + table["n"][own] - 1 + length
                    grp = pa.array((table["h"][own].astype(np.int64) << 24) ^ number) if grouped else pa.array([None] * len(own), pa.int64())
                    lead = pa.array(table["lead"][own].astype(np.int64)) if grouped else pa.array([None] * len(own), pa.int64())
                    flag = pa.array(hot[at : at + (1 << 16)]) if grouped else pa.array([None] * len(own), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(table["key"][own]), pa.array(table["text"][own].astype(np.int64)), pa.array(table["start"][own].astype(np.int64)), pa.array(end.astype(np.int64)), grp, lead, flag], names=names)

    parts = shuffle_parts(recorded.sparkSession)
    return recorded.repartition(parts, "bucket").mapInArrow(lean(run), "key long, text long, start long, end long, grp long, lead long, hot boolean")


def _fetched(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted stretches. joined: key, own, doc, wanted (array of start, end, grp, lead, hot).

    Places of hot k-grams are stretches of their own, grouped by their strings; of those with one string, a
    task sends on the first and reports the others as spans (data null), dealt by their places.
    """
    names = ["grp", "key", "text", "start", "end", "lead", "data"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 6, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, firsts = [], {}
            keys, texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            raw, bounds = utf8_batch(batch.column(2).field(0))
            for i, (key, own) in enumerate(zip(keys, texts)):
                data = raw[bounds[i] : bounds[i + 1]].tobytes()
                for x in wanted[i]:
                    part = data[x["start"] : x["end"]]
                    if not x["hot"]:
                        rows.append((x["grp"], key, own, x["start"], x["end"], x["lead"], part))
                        continue
                    for k in range(len(part) - length + 1):
                        string = part[k : k + length]
                        row = (key, own, x["start"] + k)
                        before = firsts.get(string)
                        if before is None or row < before:
                            firsts[string] = row
                        later = row if before is not None and row > before else before if before is not None and row < before else None
                        if later:
                            rows.append((hash(later), *later, later[2] + length, 0, None))
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
            for string, (key, own, start) in firsts.items():
                grp = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
                rows.append((grp, key, own, start, start + length, 0, string))
            if rows:
                yield batch_of(rows)

    return joined.mapInArrow(lean(run), "grp long, key long, text long, start long, end long, lead long, data binary")


def suffix_runs(words: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order within their groups, and the run of each; runs agree on ``length`` bytes.

    words[p] are the eight bytes from p on, as a big-endian number. The order is refined eight bytes at a time,
    and a place that no other agrees with leaves, as its longest previous factor is too short.
    """
    left = np.arange(len(place))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        word = words[place[left] + at]
        order = np.lexsort((word, group))
        left, group, word = left[order], group[order], word[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])] if len(left) else np.zeros(0, bool)
        group = np.cumsum(new) if len(left) else group
        alone = new & np.r_[new[1:], True] if len(left) else new
        left, group = left[~alone], group[~alone]
        if not len(left):
            break
    return left, group


def has_previous_factor(position: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For places in suffix order, whether a smaller position precedes or follows within the run."""
    if not len(run):
        return np.zeros(0, bool)
    number = np.cumsum(np.r_[0, run[1:] != run[:-1]])
    top = int(position.max()) + 1
    # minima so far within a run: later runs are shifted below all earlier ones
    before = np.minimum.accumulate(position - number * top) + number * top
    after = (np.minimum.accumulate((position - (number[-1] - number) * top)[::-1]) + ((number[-1] - number) * top)[::-1])[::-1]
    return (before < position) | (after < position)


def _repeats(stretches: DataFrame, length: int) -> DataFrame:
    """Spans of the places with a longest previous factor of ``length`` or more among the stretches of their group."""
    names = ["key", "text", "start", "end"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        grp, key, text, start, end, lead = (table.column(i).to_numpy() for i in range(6))
        raw, bounds = utf8_batch(table.column(6).cast(pa.large_binary()).combine_chunks().view(pa.large_string()))
        # position: the rank of a place in the order of documents and starts
        count = (end - start - length + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(grp)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        place, offset = bounds[owner] + step, lead[owner] - step
        order = np.lexsort((start[owner] + step, text[owner], key[owner]))
        sort = [x[owner][order] + (step[order] if x is start else 0) for x in (key, text, start)]
        fresh = np.r_[False, np.any([x[1:] != x[:-1] for x in sort], axis=0)] if len(order) else np.zeros(0, bool)
        position = np.empty(len(order), np.int64)
        position[order] = np.cumsum(fresh)
        padded = np.r_[raw, np.zeros(8, np.uint8)].astype(np.uint64)
        words = np.zeros(len(raw) + 1, np.uint64)
        for k in range(8):
            words |= padded[k : k + len(raw) + 1] << np.uint64(56 - 8 * k)
        group = np.unique(grp, return_inverse=True)[1][owner] * 512 + offset + 256
        left, run = suffix_runs(words, place, group, length)
        left = np.sort(left[has_previous_factor(position[left], run)])
        who, first = owner[left], step[left]
        who, first, last = _merged(who, first, first + length)
        return pa.RecordBatch.from_arrays([pa.array(key[who]), pa.array(text[who]), pa.array(start[who] + first), pa.array(start[who] + last)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def compared():
            for batch in batches:
                spans = batch.filter(batch.column(6).is_null())
                if spans.num_rows:
                    known.append(pa.RecordBatch.from_arrays(spans.columns[1:5], names=names))
                yield batch.filter(batch.column(6).is_valid())

        held, size = [], 0
        for group in row_groups(compared(), 1):
            yield from known
            known.clear()
            if group.num_rows < 2:
                continue
            held.append(group)
            size += group.nbytes
            if size > CHUNK_BYTES:
                yield solve(pa.concat_tables(held))
                held, size = [], 0
        yield from known
        if held:
            yield solve(pa.concat_tables(held))

    parts = shuffle_parts(stretches.sparkSession)
    return stretches.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(lean(run), "key long, text long, start long, end long")


def _cut(joined: DataFrame, schema: str, made) -> DataFrame:
    """Applies ``made`` to (row, text bytes, spans) of every document. joined: key, own, doc, gone (array of start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column(3)
            flat, offsets = gone.flatten(), np.diff(gone.offsets.to_numpy())
            count = np.where(gone.is_valid().to_numpy(zero_copy_only=False), offsets, 0)
            ends = np.cumsum(count)
            starts, stops = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            raw, bounds = utf8_batch(batch.column(2).field(0))
            rows = []
            for i in range(batch.num_rows):
                part = slice(ends[i] - count[i], ends[i])
                start, end = starts[part], stops[part]
                order = np.argsort(start, kind="stable")
                _, start, end = _merged(np.zeros(len(order), np.int64), start[order], end[order])
                rows.append((i, raw[bounds[i] : bounds[i + 1]].tobytes(), start.tolist(), end.tolist()))
            yield made(batch, rows)

    return joined.mapInArrow(lean(run), schema)


def kept_bytes(data: bytes, start: list[int], end: list[int]) -> bytes:
    edges = [0, *(x for pair in zip(start, end) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, more: tuple[str, ...] = ()) -> DataFrame:
    """key, own, doc, gone of every row of docs (doc_id, text): doc has text and the further columns asked for.

    ``gone`` are spans (start, end) to remove. The texts are shuffled by document once: both joins take all of
    ``doc``, so they read one exchange.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    text = F.coalesce("text", F.lit(""))
    # further columns stay inside ``doc``, so that their names clash with none of these
    keyed = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.shiftrightunsigned(F.xxhash64(text), 32).alias("own"), F.struct(text.alias("text"), *more).alias("doc"))
    decided = Scratch(spark).write(_decided(_recorded(keyed.select("key", "own", "doc.text"), length, gram, 4 * parts), length, GROUP_RECORDS), "decided")
    placed = keyed.repartition(parts, "key", "own")

    def lists(spans: DataFrame, name: str, *fields: str) -> DataFrame:
        return spans.groupBy(F.col("key").alias("_key"), F.col("text").alias("_own")).agg(F.collect_list(F.struct(*fields)).alias(name)).hint("shuffle_hash")

    same = (F.col("key") == F.col("_key")) & (F.col("own") == F.col("_own"))
    wanted = lists(decided.filter("grp is not null"), "wanted", "start", "end", "grp", "lead", "hot")
    texts = placed.join(wanted, same).select("key", "own", "doc", "wanted")
    later = _repeats(_fetched(texts, length), length)
    spans = decided.filter("grp is null").select("key", "text", "start", "end").union(later)
    return placed.join(lists(spans, "gone", "start", "end"), same, "left").select("key", "own", "doc", "gone")


def _ids(batch: pa.RecordBatch, rows: list[tuple]) -> pa.Array:
    key = batch.column(0).to_numpy()[[r[0] for r in rows]]
    return pa.array(key, mask=key == LAST)


def removal_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        columns = (
            pa.array([len(d) for _, d, _, _ in rows], pa.int64()),
            pa.array([sum(e) - sum(s) for _, _, s, e in rows], pa.int64()),
            pa.array([len(s) for _, _, s, _ in rows], pa.int64()),
            pa.array([hashlib.sha256(kept_bytes(d, s, e)).hexdigest() for _, d, s, e in rows], pa.string()),
        )
        return pa.RecordBatch.from_arrays([_ids(batch, rows), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cut(with_spans(docs, length, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", made)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated passages taken out of their texts, all other columns as they are.

    Bytes of a character cut in two are dropped.
    """
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields])

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows], pa.int64())
        columns = {c: batch.column(2).field(c).take(at) for c in more}
        columns["doc_id"] = _ids(batch, rows)
        columns["text"] = pa.array([kept_bytes(d, s, e).decode(errors="ignore") for _, d, s, e in rows], pa.string())
        return pa.RecordBatch.from_arrays([columns[c] for c in docs_columns], names=docs_columns)

    docs_columns = docs.columns
    return _cut(with_spans(docs, length, gram, more), schema, made)
