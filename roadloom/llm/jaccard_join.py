"""Documents linked by the Jaccard similarity of their word shingles, by PartEnum signatures.

Sizes fall into bands such that similar sets are in one band or in neighbours. Similar sets of such a pair of
bands differ in at most ``k`` elements. The element domain is cut into parts, each of them into subparts: in
some part the sets differ in few elements, so they agree on all but as many of its subparts, and every such
choice of subparts is a signature. Sets that are similar enough thus share a signature.

Nodes are distinct sets, so copies meet once. No group of sets is turned into pairs: within a group a search
from set to set crosses out what it reaches, first over parity sketches, whose distance never exceeds the
sets' distance, then over the sets themselves. What leaves a group is a star for each of its parts. Groups
above a size are dealt out as pairs of blocks, so that none has to fit into one task.

Shingles and sets are told apart by 64-bit hashes.

Defined cases: a null text or one without words has an empty set and is linked with nothing; fewer words than
a shingle are one element together; repeated rows are rows of the same set; a null doc_id stands above all
others, so a component of null ids alone has a null component_id; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, byte_table, components, free_name, lean, mix64, row_groups, shuffle_parts, small_side, utf8_batch

WORDS, PERCENT = 3, 90
#: Subparts of a part, and how many of them similar sets may disagree on: the first cut whose signatures hold
#: USUAL_ELEMENTS elements on average, else the last.
CUTS = ((3, 1), (5, 2))
USUAL_ELEMENTS, LEAST_ELEMENTS = 5, 2
BLOCK = 1 << 18
GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20
SALTS = 16
FLUSH = 250_000
_FACTOR = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BYTES = byte_table(11)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a factor and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _FACTOR), ("down", pow(_FACTOR, -1, 1 << 64))):
            out = np.ones(max(n, BLOCK), np.uint64)
            have = 1
            while have < len(out):
                more = min(have, len(out) - have)
                out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte of each word, with A-Z as a-z."""
    lower = _LOWER[raw]
    inside = np.r_[False, ~_BLANK[lower], False]
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[lower] * up[: len(raw)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, bounds = utf8_batch(column)
    first, n = 0, len(bounds) - 1
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(words)]
    while first < n:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        base = bounds[first]
        for k, (a, b) in enumerate(zip(bounds[first:end], bounds[first + 1 : end + 1])):
            if k == 0:
                # a blank between texts keeps their words apart
                part = raw[base : bounds[end]]
                gaps = np.insert(part, (bounds[first + 1 : end] - base), 32) if end - first > 1 else part
                hashed, start = word_hashes(gaps)
                edges = np.searchsorted(start, bounds[first : end + 1] - base + np.arange(end - first + 1))
            own = hashed[edges[k] : edges[k + 1]]
            if len(own) >= words:
                mixed = sum(own[i : len(own) - words + 1 + i] * factors[i] for i in range(words))
            elif len(own):
                mixed = np.array([sum(int(x) * int(f) for x, f in zip(own, factors)) + 77 * len(own) & (1 << 64) - 1], np.uint64)
            else:
                mixed = np.zeros(0, np.uint64)
            yield np.unique(mix64(mixed))
        first = end


class Bands:
    """Bands of sizes: sets of the wanted similarity are in one band or in two that follow each other."""

    def __init__(self, percent: int):
        self.percent, self.tops = percent, [0]

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append((self.tops[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.tops, n))

    def differing(self, n: int, m: int) -> int:
        """Elements in which similar sets of these sizes differ at most."""
        return (n + m) * (100 - self.percent) // (100 + self.percent)

    def most(self, band: int) -> int:
        self.band(self.tops[-1] + 1) if band >= len(self.tops) else None
        while band >= len(self.tops):
            self.band(self.tops[-1] + 1)
        return self.differing(self.tops[band], self.tops[band])

    def sketch_bits(self, band: int) -> int:
        return 1 << max(8, (4 * self.most(band)).bit_length())


def _light(mean: float) -> float:
    """Share of signatures with less than LEAST_ELEMENTS elements, if elements fall at random."""
    return math.exp(-mean) * (1 + mean)


@lru_cache(maxsize=4096)
def layout(most: int, top: int) -> tuple[int, int, int]:
    """Parts, subparts of each and how many of those may differ, for sets of up to ``top`` elements that differ in at most ``most``.

    The coarser cut, if its signatures still hold enough elements to tell sets apart. Some parts are to spare, so
    that light signatures can be left out (see ``signatures``).
    """
    for inner, spare in CUTS:
        spare = min(spare, most)
        parts = -(-(most + 1) // (spare + 1))
        mean = (inner - spare) * top / (parts * inner)
        if mean >= USUAL_ELEMENTS:
            break
    light = parts * math.comb(inner, spare) * _light(mean)
    return parts + (math.ceil(light + 2 * math.sqrt(light)) if parts > 2 else 0), inner, spare


def signatures(elements: np.ndarray, band: int, most: int, top: int, cut: tuple[int, int, int] | None = None) -> np.ndarray:
    """Signatures of a sorted set for pairs of sets of sizes up to ``top`` that differ in at most ``most`` elements.

    Similar sets differ in at most ``spare`` elements in all parts but ``most // (spare + 1)``, and in such a part
    they agree on one choice of ``inner - spare`` subparts. Choices with less than LEAST_ELEMENTS elements are
    common to many sets that are not similar. They are left out where the parts that have one are fewer than the
    parts in which a similar set must agree: one of the latter then has no light choice, and what the sets agree
    on there is a signature of both. A set with too many light choices signs all.
    """
    parts, inner, spare = cut or layout(most, top)
    cells = parts * inner
    # elements are hashes, so equal stretches of their range are equal parts of the domain
    edges = (np.arange(1, cells, dtype=np.float64) * (2.0**64 / cells)).astype(np.uint64)
    at = np.r_[0, np.searchsorted(elements, edges), len(elements)]
    sums = np.r_[np.uint64(0), np.cumsum(mix64(elements ^ np.uint64(0x5851F42D4C957F2D)))]
    cell, count = (sums[at[1:]] - sums[at[:-1]]).reshape(parts, inner), np.diff(at).reshape(parts, inner)
    made, heavy = [], []
    for number, chosen in enumerate(combinations(range(inner), inner - spare)):
        mixed = cell[:, chosen[0]].copy()
        for c in chosen[1:]:
            mixed = mix64(mixed) + cell[:, c]
        place = np.uint64((band * 64 + number) << 32) + np.arange(parts, dtype=np.uint64)
        made.append(mix64(mixed ^ mix64(place)))
        heavy.append(count[:, chosen].sum(1) >= LEAST_ELEMENTS)
    made, heavy = np.stack(made), np.stack(heavy)
    risky = int((~heavy.all(0)).sum())
    return made[heavy] if risky < parts - most // (spare + 1) else made.ravel()


def sketch(elements: np.ndarray, bits: int) -> np.ndarray:
    """One parity bit for each class of elements, as 64-bit words. Each element in which sets differ flips one bit at most."""
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def set_hash(elements: np.ndarray) -> int:
    return int(mix64(mix64(elements).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


def _pack(sig: np.ndarray, owner: np.ndarray, nodes: np.ndarray) -> bytes:
    """Signatures of one bucket (its number is part of them, so 32 bits more tell them apart) with their nodes."""
    import zstandard

    own = np.unique(owner)
    step = np.diff(np.searchsorted(own, owner), prepend=0).astype(np.uint8)  # 0 or 1, as owners follow each other
    return np.array([len(sig), len(own)], np.int64).tobytes() + nodes[own].tobytes() + sig.astype(np.uint32).tobytes() + zstandard.ZstdCompressor(level=1).compress(step.tobytes())


def _unpack(blobs: list[bytes]) -> np.ndarray:
    """Rows of signature and node."""
    import zstandard

    out = []
    for blob in blobs:
        n, own = np.frombuffer(blob, np.int64, 2).tolist()
        nodes = np.frombuffer(blob, np.uint64, own, 16)
        table = np.empty((n, 2), np.uint64)
        table[:, 0] = np.frombuffer(blob, np.uint32, n, 16 + 8 * own)
        step = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[16 + 8 * own + 4 * n :]), np.uint8)
        table[:, 1] = nodes[np.cumsum(step, dtype=np.int64)]
        out.append(table)
    return np.concatenate(out)


def _signed(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Rows of two kinds: doc_id, n, node, sketch of each document; signatures and nodes packed by bucket."""
    names = ["bucket", "doc_id", "n", "node", "sketch", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, held, size = Bands(percent), set(), [], 0

        def packed() -> pa.RecordBatch:
            sig = np.concatenate([s for s, _ in held])
            owner = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
            nodes = np.array([n for _, n in held], np.int64)
            bucket = (sig >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            sig, owner = sig[order], owner[order]
            there, start = np.unique(bucket[order], return_index=True)
            blobs = [_pack(sig[a:b], owner[a:b], nodes) for a, b in zip(start, [*start[1:], len(sig)])]
            none = [None] * len(there)
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(blobs, pa.binary())], names=names)

        for batch in batches:
            n, node, sketches = [], [], []
            for elements in shingle_sets(batch.column(1), words):
                own = set_hash(elements)
                n.append(len(elements))
                node.append(own if len(elements) else None)
                sketches.append(None)
                if len(elements) and own not in seen:
                    # equal sets within a task are signed once
                    seen.add(own)
                    band = bands.band(len(elements))
                    sketches[-1] = sketch(elements, bands.sketch_bits(band + 1)).tobytes()
                    sig = np.concatenate([signatures(elements, b, bands.most(b), bands.tops[b]) for b in (band, band + 1)])
                    held.append((sig, own))
                    size += len(sig)
            # the documents' rows are read as they come, so they are dealt evenly, copies of one text too
            bucket = pa.array((np.arange(len(node)) % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, batch.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketches, pa.binary()), pa.array([None] * len(n), pa.binary())], names=names)
            if size > FLUSH:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "bucket int, doc_id long, n long, node long, sketch binary, payload binary")


def _shared(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, name of its group, size of the group, for every group of nodes that share a signature."""
    # most signatures are unique: only the others are sorted with their nodes
    order = np.argsort(table[:, 0], kind="stable")
    sig = table[order, 0]
    again = np.r_[False, sig[1:] == sig[:-1]]
    table = table[order[again | np.r_[again[1:], False]]]
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    new = np.ones(len(table), bool)
    new[1:] = (table[1:] != table[:-1]).any(1)
    table = table[new]
    if not len(table):
        return (np.zeros(0, np.int64),) * 3
    start = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0]])
    size = np.diff(np.r_[start, len(table)])
    group = np.add.reduceat(mix64(table[:, 1]), start) + size.astype(np.uint64)
    pick = np.zeros(len(start), bool)
    pick[np.unique(group, return_index=True)[1]] = True
    pick &= size > 1
    rows = np.repeat(pick, size)
    return table[rows, 1].view(np.int64), np.repeat(group, size)[rows].view(np.int64), np.repeat(size, size)[rows]


def _meeting(signed: DataFrame) -> DataFrame:
    """The document rows as they are, and (grp, size, node) for each group of sets that share a signature.

    A group is named by its members, so signatures that the same sets share are one group.
    """
    names = ["doc_id", "n", "node", "sketch", "grp", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            documents = batch.filter(batch.column(5).is_null())
            if documents.num_rows:
                none = pa.array([None] * documents.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*documents.columns[1:5], none, none], names=names)
            packed = batch.filter(batch.column(5).is_valid())
            for bucket, blob in zip(packed.column(0).to_pylist(), packed.column(5).to_pylist()):
                held.setdefault(bucket, []).append(blob)
        while held:
            node, grp, size = _shared(_unpack(held.popitem()[1]))
            for at in range(0, len(node), 1 << 16):
                part = slice(at, at + (1 << 16))
                none = [None] * len(node[part])
                yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(node[part]), pa.array(none, pa.binary()), pa.array(grp[part]), pa.array(size[part])], names=names)

    parts = shuffle_parts(signed.sparkSession)
    return signed.repartition(parts, "bucket").mapInArrow(lean(run), "doc_id long, n long, node long, sketch binary, grp long, size long")


def _stars(node: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) for each set that ``near(i, others)`` reaches from another, in steps, within a group."""
    left, roots = np.arange(len(node)), np.arange(len(node))
    while len(left) > 1:
        # a search from the first set left; what it reaches is crossed out, so a group of like sets takes few steps
        todo, reached, left = [left[0]], [left[0]], left[1:]
        while todo and len(left):
            hit = near(todo.pop(), left)
            todo += left[hit].tolist()
            reached += left[hit].tolist()
            left = left[~hit]
        reached = np.array(reached)
        roots[reached] = reached[node[reached].argmin()]
    own = roots != np.arange(len(node))
    return node[own], node[roots[own]]


def _sketches(blobs: list[bytes]) -> np.ndarray:
    """Sketches of neighbouring bands at the length of the shortest."""
    words = [np.frombuffer(b, np.uint64) for b in blobs]
    least = min(map(len, words))
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, least), axis=0) for w in words])


def _blocks(frame: DataFrame, group: str, blocks) -> DataFrame:
    """Adds p and q: a group of several blocks stands once for each pair of its blocks, in all of which a row is that has its own."""
    frame = frame.withColumn("_n", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    frame = frame.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return frame.withColumn("p", F.least("_b", "_j")).withColumn("q", F.greatest("_b", "_j")).drop("_n", "_b", "_j")


def _search(rows: DataFrame, key: str, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) that connect what is similar within each group; rows: key, p, q, node, n and a sketch or a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, found = Bands(percent), []
        for group in row_groups(batches, 3):
            if group.num_rows < 2:
                continue
            node, n = (group.column(i).to_numpy() for i in (3, 4))
            blobs = group.column(5).to_pylist()
            sets = [np.frombuffer(b, np.uint64) for b in blobs] if exact else None
            if exact:
                bits = bands.sketch_bits(bands.band(int(n.max())))
                words = np.stack([sketch(s, bits) for s in sets])
            else:
                words = _sketches(blobs)

            def near(i: int, others: np.ndarray) -> np.ndarray:
                most = (n[i] + n[others]) * (100 - percent) // (100 + percent)
                hit = np.bitwise_count(words[others] ^ words[i]).sum(1) <= most
                if exact:
                    for j in np.flatnonzero(hit):
                        both = len(np.intersect1d(sets[i], sets[others[j]], assume_unique=True))
                        hit[j] = 100 * both >= percent * (n[i] + n[others[j]] - both)
                return hit

            found.append(_stars(node, near))
            if len(found) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])

    what = "elements" if exact else "sketch"
    parts = shuffle_parts(rows.sparkSession)
    dealt = rows.select(key, "p", "q", "node", "n", what).repartition(parts, key, "p", "q").sortWithinPartitions(key, "p", "q")
    return dealt.mapInArrow(lean(run), "a long, b long")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs but one document of each component: the one with the least doc_id.

    Rows with one doc_id and one set of shingles are one document; other rows with one doc_id stay or go by
    their own component. Of rows without a doc_id that are linked only with each other, each set stays.
    All columns of docs stay as they are, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    again_, gone_, set_, node_, n_ = (free_name(docs, x) for x in ("_again", "_gone", "_set", "_node", "_n"))
    linked = _linked(docs.select("doc_id", "text"), words, percent, scratch)
    gone = scratch.write(linked.filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias(gone_), F.col("node").alias(set_)).distinct(), "gone")
    scratch.drop("met", "linked")
    # identifiers that are missing or given more than once are rare: only those rows are told apart by their sets
    counted = docs.groupBy(F.col("doc_id").alias(again_)).agg(F.count("*").alias(n_))
    again = small_side(scratch.write(counted.filter((F.col(n_) > 1) | F.col(again_).isNull()).select(again_), "again"))
    plain = docs.join(again, F.col("doc_id").eqNullSafe(F.col(again_)), "left_anti").join(small_side(gone), F.col("doc_id") == F.col(gone_), "left_anti")
    twins = _with_node(docs.join(again, F.col("doc_id").eqNullSafe(F.col(again_)), "left_semi"), words, node_)
    left = twins.join(gone, F.col("doc_id").eqNullSafe(F.col(gone_)) & F.col(node_).eqNullSafe(F.col(set_)), "left_anti")
    return plain.unionByName(left.filter(F.col(node_).isNotNull()).dropDuplicates(["doc_id", node_]).unionByName(left.filter(F.col(node_).isNull())).drop(node_))


def _with_node(docs: DataFrame, words: int, name: str) -> DataFrame:
    """docs with the hash of each text's set as a column of that name, null for an empty set."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [set_hash(s) if len(s) else None for s in shingle_sets(batch.column(at), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(lean(run), docs.withColumn(name, F.lit(None).cast("long")).schema)


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    return _linked(docs, words, percent, Scratch(docs.sparkSession)).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, node, component_id of every row; of the scratch tables, ``met`` and ``linked`` are left."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    met = scratch.write(_meeting(_signed(docs, words, percent, 2 * parts)), "met")
    # very many documents may be of one node: they are dealt by node and salt, and meet one row for each of these
    documents = met.filter("n is not null").select("doc_id", "n", "node", "sketch", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    groups = met.filter("grp is not null").select("grp", "size", "node").distinct()
    pieces = documents.filter("node is not null").groupBy("node", "salt").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    classes = pieces.groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.min("least").alias("least"))
    rows = groups.join(classes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    near = scratch.write(_search(_blocks(rows, "grp", F.ceil(F.col("size") / GROUP_ROWS)), "grp", percent, exact=False), "near")
    blocks = components(near, scratch, "blocks")

    # the sets of the nodes that have a neighbour by sketch, from the texts
    wanted = small_side(scratch.write(blocks.join(classes.select(F.col("node").alias("_node"), "least", "n"), F.col("node") == F.col("_node")).select("node", "root", "least", "n"), "wanted"))
    scratch.drop("near", "blocks")
    texts = docs.select(F.col("doc_id").alias("_doc"), "text").join(wanted, F.col("_doc").eqNullSafe(F.col("least"))).select("node", "root", "n", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s.tobytes(), set_hash(s)) for s in shingle_sets(batch.column(3), words)]
            own = np.array([h for _, h in found], np.int64) == batch.column(0).to_numpy()  # one doc_id may stand with other texts
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s for s, _ in found], pa.binary())], names=["node", "root", "n", "elements"]).filter(pa.array(own))

    # a row given twice gives its set twice; such twins are near each other, and an edge to oneself is none
    whole = scratch.write(texts.mapInArrow(lean(sets), "node long, root long, n long, elements binary"), "sets")
    weights = small_side(scratch.write(whole.groupBy("root").agg(F.ceil(F.sum(8 * F.col("n") + 64) / GROUP_BYTES).alias("blocks")).withColumnRenamed("root", "_root"), "weights"))
    dealt = _blocks(whole.join(weights, F.col("root") == F.col("_root")), "root", F.col("blocks"))
    links = scratch.write(_search(dealt, "root", percent, exact=True), "links")
    scratch.drop("wanted", "sets", "weights")
    found = components(links, scratch, "linked")
    scratch.drop("links")
    linked = found.select(F.col("node").alias("_n"), "root")
    named = classes.select("node", "least").join(linked, F.col("node") == F.col("_n"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first")).withColumnRenamed("root", "_root")
    of_node = named.join(firsts, F.col("root") == F.col("_root")).select(F.col("node").alias("_n"), "first")
    # every class has its least document; those with links have the least of their component
    final = classes.select(F.col("node").alias("_node"), "least").join(of_node, F.col("_node") == F.col("_n"), "left").select("_node", F.coalesce("first", "least").alias("first"))
    dealt = pieces.select("node", F.col("salt").alias("_salt")).join(final, F.col("node") == F.col("_node")).select("_node", "_salt", "first")
    joined = documents.join(dealt, (F.col("node") == F.col("_node")) & (F.col("salt") == F.col("_salt")), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("first", "doc_id").alias("component_id"))
