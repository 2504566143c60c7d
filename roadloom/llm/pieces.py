"""SentencePiece encoding that keeps every piece's place in the original bytes, and decoding.

Normalisation walks the compiled character map of the model (a double-array trie over UTF-8 bytes) for the
longest prefix at each place and records, for each normalised byte, where its source begins; pieces of the
normalised text are projected to original byte spans through that record.

Which pieces stand for a normalised text is the library's own answer (its merges are the contract); that they
fill the text from end to end is what projects them.

Defined cases: a null text is an empty one; repeated rows are encoded each; an empty table gives no rows;
further columns of the input are ignored; there are no ties; a long text is encoded whole, as its merges may
reach anywhere.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"


class CharacterMap:
    """The compiled character map: a little-endian size, that many bytes of double array, then the replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]
        #: Bytes that a known prefix can begin with.
        self.begins = np.array([self._begins(b) for b in range(256)])

    def _begins(self, byte: int) -> bool:
        if not self.units:
            return False
        node = (self.units[0] >> 10) << ((self.units[0] & 512) >> 6) ^ byte
        return node < len(self.units) and self.units[node] & 0x800000FF == byte

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at a place, and how many bytes it stands for."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = value, i + 1 - at
        if found is None:
            return None
        start = found[0]
        return self.replacements[start : self.replacements.index(b"\0", start)], found[1]


class Pieces:
    """One loaded model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.names = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]
        self.byte = {i: int(n[3:5], 16) for i, (n, k) in enumerate(zip(self.names, kinds)) if k == 6}
        self.widths = np.array([1 if k == 6 else len(n.encode()) for n, k in zip(self.names, kinds)], np.int64)
        self.is_byte = np.array([k == 6 for k in kinds])
        self.hidden = {i for i, k in enumerate(kinds) if k == 3}
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), -1)
        self.shown, self.decimal = [n.replace(MARK, " ") for n in self.names], [str(i) for i in range(len(self.names))]
        self.special = {*self.byte, *self.hidden, self.unknown}

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the original byte where its source begins.

        The map is walked only at characters that a known prefix can begin with; the stretches between stay as
        they are, with marks for spaces.
        """
        raw = text.encode()
        if self.squeeze:
            return self.walked(raw)
        data = np.frombuffer(raw, np.uint8)
        heads = (data & 0xC0) != 0x80
        origin = np.maximum.accumulate(np.where(heads, np.arange(len(data)), 0))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        done = 0

        def unchanged(end: int) -> None:
            own = data[done:end]
            times = np.where(own == 32, 3, 1)
            out, first = np.repeat(own, times), (np.cumsum(times) - times)[own == 32]
            for k, byte in enumerate(MARK.encode()):
                out[first + k] = byte
            parts.append((out, np.repeat(origin[done:end], times)))

        if self.prefix and raw:
            parts.append((np.frombuffer(MARK.encode(), np.uint8), np.zeros(3, np.int64)))
        for at in np.flatnonzero(self.map.begins[data] & heads).tolist():
            known = self.map.longest(raw, at) if at >= done else None
            if known is not None:
                unchanged(at)
                new = np.frombuffer(known[0].replace(b" ", MARK.encode()), np.uint8)
                parts.append((new, np.full(len(new), at)))
                done = at + known[1]
        unchanged(len(data))
        return np.concatenate([p for p, _ in parts]).tobytes(), np.r_[np.concatenate([s for _, s in parts]), len(raw)].astype(np.int64)

    def walked(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The same, prefix by prefix, with superfluous spaces removed if the model says so."""
        out, source = bytearray(), []
        space, at = MARK.encode(), 0
        chunks: list[tuple[bytes, int, int]] = []
        while at < len(raw):
            known = self.map.longest(raw, at)
            if known is None:
                width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                known = raw[at : at + width], width
            chunks.append((known[0], at, known[1]))
            at += known[1]
        if self.squeeze:
            while chunks and chunks[0][0] == b" ":
                chunks.pop(0)
            while chunks and chunks[-1][0] == b" ":
                chunks.pop()
        if self.prefix and chunks:
            out += space
            source += [chunks[0][1]] * len(space)
        blank = False
        for new, start, _ in chunks:
            if self.squeeze and blank and new.startswith(b" "):
                new = new.lstrip(b" ")
            escaped = new.replace(b" ", space)
            out += escaped
            source += [start] * len(escaped)
            if new:
                blank = new.endswith(b" ")
        source.append(chunks[-1][1] + chunks[-1][2] if chunks else len(raw))
        return bytes(out), np.array(source, np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """ids, first byte and end of every piece in the UTF-8 bytes of the text."""
        ids = self.model.encode(text, num_threads=1)
        begin, end = self.spans(text, ids)
        return ids, begin.tolist(), end.tolist()

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end in the UTF-8 bytes of the text, of every piece the model made of it."""
        normal, source = self.normalise(text)
        number = np.array(ids, np.int64)
        stop = np.cumsum(self.widths[number]) if self.unknown not in ids else self._stops(normal, ids)
        end, begin = source[stop], source[np.r_[0, stop[:-1]].astype(np.int64)] if len(ids) else source[:0]
        # a character of several bytes is one source: its byte pieces share the span's end
        for k in np.flatnonzero(self.is_byte[number] & (end == begin))[::-1].tolist():
            end[k] = end[k + 1] if k + 1 < len(ids) and begin[k + 1] == begin[k] else source[-1]
        return begin, end

    def _stops(self, normal: bytes, ids: list[int]) -> np.ndarray:
        """Ends of the pieces in the normalised text; an unknown piece reaches to where the next known piece fits."""
        out, at = [], 0
        for position, i in enumerate(ids):
            if i == self.unknown:
                following = next((self.names[j].encode() for j in ids[position + 1 :] if j != self.unknown), None)
                stop = len(normal) if following is None else normal.find(following, at + 1)
                at = stop if stop > 0 else len(normal)
            else:
                at += int(self.widths[i])
            out.append(at)
        return np.array(out, np.int64)

    def plain(self, ids: list[int]) -> str:
        """The text of the pieces with word marks as spaces; bytes that form no character become U+FFFD each."""
        out, held = [], bytearray()

        def release() -> None:
            at = 0
            while at < len(held):
                lead = held[at]
                width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
                try:
                    out.append(held[at : at + width].decode() if width and at + width <= len(held) else "�")
                    at += width if width and at + width <= len(held) else 1
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            release()
            if i not in self.hidden:
                out.append(" ⁇ " if i == self.unknown else self.names[i].replace(MARK, " "))
        release()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.plain(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int, int]]:
        """Number of ids, SHA-256 of the joined ids and of the decoded text, CRC-32 of the pieces' first bytes and of their ends.

        Places are little-endian 64-bit numbers of original bytes.
        """
        out = []
        for text, ids in zip(texts, self.model.encode(texts, num_threads=1)):
            begins, ends = self.spans(text, ids)
            plain = "".join(map(self.shown.__getitem__, ids)) if self.special.isdisjoint(ids) else self.plain(ids)
            back = plain[1:] if self.prefix and plain.startswith(" ") else plain
            joined = ",".join(map(self.decimal.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), zlib.crc32(begins.tobytes()), zlib.crc32(ends.tobytes())))
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One instance for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_spans(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, begins, ends: every piece of docs (doc_id, text) with its span of original bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(model).encode
        for batch in batches:
            made = [encode(x.as_py() or "") for x in batch.column(1)]
            columns = [pa.array([m[k] for m in made], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "ids", "begins", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces(model).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, begins_crc32, ends_crc32 of docs (doc_id, text).

    Encoded, projected, decoded and hashed where the text is: lists of ids would be larger than the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = pieces(model).digests
        for batch in batches:
            made = digests([x or "" for x in batch.column(1).to_pylist()])
            columns = [pa.array([m[k] for m in made], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "begins_crc32", "ends_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, begins_crc32 long, ends_crc32 long")
