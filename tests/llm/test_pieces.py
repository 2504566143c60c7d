import hashlib
import random
import struct
import zlib

import public_tokenizers
from sentencepiece import SentencePieceProcessor

from roadloom.llm import pieces as P
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_digests_are_the_librarys(spark):
    library = SentencePieceProcessor(model_file=PATH)
    docs = frame(spark, more=True).select("doc_id", "text").union(spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents()[:300]], "doc_id long, text string"))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))))
    assert sorted(want, key=str) == sorted((tuple(r[:4]) for r in P.encoded_digests(docs, PATH).collect()), key=str)
    assert P.encoded_digests(frame(spark, []), PATH).collect() == []


def test_spans_and_decoding(spark):
    model, rng = P.pieces(PATH), random.Random(5)
    parts = ["a", " ", "  ", "\n", "é", "日", "😀", "\x01", "<s>", "the", " the", "ﬁ", "é", "▁"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids, begins, ends = model.encode(text)
        assert model.decode(ids) == model.model.decode(ids)
        raw = text.encode()
        assert not ids or ends[-1] == len(raw)
        assert all(b <= e for b, e in zip(begins, ends))
        for i, b, e in zip(ids, begins, ends):
            if i not in model.byte and "▁" not in text:
                assert raw[b:e].decode().lstrip(" ") == model.names[i].replace("▁", " ").lstrip(" ")
    docs = frame(spark)
    encoded = P.encode_spans(docs, PATH)
    back = {r.doc_id: r.text for r in P.decode_ids(encoded, PATH).collect()}
    assert back[1] == docs.filter("doc_id = 1").first().text and back[2] == ""


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A compiled character map for a test: a double array with one block of 256 units for each node."""
    nodes: dict[bytes, int] = {b"": 0}
    for key in rules:
        for n in range(1, len(key) + 1):
            nodes.setdefault(key[:n], len(nodes))
    texts, at = b"", {}
    for key, value in rules.items():
        at[key] = len(texts)
        texts += value + b"\0"
    # children of node k stand in block k + 1, each unit at (k + 1) * 512 ^ byte, the value at (k + 1) * 512
    units = [0xFF] * (512 * (len(nodes) + 2))
    place = {b"": 0}
    base = {name: 512 * (k + 1) for name, k in nodes.items()}

    def pointing(position: int, name: bytes) -> int:
        offset = position ^ base[name]
        return (offset << 10) if offset < 1 << 21 else ((offset >> 8) << 10) | 512

    units[0] = pointing(0, b"")
    for name in nodes:
        if name:
            place[name] = base[name[:-1]] ^ name[-1]
    for name in nodes:
        if name:
            units[place[name]] = name[-1] | pointing(place[name], name) | (256 if name in rules else 0)
        if name in rules:
            units[base[name]] = at[name] | 1 << 31
    data = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(data)) + data + texts


def test_character_map_takes_the_longest_prefix():
    rules = {"ﬁ".encode(): b"fi", b"e": b"E", "é".encode(): "é".encode(), b"\t": b" ", "​".encode(): b""}
    found = P.CharacterMap(compiled(rules))
    assert found.longest("ﬁx".encode(), 0) == (b"fi", 3)
    assert found.longest("é".encode(), 0) == ("é".encode(), 3)
    assert found.longest(b"ex", 0) == (b"E", 1)
    assert found.longest(b"zz", 0) is None
    model = P.Pieces(PATH)
    model.map, model.prefix, model.squeeze = found, True, True
    normal, source = model.normalise("  ﬁ ​  é\t")
    assert normal.decode() == "▁fi▁é"
    assert source.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 11, 11, 14]


def test_spans_of_the_query_equal_a_plain_walk(spark):
    """First bytes and ends of every piece, from the prefix-by-prefix walk and one piece after another."""
    model, rows = P.pieces(PATH), documents("0.001")[:60]
    docs = frame(spark).select("doc_id", "text").union(spark.createDataFrame([(r["doc_id"] + 1000, r["text"]) for r in rows], "doc_id long, text string"))

    def crc(values):
        return zlib.crc32(b"".join(struct.pack("<q", v) for v in values))

    want = {}
    for r in docs.collect():
        raw, at, begins, ends = (r.text or "").encode(), 0, [], []
        ids = model.model.encode(r.text or "")
        normal, source = model.walked(raw)
        assert (normal, source.tolist()) == (model.normalise(r.text or "")[0], model.normalise(r.text or "")[1].tolist())
        for i in ids:
            width = 1 if i in model.byte else len(model.names[i].encode())
            begins.append(int(source[at]))
            at += width
            # a piece that ends within a character ends with it
            ends.append(int(source[at]) if i not in model.byte or source[at] != begins[-1] else next(int(x) for x in source[at:] if x != begins[-1]))
        assert at == len(normal)
        want[r.doc_id, len(ids)] = (crc(begins), crc(ends))
    assert want == {(r.doc_id, r.n_tokens): (r.begins_crc32, r.ends_crc32) for r in P.encoded_digests(docs, PATH).collect()}
