import functools
import hashlib
import random

from roadloom.llm import fingerprints as P
from tests.llm.cases import documents, frame


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""), reverse=True)
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (slow_print(x.encode()) for x in (text, edited, following))
        shown = lambda x: "".join(f"{v:016x}" for v in sorted(x))
        yield doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), round(slow_likeness(a, b), 9), round(slow_likeness(a, c), 9)


def compare(docs):
    got = [(*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in P.fingerprint_edits(docs).collect()]
    assert sorted(got, key=str) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=str)


def test_driver_documents(spark):
    compare(spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents("0.001")], "doc_id long, text string").repartition(3))


def test_odd_rows(spark):
    compare(frame(spark, more=True))
    compare(frame(spark, [(4, "only one", None, None, None)]))
    compare(frame(spark, []))


ALL = (1 << 64) - 1


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & ALL
    return x ^ x >> 31


GEAR = [mixed((k + 1) * 0x9E3779B97F4A7C15 + 7 & ALL) | 1 for k in range(256)]


@functools.lru_cache(maxsize=None)
def slow_print(data: bytes) -> frozenset:
    """Chunk digests above chunk lengths, byte by byte."""
    found, at = set(), 0
    for cut in slow_cuts(data):
        total, power = cut - at, 1
        for c in data[at:cut]:
            total, power = total + GEAR[c] * power & ALL, power * 0x9E3779B97F4A7C15 & ALL
        found.add(mixed(total) >> 12 << 12 | cut - at)
        at = cut
    return frozenset(found)


def slow_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    size = lambda x: sum(v & 0xFFF for v in x)
    return size(a & b) / min(size(a), size(b))


def slow_cuts(data: bytes):
    cuts, at = [], 0
    h, now = [], 0
    for c in data:
        now = (now << 1) + (GEAR[c] >> 17 & 0xFFFFFFFF) & 0xFFFFFFFF
        h.append(now)
    while at < len(data):
        cut = min(len(data), at + P.MOST)
        for i in range(at + P.LEAST - 1, cut):
            if not h[i] & int(P._HARD if i < at + P.USUAL else P._EASY):
                cut = i + 1
                break
        cuts.append(cut if len(data) - at > P.LEAST else len(data))
        at = cuts[-1]
    return cuts


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(7)
    data = bytes(rng.choice(b"abcdefgh ") for _ in range(40000))
    want = P.chunks(data)
    monkeypatch.setattr(P, "BLOCK", 1000)
    got = P.chunks(data)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_chunks():
    rng = random.Random(2)
    for n in (1, 31, 32, 33, 200, 5000):
        data = bytes(rng.choice(b"abcdefgh ") for _ in range(n))
        assert P.chunks(data)[0].tolist()[1:] == slow_cuts(data)
    text = bytes(rng.randrange(256) for _ in range(20000))
    assert P.likeness(P.fingerprint(text), P.fingerprint(b"some new words" + text)) > 0.95
    assert P.likeness(P.fingerprint(text), P.fingerprint(text[:5000])) > 0.9
    assert P.likeness(P.fingerprint(text), P.fingerprint(text)) == 1.0
