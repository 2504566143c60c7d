import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from roadloom.llm import packing as P
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, limit=P.LIMIT):
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at : at + limit]
            want[doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), -(-sum(r.length for r in got) // limit)


def test_driver_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), PATH).collect()
    used, least = check(rows, got)
    assert used == least


def test_odd_rows(spark):
    docs = frame(spark, more=True)
    check([(r.doc_id, r.text) for r in docs.collect()], P.pack_documents(docs, PATH).collect())
    got = P.pack_documents(docs, PATH, limit=16).collect()
    used, least = check([(r.doc_id, r.text) for r in docs.collect()], got, 16)
    assert used <= least + 1
    assert P.pack_documents(frame(spark, []), PATH).collect() == []


def test_plans_hold_every_piece():
    rng = np.random.default_rng(3)
    for limit in (4, 10, 64, 300):
        for _ in range(20):
            counts = rng.integers(0, 40, limit + 1) * (rng.random(limit + 1) < 0.4)
            counts[0] = 0
            runs = P.plan_runs(counts)
            ranks, fill = defaultdict(list), defaultdict(list)
            for length, first, n, sequence, offset in runs.tolist():
                ranks[length] += range(first, first + n)
                for k in range(n):
                    fill[sequence + k].append((offset, length))
            assert {k: sorted(v) for k, v in ranks.items()} == {n: list(range(c)) for n, c in enumerate(counts.tolist()) if c}
            for parts in fill.values():
                at = 0
                for offset, length in sorted(parts):
                    assert offset == at
                    at += length
                assert at <= limit
