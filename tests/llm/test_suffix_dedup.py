import hashlib
import random

import numpy as np
import pyarrow as pa

from roadloom.llm import suffix_dedup as S
from tests.llm.cases import documents, frame


def brute(rows, length=100):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: S.LAST if rows[i][0] is None else rows[i][0])
    for i in order:
        doc, text = rows[i]
        data = (text or "").encode()
        key = S.LAST if doc is None else doc
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            first = seen.setdefault(data[s : s + length], (key, s))
            if first < (key, s):
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc, len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def compare(docs, **options):
    got = [tuple(r) for r in S.removal_digests(docs, **options).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], options.get("length", 100))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def planted(n, seed):
    rng = random.Random(seed)
    letters = "abcde é"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice((60, 95, 99, 100, 101, 130, 400)))) for _ in range(8)]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            text = rng.choice(passages)
            if rng.random() < 0.3:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(("", "x")) + text[k + 1 :]
            parts += [text, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))]
        yield i * 3 - 50, "".join(parts)


def test_driver_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents()]
    got = compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(r[2] for r in got) > 0


def test_planted(spark, monkeypatch):
    docs = spark.createDataFrame(list(planted(300, 1)), "doc_id long, text string").repartition(5)
    compare(docs)
    compare(docs, length=40, gram=12)
    monkeypatch.setattr(S, "GROUP_RECORDS", 2)  # nearly every k-gram is dealt out by strings
    compare(docs)


def test_odd_rows(spark):
    compare(frame(spark, more=True))
    assert S.removal_digests(frame(spark, [])).collect() == []
    runs = [(1, "ab" * 300), (2, "b" * 250), (3, "=" * 99), (4, "=" * 100), (5, "=" * 101), (6, "x" + "=" * 150 + "y")]
    compare(spark.createDataFrame(runs, "doc_id long, text string"))


def test_one_id_with_several_texts(spark):
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a + b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in S.removal_digests(docs).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 600)]


def test_long_text_in_blocks(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abc ") for _ in range(5000))
    column, before = pa.array([text, "short " * 30]), S.BLOCK
    try:
        S.BLOCK = 700
        parts = list(S.blocks(column, 100))
    finally:
        S.BLOCK = before
    assert [p[0] for p in parts] == [0] * 8 + [1]
    places = [at + i for n, at, raw, _ in parts if n == 0 for i in range(len(raw) - 99)]
    assert places == list(range(4901))
    assert all(bytes(raw) == text[at : at + len(raw)].encode() for n, at, raw, _ in parts if n == 0)


def test_long_text(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    filler = "".join(rng.choice("abcdefgh ") for _ in range(2 * S.BLOCK + 5000))
    text = filler[: S.BLOCK - 150] + passage + filler[S.BLOCK :] + passage
    got = {r.doc_id: r for r in S.removal_digests(spark.createDataFrame([(1, text), (2, "x" + passage)], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (300, 1, 300)


def test_rows_without_ids(spark):
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in S.removal_digests(spark.createDataFrame([(None, a), (None, a), (None, b + a), (5, b)], "doc_id long, text string")).collect())
    assert got[0] == (False, 200, 0)
    assert sorted(x[2] for x in got[1:]) in ([0, 0, 400], [200, 200, 200])


def test_texts_without_repeats(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh é") for _ in range(400))
    docs = frame(spark, [(1, text, "en", "a", 5), (2, f"before {text} after", "fr", None, None), (3, None, None, "b", 1)], more=True)
    got = S.without_repeats(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars, r.key) for r in got.collect()} == {1: (text, "en", "a", 5, "x"), 2: ("before  after", "fr", None, None, "x"), 3: ("", None, "b", 1, "x")}
