import math
import zlib

import numpy as np
import pyarrow as pa

from roadloom.llm import language_id as L
from tests.llm.cases import documents, frame


def test_codewords():
    for n in (1, 2, 3, 4, 5, 6, 12, 40):
        code = L.codewords(n)
        assert len(code) == n and set(np.unique(code)) <= {-1.0, 1.0}
        assert len(np.unique(code, axis=0)) == n
    code = L.codewords(4)
    assert code.shape == (4, 7)
    assert min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i]) == 4


def test_held_out_accuracy(spark):
    rows = documents()
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.learn_and_identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]].held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in got.values())
    checked = [r for r in rows if got[r["doc_id"]].held_out]
    assert sum(got[r["doc_id"]].lang_pred == r["lang"] for r in checked) >= 0.97 * len(checked)


def test_odd_rows(spark):
    got = {r.doc_id: r for r in L.learn_and_identify(frame(spark, more=True)).collect()}
    for doc in (2, 3, 4):
        assert (got[doc].lang_pred, got[doc].score) == (L.UNKNOWN, 0.0)
    assert got[5].lang_pred == "en"
    assert got[None].held_out is False
    assert L.learn_and_identify(frame(spark, [])).collect() == []
    nothing = L.learn_and_identify(frame(spark, [(1, "some text", None, None, None)])).collect()
    assert nothing[0].lang_pred == L.UNKNOWN
    one = [(i, "words of one language", "en", None, None) for i in range(20)]
    assert {r.lang_pred for r in L.learn_and_identify(frame(spark, one)).collect()} == {"en"}


def test_number_signs_are_no_letters(spark):
    texts = {1: "½ ² ①", 2: "½ a", 3: "12 34", 4: "日", 5: "Ⅷ", 6: "ª"}
    rows = [(i, t, None, None, None) for i, t in texts.items()] + [(100 + i, "words of one language", "en", None, None) for i in range(20)]
    got = {r.doc_id: r.lang_pred for r in L.learn_and_identify(frame(spark, rows)).collect()}
    assert {i for i in texts if got[i] == L.UNKNOWN} == {1, 3, 5}


def test_decoding_equals_a_plain_one(spark):
    """Bit classifiers, their trust and the loss-weighted decoding, one text and n-gram at a time."""
    rows = [r for r in documents("0.001") if r["text"]]
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    model = L.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in learnt], "doc_id long, text string, lang string"))

    def grams(text):
        data = [c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()]
        for a, b, c in zip(data, data[1:], data[2:]):
            if (a, b) != (32, 32):
                yield ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17
                yield ((a << 8 | b) * 2246822519 % 2**32) >> 17

    for r in rows:
        found, losses = list(grams(r["text"])), []
        for word in model.code:
            loss = 0.0
            for b, side in enumerate(word):
                margin = sum(float(model.weights[b][g]) for g in found) / max(1, len(found))
                loss += model.trust[b] * math.log1p(math.exp(-side * margin * model.scale[b]))
            losses.append(loss)
        share = [math.exp(min(losses) - x) for x in losses]
        names, score = model.predict(pa.array([r["text"]]))
        if any(c.isalpha() for c in r["text"]):
            assert names == [model.languages[losses.index(min(losses))]]
            assert abs(score[0] - max(share) / sum(share)) < 1e-5


def test_ambiguous_texts_are_flagged():
    model = L.Model(["a", "b"], L.codewords(2), np.zeros((1, L.DIMENSIONS), np.float32), np.ones(1), np.ones(1))
    names, score = model.predict(pa.array(["word", "1 2"]))
    assert names[1] == L.UNKNOWN and score[0] < L.LEAST_SCORE
