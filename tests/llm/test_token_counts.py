import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadloom.llm import token_counts as T
from roadloom.llm.common import utf8_batch
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counted(texts):
    return T.byte_counts(PATH).count(*utf8_batch(pa.array(texts, pa.string()))).tolist()


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_librarys(spark, library):
    docs = frame(spark, more=True).select("doc_id", "text").union(spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents()], "doc_id long, text string"))
    rows = docs.collect()
    want = [(r.doc_id, len((r.text or "").encode()), n, n > 40) for r, n in zip(rows, wanted(library, [r.text for r in rows]))]
    assert sorted(map(tuple, T.count_tokens(docs, PATH, 40).collect()), key=str) == sorted(want, key=str)


def test_odd_rows_and_empty_tables(spark):
    got = {r.doc_id: r for r in T.count_tokens(frame(spark, more=True), PATH, 512).collect()}
    assert (got[2].n_bytes, got[2].n_tokens, got[2].over_limit) == (0, 0, False) and got[3].n_tokens == 0
    assert T.count_tokens(frame(spark, more=True), PATH, 512).filter("doc_id = 7").count() == 2
    assert T.count_tokens(frame(spark, []), PATH, 512).collect() == []


def test_every_rule_of_the_pretokeniser(library):
    rng = random.Random(11)
    parts = ["a", "'s", "'", "''", "'re", "'ll", "'v", "ve", " ", "  ", "\n", "\t", " ", "　", "é", "日本", "😀", "\x00", "\x1c", "\x85", "1", "½", "²", "<|endoftext|>", "<|endo", "the", " the", "...", "՘", "Ᲊ", "aaaa", "==", "'S", "ſ", "’s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(20))) for _ in range(5000)]
    assert counted(texts) == wanted(library, texts)


def test_long_words_and_special_tokens(library):
    rng = random.Random(12)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "abcXYZ0123456789+/"
    texts = ["a" * 30_001, "ab" * 9_999, "".join(rng.choices(letters, k=30_000)), "".join(rng.choices(digits, k=30_000)), "<|endoftext|>" * 500, "x<|endoftext|>" * 3, "".join(chr(rng.randrange(32, 0x3000)) for _ in range(9_000))]
    assert counted(texts) == wanted(library, texts)


def test_small_arrays_and_memo(library, monkeypatch):
    monkeypatch.setattr(T, "ARRAY_CHARS", 50)
    monkeypatch.setattr(T, "MEMO_ENTRIES", 20)
    counts, texts = T.ByteCounts(PATH), [r["text"] for r in documents()[:100]]
    assert counts.count(*utf8_batch(pa.array(texts))).tolist() == wanted(library, texts)


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        T.ByteCounts(public_tokenizers.path("word_bpe_49k.json"))
