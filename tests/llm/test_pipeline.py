import corpus_pipeline as C
from roadloom.llm import language_id, pii
from roadloom.llm.entry import PSEUDONYM_KEY, tokenizer
from tests.llm.cases import SCHEMA, frame
from tests.llm.test_jaccard_join import shingles
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def without_repeats(rows, length=100):
    seen, out = {}, []
    for doc, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if seen.setdefault(data[s : s + length], (doc, s)) < (doc, s):
                gone[s : s + length] = b"\1" * length
        out.append((doc, bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")))
    return dict(out)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in C.STAGES:
        out = stage(spark, frames[-1], SF)
        if name != "packing":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        frames.append(C.Scratch(spark).write(out, name))
    rows = [[r.asDict() for r in f.collect()] for f in frames]

    kept = {r["doc_id"] for r in rows[1]}
    found = {r.doc_id: r for r in language_id.learn_and_identify(docs).collect()}
    assert kept == {i for i, r in found.items() if r.lang_pred != language_id.UNKNOWN and r.score >= C.LEAST_SCORE}
    assert len(kept) >= 0.97 * len(rows[0])

    sets = {r["doc_id"]: shingles(r["text"], C.SHINGLE_WORDS) for r in rows[1]}
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets.items():
            for j, b in sets.items():
                if j < i and a and b and 100 * len(a & b) >= C.SIMILAR_PERCENT * len(a | b) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(i for i in sets if least[i] == i)
    before = {r["doc_id"]: r for r in rows[1]}
    assert all(r == before[r["doc_id"]] for r in rows[2])

    want = without_repeats([(r["doc_id"], r["text"]) for r in rows[2]])
    assert {r["doc_id"]: r["text"] for r in rows[3]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows[3])

    again = pii.pseudonymise(frames[3], PSEUDONYM_KEY).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows[4]) == sorted((r.doc_id, r.text) for r in again)

    used, lower = check([(r["doc_id"], r["text"]) for r in rows[4]], frames[5].collect())
    assert used <= lower + 1
    assert C.run(spark, SF).count() == len(rows[5])


def test_odd_rows(spark):
    for docs in (frame(spark), spark.createDataFrame([], SCHEMA)):
        for _, stage in C.STAGES:
            docs = C.Scratch(spark).write(stage(spark, docs, SF), "t")
        docs.collect()


def test_near_duplicates_keep_one_of_each(spark):
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(5, text, "en", "a", 1), (3, text + "eleven", "en", "a", 1), (9, "other words stand here and only here now", "en", "a", 1), (9, "other  words stand here and only here now", "en", "a", 1), (9, "the same number with a different text altogether", "en", "a", 1), (None, text, "en", "a", 1), (None, "no number and no likeness to any other one", "en", "a", 1), (7, None, None, None, None)]
    got = C.drop_near_duplicates(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 99) for r in got) == [3, 7, 9, 9, 99]
    assert [r.text for r in got if r.doc_id is None] == [rows[6][1]]
