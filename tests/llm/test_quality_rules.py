import re
from collections import Counter, defaultdict

from roadloom.llm import quality_rules as Q
from tests.llm.cases import documents, frame


def brute(rows, most=Q.MOST_DOCUMENTS):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lines_of = defaultdict(set)
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if word.search(x):
                lines_of[r["source"], normal(x)].add(r["doc_id"])
    often = {k for k, v in lines_of.items() if len(v) > most}
    for r in rows:
        text = r["text"] or ""
        w = word.findall(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if word.search(x)]
        gone = [len(word.findall(x)) for x in lines if (r["source"], normal(x)) in often]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        yield (r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed, not failed and sum(gone) <= 0.2 * len(w) and len(w) - sum(gone) >= 50, sum(gone))


def compare(spark, rows, docs, most=Q.MOST_DOCUMENTS):
    got = Q.quality_rules(docs, most).collect()
    order = lambda x: (x[0] is None, x)
    assert sorted(((*r[:8], r.n_removed_words) for r in got), key=order) == sorted(brute(rows, most), key=order)
    return got


def test_driver_documents(spark):
    rows = documents()
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = compare(spark, rows, docs)
    assert any(r.n_removed_lines for r in got)
    assert any(not r.base_failed and not r.kept for r in got)
    compare(spark, rows, docs, most=2)


def test_odd_rows(spark):
    docs = frame(spark, more=True)
    compare(spark, [r.asDict() for r in docs.collect()], docs)
    compare(spark, [r.asDict() for r in docs.collect()], docs, most=0)
    compare(spark, [r.asDict() for r in docs.collect()], docs, most=1)


def test_depleted(spark):
    """All pages of a host but one consist of little else than what they share, in a small host and in a larger one."""
    shared = "all of these very common words stand in every page of this host and fill most of its text " * 3
    for n in (7, 60):
        rows = [(i, f"{shared}\n" + " ".join(f"own{i}x{j}" for j in range(12 if i < n - 1 else 400)), "en", "h", 0) for i in range(n)]
        rows += [(1000 + i, "another page with words of its own " * 9 + str(i), "en", "other", 0) for i in range(5)]
        docs = frame(spark, rows)
        got = compare(spark, [r.asDict() for r in docs.collect()], docs)
        assert {r.doc_id for r in got if r.kept} == {n - 1}
        assert {r.doc_id for r in got if r.n_removed_lines} == set(range(n))


def test_copies(spark):
    """A row given often is one document; copies under ids of their own are several."""
    text = "one page with a fair number of words that nobody else has written in just this way " * 4
    once = frame(spark, [(1, text, "en", "h", 0)] * 9)
    assert {r.n_removed_lines for r in compare(spark, [r.asDict() for r in once.collect()], once)} == {0}
    many = frame(spark, [(i, text, "en", "h", 0) for i in range(6)] + [(9, text, "en", "i", 0)])
    got = compare(spark, [r.asDict() for r in many.collect()], many)
    assert {r.doc_id for r in got if r.n_removed_lines} == set(range(6))


def test_empty(spark):
    assert Q.quality_rules(frame(spark, [])).collect() == []
