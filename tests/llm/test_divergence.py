import re
from collections import Counter, defaultdict

import duckdb

from roadloom.llm import divergence as D
from tests.llm.cases import SCHEMA, documents, frame

ROWS = [(k, "Rain fell on the hill " * (1 + k % 4) + ("sun " * (k % 3)), ("en", "de", None)[k % 3], ("a", "b", "c", None)[k % 4], 1) for k in range(90)]


def brute(rows, least, top):
    """By the definition, every kept term for every pair."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        total = {s: sum(count[lang, s][t] for t in kept) for s in sources}

        def p(c, n, v=len(kept)):
            return 1 + 10**9 * (c + 2) // (n + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        shares = {s: [p(count[lang, s][t], total[s]) for t in kept] for s in sources}
        whole = [p(sum(count[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        for s in sources:
            pairs = [(sum(map(f, shares[s], shares[o])), o) for o in sources if o != s]
            terms = [(f(a, q), t) for t, a, q in zip(kept, shares[s], whole) if count[lang, s][t] and a > q]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rows = documents()[:300]
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).union(frame(spark, ROWS)).union(frame(spark))
    want = brute([(r.text, r.lang, r.source) for r in docs.collect()], 10, 10)
    assert {x[2] for x in want} == {"pair", "term"}
    assert sorted(map(tuple, D.audit(docs).collect())) == want


def test_sql_says_the_same(spark):
    docs = frame(spark, ROWS).union(frame(spark))
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        assert sorted(map(tuple, D.audit(docs).collect())) == sorted(db.sql(D.AUDIT_SQL).fetchall())


def test_odd_rows_without_kept_terms_and_empty_tables(spark):
    docs = frame(spark, more=True)
    got = sorted(map(tuple, D.audit(docs).collect()))
    assert got == brute([(r.text, r.lang, r.source) for r in docs.collect()], 10, 10) and got and {(x[2], x[4]) for x in got} == {("pair", 0)}
    assert D.audit(frame(spark, [])).collect() == []
    assert sorted(map(tuple, D.audit(docs, 1, 3).collect())) == brute([(r.text, r.lang, r.source) for r in docs.collect()], 1, 3)


def test_shares_of_large_counts(spark):
    rows = [(c, n, v) for n in (1, 10**6 + 7, 9 * 10**12, 10**15) for v in (1, 977, 10**6) for c in (0, 1, n // 3, n)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", D.share(*(D.F.col(x) for x in "cnv")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in got)
