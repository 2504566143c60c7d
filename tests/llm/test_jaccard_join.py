import random
import re

import numpy as np

from roadloom.llm import jaccard_join as J
from roadloom.llm.common import Scratch, components
from tests.llm.cases import documents, frame


def shingles(text, words=3):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(ids) if ids else None
    return [(doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets))]


def compare(docs, **options):
    got = [tuple(r) for r in J.link_documents(docs, **options).collect()]
    assert sorted(got, key=str) == sorted(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], options.get("percent", 90)), key=str)
    return got


def pages(n, groups, rng):
    vocabulary = ["w%d" % i for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 5, 12, 40, 80, 200)))] for _ in range(groups)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 6))):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]))
            words = words or ["w1"]
        yield i, " ".join(words)


def test_driver_documents(spark):
    compare(spark.createDataFrame([(r["doc_id"], r["text"]) for r in documents()], "doc_id long, text string").repartition(3))


def test_planted_groups(spark, monkeypatch):
    rng = random.Random(4)
    rows = list(pages(700, 12, rng))
    got = compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert 1 < len({r[2] for r in got}) < len(got)
    # blocks of a few rows: every group is dealt out
    monkeypatch.setattr(J, "GROUP_ROWS", 5)
    monkeypatch.setattr(J, "GROUP_BYTES", 2000)
    compare(spark.createDataFrame(rows[:300], "doc_id long, text string").repartition(5))


def test_odd_rows(spark):
    compare(frame(spark, more=True))
    assert J.link_documents(frame(spark, [])).collect() == []


def test_every_similar_pair_shares_a_signature():
    rng = np.random.default_rng(5)
    for turn in range(3000):
        percent = (80, 90, 95)[turn % 3]
        bands, n = J.Bands(percent), int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop, add = rng.integers(0, n // (6, 12, 24)[turn % 3] + 1, 2)
        b = np.unique(np.r_[a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**64, add, dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        similar = 100 * both >= percent * (len(a) + len(b) - both)
        if not similar or not len(b):
            continue
        i, j = sorted((bands.band(len(a)), bands.band(len(b))))
        assert j - i <= 1 and len(a) + len(b) - 2 * both <= bands.differing(len(a), len(b)) <= bands.most(j)
        sign = lambda x, *more: J.signatures(x, j, bands.most(j), bands.tops[j], *more)  # noqa: B023, E731
        assert np.intersect1d(sign(a), sign(b)).size
        for inner, spare in ((4, 2), (4, 1), (5, 2), (3, 1)):
            spare = min(spare, bands.most(j))
            cut = (-(-(bands.most(j) + 1) // (spare + 1)) + turn % 4, inner, spare)
            assert np.intersect1d(sign(a, cut), sign(b, cut)).size
        bits = bands.sketch_bits(j)
        assert np.bitwise_count(J.sketch(a, bits) ^ J.sketch(b, bits)).sum() <= len(a) + len(b) - 2 * both


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1050)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()}
    assert got == {n: root[n] for n in touched}
