"""How far the sources of a language differ in what they write about: an audit by smoothed term shares.

Every (lang, source) group and every language gives each kept term a share p of a billion. The divergence of
two groups sums f(p, q) over all kept terms, but most terms are absent from most groups, so nothing walks the
terms of a pair: a pair begins with V times the f of two counts of zero, and the inverted index corrects it. Where
one group of a pair has a term, the correction depends on the group's count and on the other's zero share alone, so
it is taken once for each different count of the group. Where both have it, the term's postings emit what is left.
Corrections are sums of longs that combine before they shuffle.

Terms are letters A-Z in either case and all characters beyond ASCII. Defined cases: null text, lang and source are
''; every row is a document, so repeated rows and rows without a doc_id count like others; texts are taken whole; a
group without kept terms has shares of zero counts; a language without kept terms has pairs of value 0 and no terms;
ties of value are ranked by the item's UTF-8 bytes; further columns are left out; an empty table gives an empty one.
Shares are taken by long division in three steps, so counts may grow to 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, lean, small_side, utf8_batch

LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Texts of about so many bytes are counted together; a longer one by itself.
BLOCK_BYTES = 16 << 20
_CODES = np.arange(256)
_LETTER = (_CODES >= 0x80) | ((_CODES | 0x20 >= ord("a")) & (_CODES | 0x20 <= ord("z")) & (_CODES >= 0x41))
_LOWER = np.where((_CODES >= ord("A")) & (_CODES <= ord("Z")), _CODES + 32, _CODES).astype(np.uint8)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)) without leaving longs; null if nothing is kept."""
    divisor = F.when(kept > 0, total + 2 * kept)
    quotient, rest = F.lit(1_000_000_000 // 1000**3), count + 2
    for _ in range(3):
        step = rest * 1000
        quotient, rest = quotient * 1000 + F.floor(F.call_function("div", step, divisor)), step % divisor
    return quotient - 1_000_000_000 + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def block_counts(texts: pa.ChunkedArray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of texts, groups numbering each text's group.

    Every byte of a character beyond ASCII belongs to a term, so bytes are looked at, not characters.
    """
    raw, bounds = utf8_batch(texts)
    inside = _LETTER[raw]
    begins = inside.copy()
    opens = np.zeros(len(raw) + 1, bool)
    opens[bounds[:-1]] = True
    begins[1:] &= ~inside[:-1] | opens[1:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.cumsum(inside) - 1
    letters = _LOWER[raw[inside]]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(place[at], len(letters)).astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    size = len(words.dictionary)
    row = np.searchsorted(bounds, at, side="right") - 1
    pair, times = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
    key, which = np.unique(groups[pair // size] * size + pair % size, return_inverse=True)
    terms = words.dictionary.take(pa.array(key % size)).view(pa.large_string()).cast(pa.string())
    return key // size, terms, np.bincount(which, times).astype(np.int64), np.bincount(which)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of each term, and a row of term '' for every group."""
    names = ["lang", "source", "term", "n", "docs"]

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        lang, source = (table.column(i).combine_chunks().dictionary_encode() for i in (1, 2))
        group, of_text = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        of_group, terms, n, documents = block_counts(table.column(0), of_text)
        none = np.zeros(len(group), np.int64)
        every = group[np.concatenate([of_group, np.arange(len(group))])]
        return pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(every // len(source.dictionary))), source.dictionary.take(pa.array(every % len(source.dictionary))),
            pa.concat_arrays([terms, pa.array([""] * len(group), pa.string())]), pa.array(np.concatenate([n, none])), pa.array(np.concatenate([documents, none])),
        ], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(0).nbytes
            if size >= BLOCK_BYTES:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return given.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source)."""
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(term_counts(docs.select("text", "lang", "source")), "counts")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents).drop("docs")
    found = scratch.write(counts.drop("docs").filter("n > 0").join(kept, ["lang", "term"]), "postings")

    of_group = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = found.groupBy("lang").agg(F.count_distinct("term").alias("kept"), F.sum("n").alias("lang_total"))
    every = counts.filter("term = ''").select("lang", "source").join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    groups = scratch.write(every.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "groups")

    shared = found.join(small_side(groups), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    shared = scratch.write(shared.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).select("lang", "term", "source", "n", "p", "q", "zero"), "shares")

    return _pairs(groups, shared).unionByName(_terms(shared, top))


def _pairs(groups: DataFrame, shared: DataFrame) -> DataFrame:
    other = small_side(groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero")))
    zeros = distance(F.col("zero"), F.col("other_zero"))
    ordered = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
    start = groups.join(other, "lang").filter("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("kept") * zeros, F.lit(0)).alias("value"))

    # terms of one group of a pair, against a count of zero in the other
    sizes = shared.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    single = sizes.join(other, "lang").filter("source <> other").select("lang", *ordered, (F.col("terms") * (distance(F.col("p"), F.col("other_zero")) - zeros)).alias("value"))

    # terms that both have: what the two corrections above got wrong
    left = shared.select("lang", "term", F.col("source").alias("a"), "p", "zero")
    right = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both = left.join(right, ["lang", "term"]).filter("a < b")
    rest = distance(F.col("p"), F.col("other_p")) - distance(F.col("p"), F.col("other_zero")) - distance(F.col("zero"), F.col("other_p")) + zeros
    met = both.select("lang", "a", "b", rest.alias("value")).filter("value <> 0")

    sums = start.union(single).union(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "value", F.inline(ends)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.cast("int").alias("rank"))


def _terms(shared: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return above.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top)


#: The audit by its definition: every kept term for every pair of groups.
AUDIT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lc FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.c, 1 + (1000000000::HUGEINT * (x.c + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (x.lc + 2)) // (v.n + 2 * v.v) AS q
      FROM x JOIN n ON n.lang = x.lang AND n.source = x.source JOIN v ON v.lang = x.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
