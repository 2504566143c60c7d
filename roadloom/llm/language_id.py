"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte n-grams (naive
Bayes log-odds, averaged over the text) predicts the side; decoding adds up each bit's logistic loss, weighted
by how well the bit did on held-back training texts, and takes the codeword with the least. A text whose best
two codewords are nearly as close is flagged as ambiguous.

Training reads at most ``PER_LANGUAGE`` texts of each language in expectation (those with the lowest hashes of
their ids; a bound that does not grow with the corpus), half as many more to weigh the bits.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with a null language or text
teach nothing; without any training text all is ``und``; one known language is predicted for every text with a
letter; repeated rows get equal results, and of codewords equally near the first language by name is taken; a
null doc_id is not held out and teaches nothing; an empty table gives no rows; further columns are ignored (or
stay, in ``keep_identified``); long texts are read whole, in blocks of whole texts of about BLOCK bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, lean, mix64, small_side, utf8_batch

UNKNOWN = "und"
PER_LANGUAGE = 3000
FOLDS = 5
DIMENSIONS = 1 << 15
BLOCK = 1 << 21
#: A text is ambiguous when the best codeword's share is below this.
LEAST_SCORE = 0.6
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.array([32 if b < 128 and not chr(b).isalpha() else b for b in range(256)], np.uint8)


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1: every split of up to five languages, else pseudo-random splits, all rows different."""
    if languages <= 5:
        bits = max(1, 2 ** (languages - 1) - 1)
        rows = [[1] * bits] + [[-1 if (b + 1) >> (i - 1) & 1 else 1 for b in range(bits)] for i in range(1, languages)]
        return np.array(rows, np.float64)
    bits = int(np.ceil(10 * np.log2(languages)))
    for seed in range(1, 1000):
        drawn = mix64(np.arange(languages * bits, dtype=np.uint64) + np.uint64(seed << 32)).reshape(languages, bits)
        code = np.where(drawn & np.uint64(1 << 40), 1.0, -1.0)
        code = code[:, np.abs(code.sum(0)) < languages]
        if len(np.unique(code, axis=0)) == languages:
            return code
    raise ValueError("no code found")


def _grams(raw: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole texts: first text, end, hashed trigrams and bigrams of each place, text of each place."""
    first = 0
    while first < len(bounds) - 1:
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK, side="right")) - 1)
        part = _CLASS[raw[bounds[first] : bounds[end]]].astype(np.uint32)
        size = np.diff(bounds[first : end + 1])
        owner = np.repeat(np.arange(end - first, dtype=np.int32), size)
        if len(part) >= 3:
            two = part[:-2] << 8 | part[1:-1]
            three = two << 8 | part[2:]
            inside = (owner[:-2] == owner[2:]) & (two != 0x2020)
            hashed = np.stack([three[inside] * np.uint32(2654435761) >> 17, two[inside] * np.uint32(2246822519) >> 17])
            yield first, end, hashed, owner[:-2][inside]
        first = end


def has_letter(text: str | None) -> bool:
    """Whether a character of one of Unicode's letter categories is in the text; number signs such as ½ are none."""
    return text is not None and any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text))


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMENSIONS x bits
    scale: np.ndarray  # of each bit's mean margin
    trust: np.ndarray  # of each bit, adds up to the number of bits

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-odds of each text and bit, and whether the text has n-grams."""
        raw, bounds = utf8_batch(_lower(column))
        total, n = np.zeros((len(column), self.code.shape[1])), np.zeros(len(column))
        for first, end, hashed, owner in _grams(raw, bounds):
            if not len(owner):
                continue
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for b in range(self.code.shape[1]):
                own = self.weights[b]
                total[first + owner[start], b] += np.add.reduceat(own[hashed[0]] + own[hashed[1]], start, dtype=np.float64)
            n[first + owner[start]] += np.diff(np.r_[start, len(owner)]) * 2
        return total / np.maximum(n, 1)[:, None], n > 0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        margins, _ = self.margins(column)
        loss = np.logaddexp(0, -(margins * self.scale)[:, None, :] * self.code[None]) @ self.trust
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        letter = [has_letter(x) for x in column.to_pylist()]
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letter)], np.where(letter, share[np.arange(len(best)), best], 0.0)


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """lang, text, weigh: about per_language texts of each language to learn from, and half as many to weigh the bits by."""
    # a few rows, checked: a join by language alone would shuffle all texts to as many tasks as there are languages
    counts = small_side(Scratch(labelled.sparkSession).write(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n")), "languages"))
    drawn = labelled.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    share = F.col("u") * F.col("n") / per_language
    joined = drawn.join(counts, F.col("lang") == F.col("_lang"))
    # a language with fewer texts than the bound gives a third of them for the weights
    most = F.least(F.lit(1.5), F.col("n") / F.lit(float(per_language)))
    return joined.filter(share < most).select("lang", "text", (share >= most / 1.5).alias("weigh"))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled (doc_id, text, lang)."""
    sample = _sample(labelled.filter("text is not null and lang is not null and doc_id is not null").select("doc_id", "text", "lang"), per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, bounds = utf8_batch(_lower(batch.column(1)))
            names = np.array(batch.column(0).to_pylist(), object)
            for first, end, hashed, owner in _grams(raw, bounds):
                for name in set(names[first:end]):
                    own = (names[first:end] == name)[owner]
                    sums.setdefault(name, np.zeros(DIMENSIONS, np.int64))
                    sums[name] += np.bincount(hashed[:, own].ravel(), minlength=DIMENSIONS)
        for name, found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(found[at])], names=["lang", "dim", "n"])

    counted = sample.filter("not weigh").select("lang", "text").mapInArrow(lean(count), "lang string, dim long, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("dim").alias("dims"), F.collect_list("n").alias("ns"))
    rows = sorted(counted.collect(), key=lambda r: r.lang)  # at most DIMENSIONS counts of each language
    languages = [r.lang for r in rows]
    table = np.zeros((len(rows), DIMENSIONS))
    for i, r in enumerate(rows):
        table[i, r.dims] = r.ns
    code = codewords(len(languages)) if languages else np.zeros((0, 0))
    shares = (table + 0.5) / (table + 0.5).sum(1, keepdims=True) if languages else table
    weights = []
    for b in range(code.shape[1]):
        plus, minus = shares[code[:, b] > 0], shares[code[:, b] < 0]
        plus, minus = (x.mean(0) if len(x) else np.full(DIMENSIONS, 1 / DIMENSIONS) for x in (plus, minus))
        weights.append(np.log(plus / minus).astype(np.float32))
    model = Model(languages, code, np.array(weights, np.float32), np.ones(code.shape[1]), np.ones(code.shape[1]))
    if len(languages) < 2:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, size, n = np.zeros(code.shape[1]), np.zeros(code.shape[1]), 0
        for batch in batches:
            margins, _ = shared.value.margins(batch.column(1))
            side = code[[languages.index(x) for x in batch.column(0).to_pylist()]]
            right += (margins * side > 0).sum(0)
            size += np.abs(margins).sum(0)
            n += len(side)
        bits = np.arange(len(right))
        yield pa.RecordBatch.from_arrays([pa.array(bits), pa.array(right), pa.array(size), pa.array(np.full(len(right), float(n)))], names=["bit", "right", "size", "n"])

    found = sample.filter("weigh").filter(F.col("lang").isin(languages)).select("lang", "text").mapInArrow(lean(weigh), "bit long, right double, size double, n double").groupBy("bit").agg(*(F.sum(c).alias(c) for c in ("right", "size", "n"))).collect()
    for r in found:
        if r.n:
            # a mean margin of usual size counts as log-odds of 4; a bit no better than chance counts for little
            model.scale[r.bit] = 4 * r.n / max(r.size, 1e-9)
            model.trust[r.bit] = max(0.05, 2 * r.right / r.n - 1)
    model.trust *= len(model.trust) / model.trust.sum()
    return model


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(score < LEAST_SCORE)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def learn_and_identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the rows of docs (doc_id, text, lang) that are not held out; predicts all of them."""
    return identify(docs, train(docs.filter(~held_out(F.col("doc_id"))), per_language))


def keep_identified(docs: DataFrame, least_score: float, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs, as they are, whose text has a language that is not in doubt."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out(F.col("doc_id"))), per_language))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = model.value.predict(batch.column(names.index("text")))
            yield batch.filter(pa.array((np.array(found, object) != UNKNOWN) & (score >= least_score)))

    return docs.mapInArrow(lean(run), docs.schema)
