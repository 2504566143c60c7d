"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again as the next one's documents, so a lost executor costs no more
than the stage at hand.

Defined cases, for every stage but the last: the columns are those of documents, further ones are left out; an
empty table gives an empty one; repeated rows are judged alike (near duplicates keep one of them); long texts are
taken whole. Null and empty texts have no letter, so the first stage drops them; the others keep them as they are,
but removal of passages turns null into empty. Rows without a doc_id stay like others; near duplicates tell
them apart by their words. Ties: of near duplicates the least doc_id stays, of equal passages the first by doc_id.
``n_chars`` follows the text. The last stage gives the pieces of packed sequences (see its operator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import jaccard_join, language_id, packing, pii, suffix_dedup
from roadloom.llm.common import Scratch, documents
from roadloom.llm.entry import PSEUDONYM_KEY, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts without a letter go, and those whose language is a toss-up.
LEAST_SCORE = 0.5
#: Near duplicates: shingles of five words, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs.select(*COLUMNS), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILAR_PERCENT)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.without_repeats(docs.select(*COLUMNS)))


def pseudonymise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.pseudonymise(docs.select(*COLUMNS), PSEUDONYM_KEY))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("personal_data", pseudonymise_personal_data),
    ("packing", pack_sequences),
]

#: No stage but the personal data can be said in SQL; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = documents(spark, sf_dir, *COLUMNS), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
