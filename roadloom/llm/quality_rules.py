"""Quality rules per document, and the frequency of lines across the documents of one host.

Everything is a DataFrame expression. One pass over the texts writes their counts and the hashes of their
normalised lines; what crosses the network for the line frequencies is these hashes and counts. A line that more
than ``MOST_DOCUMENTS`` documents of a host hold is boilerplate there, at every size of host and corpus, and is
removed from all of them, the first included. A document is depleted, and not kept, when more than a fifth of its
words are removed or fewer than the base rules ask for are left.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a null host is a host of
its own; rows with one doc_id are one document to the line counts, and so are a host's rows without a doc_id;
equal rows get equal verdicts, and there are no ties; an empty table gives an empty result; further columns of the
input are ignored; a long text is read whole, in one row's expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import Scratch, small_side

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A line is boilerplate when more documents of its host hold it.
MOST_DOCUMENTS = 5
#: A document is depleted when boilerplate lines hold more than this share of its words, or leave less than LEAST_WORDS.
MOST_REMOVED = 0.2
SALTS = 16


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _repeated_words(frame: DataFrame, items: str) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that occur twice or more in the text."""
    n = F.size(items)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*[F.get(F.col(items), i + k) for k in range(3)]))
    frame = frame.withColumn("_h", F.when(n > 3, windows))
    # most texts repeat no window, and need no sorting
    frame = frame.withColumn("_g", F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get(F.col("_g"), i)["h"] == x["h"])
    twice = F.transform(F.col("_g"), lambda x, i: F.when((i > 0) & same(x, i - 1) | F.coalesce(same(x, i + 1), F.lit(False)), x["i"]))
    frame = frame.withColumn("_p", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return frame.withColumn("n_repeat_words", F.coalesce(F.aggregate("_p", start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")).drop("_h", "_g", "_p")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, blanks as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), BLANKS, " "))


def counted_texts(docs: DataFrame) -> DataFrame:
    """doc_id, host, the counts of each text and its lines (hash of the normal form, words); one row for each input row."""
    text = F.coalesce("text", F.lit(""))
    frame = docs.select("doc_id", F.col("source").alias("host"), text.alias("_text"))
    frame = _repeated_words(frame.withColumn("_w", words(F.col("_text"))), "_w")
    frame = frame.withColumn("_l", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    # a normal form has single spaces between its words
    item = lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    return frame.select(
        "doc_id",
        "host",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(F.transform("_l", normal_line), item).alias("lines"),
    )


def boilerplate_lines(counted: DataFrame, most_documents: int) -> DataFrame:
    """host, line, n_documents: the lines that more documents of a host hold than the limit allows.

    Distinct documents are counted in two steps, of which the first deals by host, line and document: a line
    that a third of all documents hold is a handful of rows when it reaches one task.
    """
    lines = counted.select("host", "doc_id", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") > most_documents)


def quality_rules(docs: DataFrame, most_documents: int = MOST_DOCUMENTS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """Counts and verdict of every row of docs (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.write(counted_texts(docs).withColumn("row", F.monotonically_increasing_id()), "counted")
    often = scratch.write(boilerplate_lines(counted, most_documents).select(F.col("host").alias("_h"), F.col("line").alias("_l")), "often")
    entries = counted.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.n")
    # one copy of each boilerplate line for every salt: a line that very many documents hold meets them in many tasks
    salted = small_side(scratch.write(often.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "salted"))
    met = entries.withColumn("_t", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    hit = met.join(salted, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_l")) & (F.col("_t") == F.col("_s")))
    removed = hit.groupBy(F.col("row").alias("_r")).agg(F.sum("n").alias("gone"), F.count("*").alias("gone_lines"))
    joined = counted.drop("lines", "host").join(removed, F.col("row") == F.col("_r"), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    depleted = (gone > most_removed * F.col("n_words")) | (F.col("n_words") - gone < LEAST_WORDS)
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        gone.alias("n_removed_words"),
    )
