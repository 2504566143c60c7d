"""Rows that every operator has to take: nulls, empty and long texts, repeats, further columns, no rows."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "The quick brown fox jumps over the lazy dog while seven wise men watch from a quiet hill near the old town. "


def odd_rows() -> list[tuple]:
    return [
        (1, "one two three four five\nsix seven", "en", "a", 33),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "a", 4),
        (5, PROSE * 400, "en", "b", 1),
        (6, PROSE, "en", "b", 1),
        (7, PROSE, "en", "b", 1),
        (7, PROSE, "en", "b", 1),
        (8, "ünïcode ▁ 日本語 😀 \u0000 é ſ İ ﬁ ½ 12.5.2020", "de", "c", 1),
        (9, "a" * 3000, "de", "c", 1),
        (None, "no identifier here", "en", "c", 1),
        (-5, "#$% a a a a a a\na a\na a", "es", "c", 1),
    ]


def frame(spark, rows=None, more: bool = False):
    out = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    if more:
        for name in ("length", "place", "key", "n", "line", "bucket", "h", "piece", "task", "rank", "_w", "start", "score", "guest", "_found", "_new", "_again", "_gone", "_node", "_set", "_n", "n_pseudonyms"):
            out = out.selectExpr("*", f"'x' as {name}")
    return out


def documents(sf: str = "0.01"):
    import pyarrow.parquet as pq

    return pq.read_table(f"/root/testdata/sf{sf}/documents.parquet").to_pylist()
