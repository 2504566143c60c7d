"""Publishing: names, retries, retention, pages deleted by hand, a task that fails, and two commits at once."""

import datetime
import json
import pathlib
import threading

import pytest
from pyspark.sql import functions as F

from roadloom.sources import pages

NOW = "2024-05-20T12:00:00+00:00"


def rows(spark, *given):
    return spark.createDataFrame([(p, b, f"Ward {b}", "North", html, sheets) for p, b, html, sheets in given], pages.SCHEMA).repartition(3)


def listed(spark, path):
    return {(r.publish_id, r.filename, r.sheets) for r in pages.published(spark, str(path)).collect()}


def test_names_retries_and_sheets(spark, tmp_path):
    assert pages.published(spark, str(tmp_path)).collect() == []
    pages.publish(rows(spark, ("a", "north-hill", "<p>1</p>", "<s>1</s>"), ("b", "north-hill", "<p>2</p>", None), (None, "south", None, None), ("a", "south", "again", None)), str(tmp_path), now=NOW)
    assert listed(spark, tmp_path) == {("a", "north-hill.html", "north-hill-sheets.html"), ("b", "north-hill1.html", None), (None, "south.html", None)}
    assert (tmp_path / "north-hill-sheets.html").read_text() == "<s>1</s>" and (tmp_path / "south.html").read_text() == ""
    pages.publish(rows(spark, ("b", "north-hill", "<p>other</p>", None), ("c", "north-hill", "<p>3</p>", None)), str(tmp_path), now=NOW)
    assert {x[:2] for x in listed(spark, tmp_path)} == {("a", "north-hill.html"), ("b", "north-hill1.html"), ("c", "north-hill2.html"), (None, "south.html")}
    assert (tmp_path / "north-hill1.html").read_text() == "<p>2</p>" and not list((tmp_path / "_staging").iterdir())
    assert sorted(p.name for p in (tmp_path / "_manifest").iterdir()) == ["00000001.json", "00000002.json"]


def test_old_and_deleted_pages_go_and_foreign_files_stay(spark, tmp_path):
    (tmp_path / "ward.html").write_text("made by hand")
    pages.publish(rows(spark, ("a", "ward", "a", "s"), ("b", "other", "b", None)), str(tmp_path), now="2024-05-01T00:00:00+00:00")
    assert listed(spark, tmp_path) == {("a", "ward1.html", "ward1-sheets.html"), ("b", "other.html", None)}
    (tmp_path / "ward1.html").unlink()
    pages.publish(rows(spark, ("c", "ward", "c", None)), str(tmp_path), now="2024-05-14T00:00:00+00:00")
    assert listed(spark, tmp_path) == {("b", "other.html", None), ("c", "ward1.html", None)} and not (tmp_path / "ward1-sheets.html").exists()
    pages.publish(rows(spark).limit(0), str(tmp_path), now="2024-05-16T00:00:00+00:00")
    assert listed(spark, tmp_path) == {("c", "ward1.html", None)} and not (tmp_path / "other.html").exists() and (tmp_path / "ward.html").read_text() == "made by hand"


def test_a_failed_task_leaves_the_old_manifest(spark, tmp_path):
    pages.publish(rows(spark, ("a", "ward", "a", None)), str(tmp_path), now=NOW)
    before = sorted(p.name for p in tmp_path.rglob("*"))
    many = spark.range(40).select(F.col("id").cast("string").alias("publish_id"), F.lit("new").alias("base"), F.lit("w").alias("ward"), F.lit("c").alias("constituency"), F.when(F.col("id") == 37, F.raise_error(F.lit("broken page"))).otherwise("x").alias("html"), F.lit(None).cast("string").alias("sheets"))
    with pytest.raises(Exception, match="broken page"):
        pages.publish(many.repartition(4), str(tmp_path), now=NOW)
    assert sorted(p.name for p in tmp_path.rglob("*")) == before and listed(spark, tmp_path) == {("a", "ward.html", None)}


def test_two_commits_never_mix(tmp_path):
    writers = [pages.PageWriter({"path": str(tmp_path), "now": NOW}) for _ in range(8)]
    from pyspark.sql import Row

    made = [w.write(iter([Row(publish_id=f"{n % 4}-{k}", base="ward", ward="w", constituency="c", html=f"{n}-{k}", sheets=None) for k in range(5)])) for n, w in enumerate(writers)]
    threads = [threading.Thread(target=w.commit, args=([m],)) for w, m in zip(writers, made)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    versions = sorted((tmp_path / "_manifest").iterdir())
    assert len(versions) == 8
    entries = json.loads(versions[-1].read_text())
    assert len(entries) == 20 == len({e["publish_id"] for e in entries}) == len({e["filename"] for e in entries})
    for e in entries:
        assert (tmp_path / e["filename"]).read_text()[1:] == e["publish_id"][1:]
    assert {p.name for p in tmp_path.glob("*.html")} == {e["filename"] for e in entries}


def test_names_of_one_base_are_tried_once_each(tmp_path):
    class Counted(str):
        tried = 0

        def __format__(self, spec):
            Counted.tried += 1
            return str(self)

    (tmp_path / "ward3.html").write_text("made by hand")
    writer = pages.PageWriter({"path": str(tmp_path), "now": NOW})
    staged = [(None, Counted("ward"), f"{i:03d}", "c", str(tmp_path / f"page{i}"), None) for i in range(300)]
    for s in staged:
        pathlib.Path(s[4]).write_text("page")
    writer.commit([pages.Staged(staged)])
    names = [e["filename"] for e in json.loads(next((tmp_path / "_manifest").iterdir()).read_text())]
    assert names == [f"ward{i or ''}.html" for i in range(301) if i != 3]
    assert Counted.tried <= 3 * len(staged)
