"""A sink for published pages: tasks write the pages, one commit makes them and their manifest visible together.

Register it with ``spark.dataSource.register(PageSink)`` and write rows (publish_id, base, ward, constituency, html, sheets) with
``df.write.format("roadloom_pages").mode("append").option("path", …).save()``. The folder is one that all executors share (a path, or
a URI that pyarrow opens). Tasks write under staging names; what reaches the driver is the pages' names only. The commit gives each page
a free name and writes one new version of the manifest from their messages; a page without an entry in the newest version is not published.
Versions are numbered and made only if their number is free, so two commits never mix: the later one starts again from the earlier's.
A failed job leaves the manifest as it was and its staging names are removed.

Defined cases: a publish_id that the manifest has is a retry, which publishes nothing; of rows with one publish_id the first by base and ward
stands, rows without one are all new; entries whose file has gone drop out, and their sheets with them; entries older than ``days`` (option, 14)
before ``now`` (option, ISO time; else the present) go with their files; a null html is an empty page, null sheets are none; no rows still make a version.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "roadloom_pages"
SCHEMA = "publish_id string, base string, ward string, constituency string, html string, sheets string"
STAGING, VERSIONS = "_staging", "_manifest"
ENTRY = "filename string, ward string, constituency string, publish_id string, generated_at string, sheets string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1))
    return store, root.rstrip("/")


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File)


def _put(store: fs.FileSystem, path: str, text: str) -> None:
    with store.open_output_stream(path) as out:
        out.write(text.encode())


def _claimed(store: fs.FileSystem, source: str, target: str) -> bool:
    """Puts a copy under a name unless the name is taken; where the store can link files, two can't both have it."""
    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
    if store.get_file_info(target).type != fs.FileType.NotFound:
        return False
    store.copy_file(source, target)
    return True


def _read(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as file:
        return file.read().decode()


@dataclass
class Staged(WriterCommitMessage):
    """publish_id, base, ward, constituency, staged page, staged sheets (or None) of each page that a task wrote."""

    pages: list[tuple]


class PageWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.days, self.now = options["path"], int(options.get("days", 14)), options.get("now")
        self.token = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        store, root = _opened(self.path)
        folder, pages = f"{root}/{STAGING}/{self.token}", []
        store.create_dir(folder, recursive=True)
        for row in rows:
            names = []
            for text in (row.html or "", row.sheets):
                name = None if text is None else f"{folder}/{uuid.uuid4().hex}"
                if name:
                    _put(store, name, text)
                names.append(name)
            pages.append((row.publish_id, row.base, row.ward, row.constituency, *names))
        return Staged(pages)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = _opened(self.path)
        staged = sorted((p for m in messages if m for p in m.pages), key=lambda p: tuple(x or "" for x in p))
        now = datetime.datetime.fromisoformat(self.now) if self.now else datetime.datetime.now(datetime.timezone.utc)
        now = now if now.tzinfo else now.replace(tzinfo=datetime.timezone.utc)
        for folder in (VERSIONS, f"{STAGING}/{self.token}"):
            store.create_dir(f"{root}/{folder}", recursive=True)
        done, placed = False, {}
        while not done:
            versions = _names(store, f"{root}/{VERSIONS}")
            entries = json.loads(_read(store, f"{root}/{VERSIONS}/{versions[-1]}")) if versions else []
            files = set(_names(store, root))
            entries, gone = self._kept(entries, files - set(placed.values()), now)
            known = {e["publish_id"] for e in entries if e["publish_id"]}
            taken, tried = files | {e["filename"] for e in entries} | set(placed.values()), {}
            for publish_id, base, ward, constituency, page, sheets in staged:
                if publish_id in known:
                    continue
                known |= {publish_id} - {None}
                # a page that has been given a name keeps it when another commit came first
                if page not in placed:
                    while not _claimed(store, page, f"{root}/{(name := self._free(base, taken, tried))}"):
                        taken.add(name)
                    taken.add(name)
                    placed[page] = name
                    if sheets:
                        store.copy_file(sheets, f"{root}/{name.removesuffix('.html')}-sheets.html")
                name = placed[page]
                entries.append({"filename": name, "ward": ward, "constituency": constituency, "publish_id": publish_id, "generated_at": now.isoformat(), "sheets": f"{name.removesuffix('.html')}-sheets.html" if sheets else None})
            number = int(versions[-1].split(".")[0]) + 1 if versions else 1
            done = self._made(store, root, number, json.dumps(entries))
        # what no entry names any more; a name that was free again may have been given anew
        named = {e["filename"] for e in entries} | {e["sheets"] for e in entries}
        for name in [*gone, *placed.values()]:
            for file in {name, f"{name.removesuffix('.html')}-sheets.html"} - named:
                if store.get_file_info(f"{root}/{file}").type == fs.FileType.File:
                    store.delete_file(f"{root}/{file}")
        self._swept(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._swept(*_opened(self.path))

    def _swept(self, store: fs.FileSystem, root: str) -> None:
        folder = f"{root}/{STAGING}/{self.token}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)

    def _kept(self, entries: list[dict], files: set[str], now: datetime.datetime) -> tuple[list[dict], list[str]]:
        """Entries whose page is there and not too old, and the names of those that go."""
        kept, gone = [], []
        for entry in entries:
            old = entry["generated_at"] and now - datetime.datetime.fromisoformat(entry["generated_at"]) > datetime.timedelta(days=self.days)
            (gone if old or entry["filename"] not in files else kept).append(entry)
        return kept, [e["filename"] for e in gone]

    @staticmethod
    def _free(base: str, taken: set[str], tried: dict[str, int]) -> str:
        """The first name of a base that isn't taken; as taken names stay taken, numbers below the one tried last are not tried again."""
        number = tried.get(base, 0)
        while f"{base}{number or ''}.html" in taken:
            number += 1
        tried[base] = number
        return f"{base}{number or ''}.html"

    def _made(self, store: fs.FileSystem, root: str, number: int, text: str) -> bool:
        """Whether this commit made the version: of two that write one number, the first has it."""
        part = f"{root}/{STAGING}/{self.token}/{uuid.uuid4().hex}"
        _put(store, part, text)
        return _claimed(store, part, f"{root}/{VERSIONS}/{number:08d}.json")


class PageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(dict(self.options))


def publish(pages: DataFrame, path: str, **options) -> None:
    """Publishes rows of SCHEMA in one commit."""
    spark = pages.sparkSession
    spark.dataSource.register(PageSink)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    pages.select(*columns).write.format(FORMAT).mode("append").options(path=path, **{k: str(v) for k, v in options.items()}).save()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The entries (ENTRY) of the newest manifest; none before the first commit."""
    store, root = _opened(path)
    versions = _names(store, f"{root}/{VERSIONS}")
    if not versions:
        return spark.createDataFrame([], ENTRY)
    text = spark.read.text(f"{path.rstrip('/')}/{VERSIONS}/{versions[-1]}", wholetext=True)
    return text.select(F.explode(F.from_json("value", f"array<struct<{ENTRY.replace(' string', ':string')}>>")).alias("e")).select("e.*")
