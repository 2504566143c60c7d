from pathlib import Path

import pytest
from pyspark.sql import functions as F

import hashlib

import duckdb
import pandas as pd

from roadloom.llm import licenses as L
from tests.llm.cases import frame

MIT = L.KNOWN[0][2]


def test_texts_notices_and_sql(spark):
    rows = [
        (10, MIT.replace("2000 A. Holder", "1999-2024 Some Body, Inc."), None, None, None),
        (11, MIT.upper().replace(",", " ,").replace("\n", "\r\n  "), None, None, None),
        (12, MIT.replace("License", "Licence").replace("sublicense", "sub-license"), None, None, None),
        (13, MIT + " And more.", None, None, None),
        (14, "Some prose.\nReleased under the MIT License!\nlicensed under cc by-nc 4.0\n* Released under the MIT licence", None, None, None),
        (15, L.KNOWN[6][2], None, None, None),
    ]
    docs = frame(spark, more=True).unionByName(frame(spark, rows, more=True))
    got = {r.doc_id: r for r in L.scan_licenses(docs).collect()}
    assert [got[i].license for i in (10, 11, 12, 13, 14, 15)] == ["MIT", "MIT", "MIT", None, None, "BSD-3-Clause"]
    assert (got[14].notices, got[14].n_notices) == ("CC-BY-NC-4.0,MIT", 3)
    assert (got[2].license, got[2].notices, got[2].n_notices) == (None, "", 0)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[i].canonical_sha256 == hashlib.sha256(L.canonical_text(t or "").encode()).hexdigest() for i, t in texts.items() if i != 8)
    docs = docs.filter("doc_id is null or doc_id <> 8")  # lower case of a dotted capital I differs between the engines
    documents = docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(L.scan_sql()).df()
    mine = L.scan_licenses(docs).toPandas()
    order = lambda d: sorted(map(str, d.astype(object).where(pd.notna(d), None).itertuples(index=False)))
    keep = lambda d: d.assign(doc_id=d.doc_id.map(lambda x: None if pd.isna(x) else int(x)))
    assert order(keep(mine)) == order(keep(want))
    assert L.scan_licenses(frame(spark, [])).collect() == []


def test_full_texts(spark):
    """The system's copies of the licences, in other case, wrapping and spelling, are found by their digests."""
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    there = {name: (folder / file).read_text() for name, file in files.items() if (folder / file).exists()}
    if not there:
        pytest.skip("no licence texts on this machine")
    rows = [(i, change(text), None, None, None) for i, text in enumerate(there.values()) for change in (str, str.upper, lambda t: " ".join(t.split(" ")), lambda t: t.replace("license", "licence"), lambda t: t + " and more")]
    got = L.scan_licenses(frame(spark, rows)).groupBy("doc_id").agg(F.sort_array(F.collect_list("license")).alias("found")).collect()
    assert {r.doc_id: r.found for r in got} == {i: [name] * 4 for i, name in enumerate(there)}
