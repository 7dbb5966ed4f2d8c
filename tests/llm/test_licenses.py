"""Whole licences under other holders, spellings and wrappings of their copyright lines."""

import os

import duckdb
import pytest

from loomlake.llm.license_texts import TEXTS
from loomlake.llm.licenses import scan_licenses
from loomlake.llm.sql import LICENSES_SQL

KNOWN = "/usr/share/common-licenses"
SCHEMA = "doc_id long, text string, license_id string, d string"
HOLDERS = ["Copyright (c) 2020 A", "Copyright (c) Microsoft Corporation.", "Copyright Jane Doe, 2019", "Portions Copyright (c) 2019 X", "© 2019 Jane Doe", "Copyright The Foo Authors", "(c) 2011-2014 B", "COPYRIGHT © Example Ltd. All rights reserved."]


def ids(spark, texts):
    docs = spark.createDataFrame([(k, t, "mine", "d") for k, t in enumerate(texts)], SCHEMA)
    return [r.license_id for r in scan_licenses(docs).orderBy("doc_id").collect()]


def test_holder_lines(spark):
    for name in ("MIT", "ISC", "BSD-3-Clause"):
        assert ids(spark, [f"{h}\n\n{TEXTS[name]}" for h in HOLDERS]) == [name] * len(HOLDERS)


def test_other_texts_are_not_known(spark):
    mit = TEXTS["MIT"]
    assert ids(spark, [mit + " One more word.", mit.replace("without restriction", ""), "copyright holders", "", None, "x " * 2_000_000]) == [None] * 6


@pytest.mark.skipif(not os.path.isdir(KNOWN), reason="no licences on this machine")
def test_whole_published_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    texts = {f: open(f"{KNOWN}/{f}", encoding="utf-8").read() for f in names}
    # The regents are named in that text itself, which other holders replace.
    texts["BSD"] = texts["BSD"].replace("the University nor the names of its contributors", "the copyright holder nor the names of its\n   contributors").replace("REGENTS", "COPYRIGHT HOLDERS").replace("REGENTS", "HOLDERS")
    cut = texts["Apache-2.0"].split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS\n"
    got = ids(spark, [*[texts[f] for f in names if f != "BSD"], texts["GPL-3"].upper(), "  " + texts["MPL-2.0"].replace("\n", "\r\n"), cut])
    assert got == [*[i for f, i in names.items() if f != "BSD"], "GPL-3.0", "MPL-2.0", "Apache-2.0"]


def test_sql_finds_them_too(spark, tmp_path):
    texts = [f"{h}\n{TEXTS['MIT']}" for h in HOLDERS] + [None, "", "Released under the MIT licence."]
    if os.path.isdir(KNOWN):
        texts.append(open(f"{KNOWN}/GPL-3", encoding="utf-8").read())
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/d")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((r[0], r[1], r[2] or "") for r in db.sql(LICENSES_SQL()).fetchall())
    assert sorted((r.doc_id, r.license_digest, r.license_id or "") for r in scan_licenses(docs).collect()) == want
    assert ("MIT" in {r[2] for r in want}) and len(want) == len(texts)
