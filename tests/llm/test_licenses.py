import textwrap
from pathlib import Path

import duckdb
import pytest

from factpanel.llm import licenses, queries


def test_scan(spark, odd_documents, no_documents):
    mit = "MIT Licence\n\nCopyright (c) 2020 Foo Bar\nAll rights reserved.\n\n" + licenses.LICENSES[0][1].upper().replace("SUBLICENSE", "sub-licence")
    rows = [(1, mit), (2, mit + " more"), (3, "x\n  Released under the *MIT* License!\r\nLicensed under CC BY-NC 4.0.\nreleased under the mit licence"), (4, None), (5, "")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(1, 6)] == ["MIT", None, None, None, None]
    assert (got[3]["notices"], got[3]["n_notice_lines"]) == ("CC-BY-NC-4.0,MIT", 3)
    assert licenses.scan(odd_documents).count() == odd_documents.count()
    assert licenses.scan(no_documents).count() == 0


def test_every_known_text_is_found(spark):
    rows = [(i, f"(c) 1999 A. Uthor\n{t}\n") for i, (_, t) in enumerate(licenses.LICENSES)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in licenses.LICENSES]


def test_licenses_in_any_wrapping(spark):
    rows, want = [], []
    for name, text in licenses.LICENSES:
        paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
        for head in ("Copyright (c) 2020 Foo Bar", "Copyright The Foo Authors\nAll rights reserved.", "© 2019-2021 Foo\n(c) Copyright Bar", "Copyright: 2020, Foo", "Copyright Orange SA", "(c) Foo", ""):
            for width in (None, 12, 20, *range(58, 82, 2), 100):
                body = [p if width is None else textwrap.fill(p, width, break_long_words=False) for p in paragraphs]
                rows.append((len(rows), head + "\n\n" + "\n\n".join(body)))
                want.append(name)
        rows.append((len(rows), "// (c) 2001 X\n" + "\n".join(" * " + x for p in paragraphs for x in textwrap.wrap(p, 70))))
        want.append(name)
    isc = """ISC License

Copyright (c) 2010 Foo

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""" + licenses._ISC_WARRANTY
    rows += [(len(rows), isc), (len(rows) + 1, isc.replace("copyright notice and", "copyright notice or"))]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, got[i], n) for i, n in enumerate([*want, "ISC", None]) if got[i] != n] == []


HEADS = [
    "MIT License\n\nCopyright (c) 2020 Jane", "MIT License Copyright (c) 2020 Jane", "The MIT License - Copyright 2020 Jane", "MIT License\nCopyright and Sons Ltd 2020", "MIT License\nCopyright In Motion 2020",
    "MIT License\nCopyright Notice Software GmbH (c) 2019", "MIT License\n(c) 2020 Jane", "The MIT License (MIT) Copyright (c) 2020 Jane", "MIT License\n© 2020 Jane\nAll rights reserved.", "MIT License\nCopyright Orange SA", "// MIT License\n// Copyright 2020, Holder & Co", "Copyright On Time Inc., 2001-2020", "MIT License\nCopyright to the people 1999",
]


def test_holders_of_any_name_and_titles_on_their_line(spark):
    body = licenses.LICENSES[0][1]
    rows = [(i, f"{head}\n\n{body}") for i, head in enumerate(HEADS)]
    rows += [(100, f"MIT License Copyright holders may not 2020 copy\n\n{body} and more")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {h: got[i] for i, h in enumerate(HEADS)} == dict.fromkeys(HEADS, "MIT") and got[100] is None


PUBLISHED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not PUBLISHED.is_dir(), reason="published texts aren't here")
def test_longer_licenses_as_published(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, want = [], []
    for file, name in files.items():
        text = (PUBLISHED / file).read_text()
        shown = [text, text.replace("\n", "\r\n"), text.upper(), "\n".join(f" * {x}" for x in text.split("\n"))]
        if name in ("Apache-2.0", "MPL-2.0"):
            paragraphs = [" ".join(p.split()) for p in text.split("\n\n")]
            shown += ["\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in paragraphs) for w in (60, 72, 80, 10_000)]
        rows += [(len(rows) + i, t) for i, t in enumerate(shown)]
        want += [name] * len(shown)
    rows.append((len(rows), (PUBLISHED / "GPL-2").read_text().replace("freedom", "liberty")))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [*want, None]
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    assert {r[0]: r[2] for r in con.execute(licenses.oracle_sql()).fetchall()} == got


def test_query_matches_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = con.execute(licenses.oracle_sql()).fetchall()
    got = [tuple(r) for r in queries.op3_licenses(spark, data).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
