"""Fill-in-middle against slices of Python strings, and against its SQL."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factpanel.llm import fim, queries


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "ab", "\x01", "\x02", "\x02a\x01b\x02b", "\x01\x02" * 9, "é😀é\r\n\n\x00$1\\", "<P", "<<S", "S>M>", "a<P>b", "<S>", "x<M>", "<P<S<M", "😀" * 40, "word " * 30_000]


@pytest.fixture(scope="module")
def rows():
    return [(i, TEXTS[i % len(TEXTS)]) for i in range(20 * len(TEXTS))] + [(None, "no id"), (3, "again"), (3, "again")]


def test_equals_slices(spark, rows):
    found = fim.transform(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=str)
    assert got == sorted(((i, t or "", *plain(i, t)) for i, t in rows), key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_restored_from_output_and_form(spark, rows):
    df = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df.where(fim.restored(F.col("output"), F.col("form")) != F.col("text")).isEmpty()


def test_odd_and_empty_tables(odd_documents, no_documents):
    assert fim.digests(odd_documents).count() == odd_documents.count()
    assert fim.digests(no_documents).count() == 0
    for r in fim.digests(odd_documents.select("doc_id", "text", "lang")).collect():
        assert r.n >= 0 and (r.prefix_chars is None) == (r.form == "plain")


def test_no_python_in_the_plan(odd_documents):
    plan = fim.digests(odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query_matches_sql(spark, data):
    got = {tuple(r) for r in queries.op13_fim(spark, data).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    assert got == set(con.execute(queries.ORACLES["op13_fim"]).fetchall())
