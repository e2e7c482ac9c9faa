"""Each stage on its own input against a plain-Python account of it."""

import re

import numpy as np
import pytest
from test_packing import check as check_pieces
from test_quality_rules import brute as counts
from test_secrets import base
from test_simhash import brute_fingerprint, groups_by_force

import corpus_pipeline
from factpanel.llm import secrets


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return dict(out)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for name, df in stages.items():
        if name != "packing":
            assert df.schema == stages["documents"].schema


def test_quality(stages):
    """With so few labels no cutoff can be proved, so the base rule alone rejects."""
    kept = {i for i, r in rows(stages["documents"]).items() if (c := counts(r["text"]))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    assert set(rows(stages["quality"])) == kept


def test_near_duplicates(stages):
    prints = {i: brute_fingerprint(r["text"]) for i, r in rows(stages["quality"]).items()}
    first = {}
    for group in groups_by_force(sorted(set(prints.values())), lambda a, x: np.bitwise_count(a ^ x) <= 4):
        members = [i for i, x in prints.items() if x in group]
        first |= {i: min(members) for i in members}
    got = rows(stages["near_duplicates"])
    assert set(got) == {i for i in prints if first[i] == i}
    assert all(got[i] == r for i, r in rows(stages["quality"]).items() if i in got)


def test_substrings(stages):
    before, after = rows(stages["near_duplicates"]), rows(stages["substrings"])
    assert set(before) == set(after)
    first = {}
    for i in sorted(before):
        old, new = before[i]["text"].encode().lower().split(), after[i]["text"].encode().lower().split()
        at = 0
        for w in new:  # what stays is a subsequence of what was there
            at = old.index(w, at) + 1
        assert after[i]["n_chars"] == len(after[i]["text"])
        runs = [tuple(old[k : k + 60]) for k in range(len(old) - 59)]
        kept = {tuple(new[k : k + 60]) for k in range(len(new) - 59)}
        for run in runs:
            holder = first.setdefault(run, i)
            assert holder == i or run not in kept
        if not any(first[run] != i for run in runs) and len(new) < len(old):
            assert len(old) - len(new) >= 40  # a fuzzy passage, never a few words


def test_secrets(stages):
    before, after = rows(stages["substrings"]), rows(stages["secrets"])
    assert set(before) == set(after)
    for i, r in before.items():
        want, at = "", 0
        for s, _, e in base(r["text"]):
            want += r["text"][at:s] + secrets.MARK if s >= at else ""
            at = max(at, e)
        want += r["text"][at:]
        if not re.search(r"[A-Za-z0-9+/_-]{20,}", want):  # no further run that the tests could flag
            assert after[i]["text"] == want
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_packing(stages):
    check_pieces(stages["packing"].collect(), [(i, r["text"]) for i, r in rows(stages["secrets"]).items()])


def test_run_is_the_stages_in_turn(spark, data, stages):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got, want = corpus_pipeline.run(spark, data).select(columns), stages["packing"].select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows_go_through(spark, odd_documents, no_documents, data):
    for documents in (odd_documents, no_documents):
        docs = documents
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
            if name != "packing":
                assert docs.schema == documents.schema
        docs.collect()


def test_repeated_ids_and_long_texts_lose_nothing(spark, data, tmp_path):
    """Texts of one id are told apart by every stage, and long white space gets to the end."""
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, words("p", 90)), (2, words("p", 90)), (2, words("z", 90)), (5, words("q", 90)), (5, words("y", 90)), (7, words("v", 60) + " " * 1_200_000 + words("u", 60)), (8, words("t", 150) + " " + words("p", 90))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    runs = []
    for n in (1, 4):
        docs, seen = frame.repartition(n), []
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, data).write.parquet(str(tmp_path / f"{name}{n}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{n}"))
            seen.append(sorted(map(tuple, docs.select("doc_id", "text").collect())) if name != "packing" else sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect())))
        runs.append(seen)
    assert runs[0] == runs[1]
    kept = {(1, rows[0][1]), (2, rows[2][1]), (5, rows[3][1]), (5, rows[4][1]), (7, rows[5][1]), (8, rows[6][1])}
    assert set(runs[0][1]) == kept
    assert set(runs[0][2]) == (kept - {(8, rows[6][1])}) | {(8, words("t", 150) + " ")}
    check_pieces(docs.collect(), [])
    assert {r[0] for r in runs[0][4]} == {1, 2, 5, 7, 8}
