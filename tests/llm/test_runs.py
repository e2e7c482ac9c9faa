"""Periodic runs against a search by every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factpanel.llm import queries, runs


def brute(w, least=6, power=4):
    """All runs, from the stretches of each period."""
    out = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(least, power * q) and not any(w[s : e - r] == w[s + r : e] for r in range(1, q)):
                out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(rng):
    n, letters = rng.randint(0, 70), "abc"[: rng.choice([1, 2, 2, 3])]
    w = [rng.choice(letters).encode() for _ in range(n)]
    if rng.random() < 0.6 and n > 10:
        p, a = rng.randint(1, 6), rng.randint(0, n - 1)
        w = w[:a] + (w[a : a + p] * n)[: n - a]
        if rng.random() < 0.5:
            b = rng.randint(0, n - 1)
            w = (w[:b] + [b"z"] + w[b:])[:n]
    return w


@pytest.mark.parametrize("power", [2, 3, 4])
@pytest.mark.parametrize("seed", range(3))
def test_every_run_is_found(seed, power, monkeypatch):
    monkeypatch.setattr(runs, "TOGETHER", 150)
    monkeypatch.setattr(runs, "QUESTIONS", 40)
    rng = random.Random(seed)
    texts = [words(rng) for _ in range(150)]
    found = runs.runs_of(texts, power=power)
    assert len(found) == len(texts)
    for w, got in zip(texts, found, strict=True):
        assert [tuple(r) for r in got.tolist()] == brute(w, power=power)


def test_extensions():
    rng = np.random.default_rng(1)
    letters = rng.integers(0, 2, 300)
    e = runs.Extensions(letters)
    i, j = rng.integers(0, 300, 500), rng.integers(0, 300, 500)
    i, j = i[i != j], j[i != j]
    for a, b, n in zip(i, j, e.ask(i, j), strict=True):
        k = 0
        while max(a, b) + k < 300 and letters[a + k] == letters[b + k]:
            k += 1
        assert k == n


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [(s, e - s, q) for s, e, q in brute(w)]
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in found)
    left = b" ".join(x for i, x in enumerate(w) if i not in gone)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_matches_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, data).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in short:
        assert got[r.doc_id] == expected(r.doc_id, r.text)
    assert any(g[1] for g in got.values())


def test_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    got = sorted(map(str, map(tuple, runs.digests(odd_documents).collect())))
    want = [expected(r.doc_id, r.text) for r in rows if len(r.text or "") < 10_000]
    assert len(got) == len(rows) and set(map(str, want)) <= set(got)
    whole = runs.periodic_runs(odd_documents)
    long = whole.where("doc_id = 5").select("runs", "collapsed").first()  # one word, sixty thousand times
    assert [tuple(r) for r in long.runs] == [(0, 60_000, 1)] and long.collapsed == "word"
    assert runs.digests(no_documents).count() == 0
