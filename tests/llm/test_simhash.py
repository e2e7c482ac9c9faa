import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factpanel.llm import queries, simhash
from factpanel.llm.components import connected_components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "ſ", " ", "\n", "\x0b", "\x1c", "\u0085", "cc dd", "Ee ff gg"]), max_size=60).map("".join))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    for s in ("", "a", "hello world x y", "é" * 50):
        assert spark.range(1).select(F.xxhash64(F.lit(s))).first()[0] % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def test_masks_cover_every_pair():
    rng = random.Random(1)
    masks = simhash.masks(4)
    assert len(masks) == 31 and all(m.bit_count() >= 30 for m in masks)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & difference == 0 for m in masks)


def groups_by_force(items, near):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(items, np.uint64)
    for i, x in enumerate(items):
        for j in np.flatnonzero(near(array[i + 1 :], array[i])):
            parent[find(x)] = find(items[i + 1 + j])
    out = {}
    for x in items:
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def clustered(seed):
    rng, found = random.Random(seed), set()
    for _ in range(150):
        centre = rng.getrandbits(64)
        found.add(centre)
        for _ in range(rng.choice([0, 1, 5, 60])):
            found.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    return sorted(found)


@pytest.mark.parametrize("large_bucket", [simhash.LARGE_BUCKET, 40, 3])
def test_links_against_all_pairs(spark, large_bucket):
    items = clustered(large_bucket)
    want = groups_by_force(items, lambda a, x: np.bitwise_count(a ^ x) <= 4)
    df = spark.createDataFrame([(simhash.signed(x),) for x in items], "f long").repartition(3)
    out = {}
    for r in connected_components(simhash.links(df, large_bucket=large_bucket)).collect():
        out.setdefault(r["component"], set()).add(r["node"] % 2**64)
    assert {frozenset(g) for g in out.values()} == {g for g in want if len(g) > 1}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    known = [(a, b) for a, b in edges if a is not None and a != b]
    reach = {n: n for e in known for n in e}
    for _ in range(300):
        for a, b in known:
            reach[a] = reach[b] = min(reach[a], reach[b])
    assert got == reach
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, documents):
    prints = {i: brute_fingerprint(t) for i, t in documents}
    items = sorted(set(prints.values()))
    group = {x: g for g in groups_by_force(items, lambda a, x: np.bitwise_count(a ^ x) <= 4) for x in g}
    least = {}
    for i, x in prints.items():
        if i is not None:
            least[group[x]] = min(i, least.get(group[x], i))
    for r in rows:
        x = prints[r["doc_id"]]
        assert r["fingerprint"] == f"{x:016x}" and r["component_id"] == least.get(group[x])


def test_query(spark, data):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = queries.op8_simhash(spark, data).collect()
    assert len(rows) == len(documents)
    check(rows, documents)


def test_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    check(rows, [(r["doc_id"], r["text"]) for r in odd_documents.collect()])
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[7] == 6 and by_id[None] is None
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_one(odd_documents)
    assert kept.schema == odd_documents.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "6", "8", "None"]
    assert simhash.keep_one(no_documents).count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    p, q, z = (" ".join(f"{c}{i}" for i in range(80)) for c in "pqz")
    rows = [(1, p, "a"), (5, p, "b"), (5, q, "c"), (7, z, "d"), (7, z, "e"), (7, "other words " + q, "f"), (8, None, "g"), (8, "", "h"), (None, p, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, f string").selectExpr("*", "1 as rows", "2 as first", "3 as id", "4 as text_sha256", "5 as class", "6 as x")
    kept = [sorted(r["f"] for r in simhash.keep_one(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and [x for x in kept[0] if x not in "degh"] == ["a", "c", "f", "i"]
    assert len([x for x in kept[0] if x in "de"]) == 1 and len([x for x in kept[0] if x in "gh"]) == 1
    assert simhash.keep_one(df).columns == df.columns
    split = spark.createDataFrame([(5, z), (5, q)], "doc_id long, text string")
    assert simhash.keep_one(split).count() == 2
