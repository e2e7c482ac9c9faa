"""Ranges and words against plain searches."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factpanel.operators import lookup


@pytest.mark.parametrize("seed", range(4))
def test_first_range_holds(spark, seed):
    rng = random.Random(seed)
    ranges = [(a := rng.randint(-50, 300), a + rng.randint(-3, 60), f"r{rng.randint(0, 9)}") for _ in range(rng.choice([0, 1, 5, 40]))]
    values = [*range(-70, 380), None]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r["v"]: r["label"] for r in lookup.with_label(df, F.col("v"), ranges, "label", "none").collect()}
    assert got == {v: next((label for a, z, label in ranges if v is not None and a <= v <= z), "none") for v in values}
    pieces = lookup.disjoint(ranges)
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:]))


def test_many_ranges_are_linear(spark, monkeypatch):
    rng = random.Random(9)
    ranges = [(a := rng.randint(0, 10**6), a + rng.randint(0, 300), str(i)) for i in range(10_000)]
    began = time.time()
    pieces = lookup.disjoint(ranges)
    assert time.time() - began < 5 and len(pieces) <= 2 * len(ranges)
    df = spark.range(0, 10**6, 37)
    one = {r["id"]: r["label"] for r in lookup.with_label(df, F.col("id"), ranges, "label").collect()}
    at, want = 0, {}
    for v in range(0, 10**6, 37):
        while at < len(pieces) and pieces[at][1] < v:
            at += 1
        want[v] = pieces[at][2] if at < len(pieces) and pieces[at][0] <= v else None
    assert one == want
    monkeypatch.setattr(lookup, "BROADCAST_PIECES", 10)
    assert {r["id"]: r["label"] for r in lookup.with_label(df, F.col("id"), ranges, "label").collect()} == want


def test_words_in_one_reading(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab.*é", k=rng.randint(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choices("abAB.*éÉ x\n", k=rng.randint(0, 30))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", lookup.words_in("t", words).alias("w"), lookup.contains_any("t", words).alias("any"), lookup.words_in("t", []).alias("none")).collect()
    for r in rows:
        want = [w for w in words if w in (r["t"] or "").lower()]
        assert sorted(r["w"]) == sorted(want) and r["any"] == bool(want) and r["none"] == []


def test_five_thousand_words(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(5000)})
    texts = [" ".join(rng.choices(words, k=3)) if i % 2 else "".join(rng.choices("klmnop ", k=400)) for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", lookup.words_in("t", words).alias("w")).collect():
        assert r["w"] == [w for w in words if w in r["t"]]
