import math
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factpanel.llm import quality, queries


def brute(text):
    text = text or ""
    words, windows = re.findall(r"[^\x20\x09-\x0D]+", text), {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "#", "|", " ", "\n", "\t", "\x0b", "\x1c", "\u0085", "\xa0", "a b a b a", "\n\n"]), max_size=80).map("".join))
def test_counts(text):
    assert quality.count(text)[:5] == brute(text)


def test_repeats_with_many_different_words():
    rng = random.Random(2)
    words = [str(rng.randrange(9000)) for _ in range(30_000)] + ["x"] * 7
    text = " ".join(words + words[100:140])
    assert quality.count(text)[:5] == brute(text)


def binomial(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_upper_bound_is_exact():
    for k, n, d in ((0, 10, 0.05), (3, 50, 0.01), (7, 400, 0.003), (49, 50, 0.1)):
        p = quality.upper_bound(k, n, d)
        assert abs(binomial(k, n, p) - d) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_upper_bound_of_many_labels_is_quick():
    at = time.time()
    for k, n in ((5_000, 1_000_000), (200_000, 100_000_000)):
        p = quality.upper_bound(k, n, 0.001)
        sd = math.sqrt(k) / n
        assert k / n + 3 * sd < p < k / n + 3.3 * sd
    assert time.time() - at < 2


def brute_kept(docs, labels, alpha=0.02, delta=0.05, weight=20.0):
    """The verdicts by plain sums: (id, text, stratum) and (id, quality), ids and labels without contradictions."""
    marks, shares, failed = dict(labels), {}, {}
    for i, text, stratum in docs:
        c = brute(text)
        lines = max(1, sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")))
        n = max(1, c[0])
        shares[i] = [min(400, math.floor(v * 100)) for v in (c[2] / n, c[3] / lines, c[4] / n, c[1] / n / 20)]
        failed[i] = c[0] < 10 or 100 * c[4] > 20 * c[0]
    strata = {s for i, _, s in docs if i in marks and not failed[i]}
    tests, cut = 4 * len(strata), {}
    for s in strata:
        ids = [i for i, _, x in docs if x == s and i in marks and not failed[i]]
        n = sum(marks[i] for i in ids)
        for rule in range(4):
            best = 0.0
            for b in sorted({shares[i][rule] for i in ids} - {0}, reverse=True):
                k = sum(marks[i] for i in ids if shares[i][rule] >= b)
                caught = sum(not marks[i] for i in ids if shares[i][rule] >= b)
                limit = alpha / 4
                if k >= n or k / n > limit or binomial(k, n, limit) > delta / tests:  # the bound is above the limit
                    break
                if caught - weight * k > best:
                    best, cut[s, rule] = caught - weight * k, b
    return {i: not failed[i] and not any(shares[i][r] >= cut.get((s, r), 10**9) for r in range(4)) for i, _, s in docs}


def test_verdicts_against_plain_sums(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(9000):
        words = [f"w{rng.randrange(3000)}" for _ in range(30)]
        bad = rng.random() < 0.3
        for j in range(rng.choice([0, 0, 0, 1, 9, 14]) if bad else rng.choice([0] * 60 + [1, 2, 5])):
            words[j] += "#" * rng.randint(1, 2)
        text = " ".join(words) + ("\nsame line\nsame line" if rng.random() < (0.4 if bad else 0.001) else "")
        docs.append((i, text, rng.choice(["en", "en", "en", "de", None])))
        if i % 10:
            labels.append((i, int(not bad)))
    want = brute_kept(docs, labels)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("limit_stratum", F.lit("?")).withColumn("q_n_words", F.lit("?"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame, marks).collect()}
    assert got == want and 500 < sum(not k for k in want.values()) < 4000
    assert {r["doc_id"] for r in quality.keep(frame, marks).collect()} == {i for i in want if want[i]}


def test_cutoffs_never_pass_the_bound():
    rng = random.Random(3)
    for _ in range(200):
        bins = sorted(rng.sample(range(0, 60), 12))
        good = [rng.randrange(0, 2000) if b < 20 else rng.randrange(0, 6) for b in bins]
        bad = [rng.randrange(0, 200) for _ in bins]
        n = sum(good)
        cut = quality.allowed_cutoff(bins, good, bad, n, 0.01, 0.001, 5.0)
        if cut is not None:
            k = sum(g for b, g in zip(bins, good, strict=True) if b >= cut)
            assert quality.upper_bound(k, n, 0.001) <= 0.01 and cut > 0
    assert quality.allowed_cutoff([5], [0], [50], 10, 0.01, 0.001, 5.0) is None  # ten labels prove nothing


def corpus(spark, n=6000):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(40)]
        junk = i % 5 == 0
        if junk:
            words = [w + "##" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else "fr", 1))
        labels.append((i, int(not junk), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_cutoffs_reject_junk_and_keep_the_good(spark):
    docs, labels = corpus(spark)
    out = quality.judge(docs, labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in out}
    assert all(kept[i] for i in range(6000) if i % 5) and not any(kept[i] for i in range(6000) if i % 5 == 0)
    stage = quality.keep(docs, labels)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == {i for i in kept if kept[i]}


def test_query_against_plain_python(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op4_quality(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r[c] for c in quality.COUNTS[:-1]] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1), (5, None), (6, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    out = quality.judge(odd_documents, labels).collect()
    assert len(out) == odd_documents.count()
    assert all(r["kept"] is not None and r["base_failed"] is not None for r in out)
    kept = quality.keep(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.schema == odd_documents.schema
    assert quality.judge(no_documents, labels).count() == 0 and quality.keep(no_documents, labels.where("false")).count() == 0
