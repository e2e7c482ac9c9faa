import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factpanel.llm import queries, substring

VOCABULARY = [f"w{i}" for i in range(4000)]


def best_chain_value(x, y, width, cost):
    value = [0.0] * len(x)
    for i in range(len(x)):
        best = 0.0
        for j in range(i):
            if x[j] < x[i] and y[j] < y[i]:
                best = max(best, value[j] - cost * (x[i] - x[j] + y[i] - y[j]))
        value[i] = width + best
    return max(value)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40, unique=True))
def test_fenwick_chain_is_the_best_chain(points):
    points = sorted(points)
    x, y = (np.array([p[i] for p in points], np.int64) for i in range(2))
    found = substring.chain(x, y, 5, 0.1)
    for path in found:
        assert (np.diff(x[path]) > 0).all() and (np.diff(y[path]) > 0).all()
    assert sorted(int(i) for p in found for i in p) == list(range(len(points)))  # each match in one chain
    first = found[0]
    got = 5 * len(first) - 0.1 * float((x[first[-1]] - x[first[0]]) + (y[first[-1]] - y[first[0]]))
    rising = (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
    if not rising:  # rising matches are taken whole and cut at long gaps later
        assert abs(got - best_chain_value(x.tolist(), y.tolist(), 5, 0.1)) < 1e-9


def test_word_hashes_name_words(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["a", "B", "é", "\u0085", "\xa0", " ", "\n", "\x0b", "cc", "D d"]) for _ in range(5000))
    words = text.encode().lower().split()
    whole = substring.word_hashes(text)
    known = {}
    assert len(whole) == len(words) and all(known.setdefault(w, h) == h for w, h in zip(words, whole.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(substring, "BLOCK", 64)  # the same hashes when a text is read in blocks
    assert substring.word_hashes(text).tolist() == whole.tolist()
    long = "x" * 300 + " y " + "z" * 70
    assert len(substring.word_hashes(long)) == 3 and substring.word_hashes(None).tolist() == []


def test_seeds_cover_every_window():
    rng = random.Random(1)
    words = substring.word_hashes(" ".join(rng.choices(VOCABULARY, k=3000)))
    h = substring.shingle_hashes(words)
    at = substring.winnow(h)
    assert len(h) == 2996 and np.diff(at).max() <= substring.WINDOW and at[0] < substring.WINDOW
    assert len(substring.winnow(substring.shingle_hashes(substring.word_hashes("a " * 500)))) <= 2
    assert len(substring.winnow(substring.shingle_hashes(substring.word_hashes("a b c")))) == 0


def test_texts_worked_on_as_one_have_the_seeds_of_each(spark, monkeypatch):
    """Words, seeds and runs don't reach from one text into the next, however texts are put together."""
    rng = random.Random(27)
    texts = [None, "", " ", "a b", "a b c d e", "é b", "c"] + [" ".join(rng.choices(VOCABULARY[: rng.choice([2, 4000])], k=rng.randint(1, 90))) for _ in range(200)] + ["x " * 4000, " y", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) - 1)), pa.array(texts)[1:]], names=["doc", "text"])
    for size in (1, 300, 1 << 17):
        monkeypatch.setattr(substring, "ROWS_BLOCK", size)
        seen, blocks = [], 0
        for ids, n_words, w in substring._blocks([batch]):
            h, text, at = substring._seeds_of(n_words, w, substring.WIDTH, substring.WINDOW)
            ends, blocks = np.cumsum(n_words), blocks + 1
            runs = substring.run_hashes(w, at, 16, ends[text], substring.run_sums(w))
            for i, doc in enumerate(ids.tolist()):
                own, mine = substring.word_hashes(texts[doc + 1]), text == i
                shingles = substring.shingle_hashes(own)
                want = substring.winnow(shingles)
                assert n_words[i] == len(own) and w[ends[i] - n_words[i] : ends[i]].tolist() == own.tolist()
                assert (at[mine] - (ends[i] - n_words[i])).tolist() == want.tolist() and h[mine].tolist() == shingles[want].tolist()
                assert runs[mine].tolist() == substring.run_hashes(own, want, 16).tolist()
            seen += ids.tolist()
        assert seen == list(range(len(texts) - 1))
    assert blocks == 1  # 209 texts at once
    frame = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)], "doc long, text string, text_sha256 string")
    assert {r["doc"]: r["n_words"] for r in substring.with_counts(frame).collect()} == {i: None if t is None else len(t.split()) for i, t in enumerate(texts)}


def test_alignment_of_shifts_and_changes():
    rng = random.Random(2)
    a = np.array([rng.randrange(10**6) for _ in range(200)], np.int32)
    b = np.concatenate([a[:50], [1, 2, 3], a[50:120], a[125:200]]).astype(np.int32)
    b[30] = 7
    x = np.array([5, 40, 60, 130, 190], np.int64)
    to = substring.align(a, b, x, np.where(x < 50, x, np.where(x < 120, x + 3, x - 2)))
    want = [i if i < 50 else i + 3 if i < 120 else i - 2 if i >= 125 else -1 for i in range(200)]
    want[30] = -1
    assert to.tolist() == want
    assert substring.similar_parts(to) == [(0, 200, 0, 198, 194)]


def words(rng, n):
    return rng.choices(VOCABULARY, k=n)


def noisy(rng, passage, rate):
    out = []
    for w in passage:
        if rng.random() < rate:
            out.append(rng.choice(VOCABULARY))
        else:
            out.append(w)
    return out


def test_planted_passages(spark):
    rng = random.Random(3)
    passages = [words(rng, rng.randint(55, 200)) for _ in range(40)]
    rows, holders = [], {i: [] for i in range(40)}
    for doc in range(400):
        body = []
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(40)
            body += words(rng, rng.randint(5, 200))
            at = len(body)
            body += noisy(rng, passages[k], 0.04) if doc % 3 == 0 else passages[k]
            holders[k].append((doc, at, len(body)))
        rows.append((doc, " ".join(body + words(rng, rng.randint(1, 300)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substring.passages(frame).collect()
    assert sorted(map(str, found)) == sorted(map(str, substring.passages(frame, broadcast_ids=3).collect()))
    spans = {}
    for r in found:
        assert r["source_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8 and r["end_word"] - r["start_word"] >= 40
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    planted, caught = 0, 0
    for places in holders.values():
        for doc, start, end in sorted(places)[1:]:
            if doc == sorted(places)[0][0]:
                continue
            planted += 1
            caught += any(min(e, end) - max(s, start) >= 0.8 * (end - start) for s, e in spans.get(doc, []))
    assert planted > 200 and caught >= 0.97 * planted
    clean = {d for d, _ in rows} - {d for places in holders.values() for d, _, _ in places}
    assert not clean & set(spans)


def overlap(rows, doc, source, start, end):
    """The largest share of a document's words from start to end in one passage that the source has."""
    spans = [(r["start_word"], r["end_word"]) for r in rows if (r["doc_id"], r["source_doc_id"]) == (doc, source)]
    return max([(min(e, end) - max(s, start)) / (end - start) for s, e in spans], default=0)


def test_passages_with_many_changes(spark):
    rng, rows, planted = random.Random(11), [], []
    for k in range(150):
        p = words(rng, 60)
        rows.append((2 * k, " ".join(words(rng, 30) + p + words(rng, 30))))
        q = noisy(rng, p, rng.uniform(0.10, 0.15))
        changed = [i for i in range(60) if p[i] != q[i]]
        if len(changed) <= 9:  # a similarity of 0.85
            planted.append(2 * k + 1)
        rows.append((2 * k + 1, " ".join(words(rng, 50) + q + words(rng, 50))))
    found = substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    caught = sum(overlap(found, d, d - 1, 50, 110) >= 0.8 for d in planted)
    assert len(planted) > 100 and caught >= 0.97 * len(planted), (caught, len(planted))


#: Plans that deal out a document's chains in different ways.
PLANS = [
    {},
    {"spark.sql.autoBroadcastJoinThreshold": "-1"},
    {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"},
    {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"},
]


def under(spark, plan, f):
    before = {k: spark.conf.get(k, None) for k in plan}
    try:
        for k, v in plan.items():
            spark.conf.set(k, v)
        return f()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tails_beyond_a_passage_in_every_plan(spark):
    """60 words in a first document, with a tail in a second, with the tail changed at every fourth word in a third."""
    rng, rows, thirds = random.Random(21), [], []
    for k in range(20):
        p, tail = words(rng, 60), words(rng, 30)
        changed = [rng.choice(VOCABULARY) if i % 4 == 3 else w for i, w in enumerate(tail)]
        for i, body in enumerate((p, p + tail, p + changed)):
            rows.append((3 * k + i, " ".join(words(rng, 25) + body + words(rng, 25))))
        thirds.append(3 * k + 2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    results = [under(spark, plan, lambda: sorted(map(str, substring.passages(frame).collect()))) for plan in PLANS]
    assert all(r == results[0] for r in results[1:])
    assert len(set(results[0])) == len(results[0])
    covered = {d: set() for d in thirds}
    for r in substring.passages(frame).collect():
        if r["doc_id"] in covered:
            covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    assert all(len(c & set(range(25, 115))) >= 88 for c in covered.values())


def test_no_passage_within_another():
    rng = random.Random(22)
    rows = [(1, a, a + rng.randint(1, 12), rng.randint(1, 3), 0, 5, 5, 1.0) for a in rng.choices(range(20), k=300)]
    want = {r for r in rows if not any(o[1] <= r[1] and r[2] <= o[2] and ((o[1], o[2]) != (r[1], r[2]) or o[3:] < r[3:]) for o in rows)}
    for _ in range(5):
        rng.shuffle(rows)
        kept = substring.Passages()
        for r in rows:
            kept.add(r)
        assert set(kept.rows) == want and len(kept.rows) == len(want)


def test_covering_passages():
    rng = random.Random(25)
    for _ in range(200):
        kept = substring.Passages()
        for a in rng.choices(range(60), k=rng.randint(1, 25)):
            kept.add((1, a, a + rng.randint(1, 15), rng.randint(1, 3), 0, 5, 5, 1.0))
        out = substring.covering(kept.rows)
        words_of = lambda rows: {i for r in rows for i in range(r[1], r[2])}
        assert words_of(out) == words_of(kept.rows) and set(out) <= set(kept.rows)
        assert all(words_of(out) - words_of([o]) != words_of(out) or len(out) == 1 for o in out)
        assert all(a[1] < b[1] and a[2] < b[2] for a, b in zip(out, out[1:]))
        assert all(a[2] < c[1] for a, c in zip(out, out[2:]))  # no third one meets the first


def test_repeated_words_give_few_passages(spark):
    """Documents of one pair of words again and again: all of it is found, by about one passage for each stretch."""
    rng = random.Random(26)
    rows = [(i, " ".join(words(rng, 30) + ["aa", "bb"] * (23 if i == 0 else 200) + words(rng, 30))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    results = [under(spark, plan, lambda: sorted(map(tuple, substring.passages(frame).collect()))) for plan in PLANS]
    assert all(r == results[0] for r in results[1:])
    for d in range(1, 12):
        mine = [r for r in results[0] if r[0] == d]
        assert len({i for r in mine for i in range(r[1], r[2])} & set(range(30, 430))) >= 396 and len(mine) < 30


def test_cuts_at_the_longest_stretch():
    def plain(to, similarity=0.8, least=40):
        equal, out = np.flatnonzero(to >= 0), []
        todo = [(0, len(equal))]
        while todo:
            s, e = todo.pop()
            at = equal[s:e]
            if e <= s or max(at[-1] + 1 - at[0], to[at[-1]] + 1 - to[at[0]]) < least:
                continue
            n, m = int(at[-1] + 1 - at[0]), int(to[at[-1]] + 1 - to[at[0]])
            if 2 * (e - s) >= similarity * (n + m):
                if n >= least:
                    out.append((int(at[0]), int(at[-1]) + 1, int(to[at[0]]), int(to[at[-1]]) + 1, e - s))
                continue
            middle = s + int((np.diff(at) + np.abs(np.diff(to[at]))).argmax()) + 1
            todo += [(s, middle), (middle, e)]
        return sorted(out)

    rng = np.random.default_rng(4)
    for rate in (0.3, 0.6, 0.75, 0.9):
        for n in (50, 400):
            to = np.where(rng.random(n) < rate, np.arange(n) + 7 * (np.arange(n) > n // 2), -1)
            assert substring.similar_parts(to) == plain(to)
    began = time.time()
    assert substring.similar_parts(np.where(np.arange(200_000) % 3 == 0, np.arange(200_000), -1)) == []
    assert time.time() - began < 10


def test_seeds_are_counted_alike_by_groups(spark):
    rng = random.Random(23)
    shared = words(rng, 60)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 300) + shared * (i % 3))) for i in range(30)], "doc long, text string").repartition(4)
    assert {tuple(r) for r in substring.repeated_seeds(docs).collect()} == {tuple(r) for r in substring.repeated_seeds(docs, n_words=1 << 50).collect()}


def test_hot_seeds_beyond_the_listed_ones_are_dealt_out_too(spark, monkeypatch):
    rng = random.Random(24)
    p = words(rng, 60)
    rows = [(i, " ".join(words(rng, 40) + p + words(rng, 20))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring, "HOT_SEEDS", 3)
    found = substring.passages(frame, hot=5).collect()
    for d in range(1, 40):
        assert {i for r in found if r["doc_id"] == d for i in range(r["start_word"], r["end_word"])} >= set(range(40, 100))


def test_one_seed_in_the_middle_of_a_passage(spark):
    rng = random.Random(12)
    p = words(rng, 44)
    q = [w if i % 6 != 5 or 18 < i < 24 else "other" for i, w in enumerate(p)]  # every sixth word changed
    rows = [(1, " ".join(words(rng, 60) + p)), (2, " ".join(q + words(rng, 60)))]
    one = spark.createDataFrame([(2, 19, 1, 79)], "doc long, pos int, source long, at int")  # the match of one seed
    found = substring.chains(one).collect()
    assert [(r["x"], r["y"], r["ya"] <= 60) for r in found] == [([[19]], [[79]], True)]
    assert overlap(substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 2, 1, 0, 44) >= 0.9


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    rng, rows, planted = random.Random(13), [], []
    for k in range(60):
        cuts = [(0, 18, 36, 54), (0, 25, 50, 75), (0, 35, 55), (0, 39, 55)][k % 4]
        p = words(rng, cuts[-1])
        parts = [p[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)][: 1 if len(cuts) == 3 else 3]
        for part in parts:  # each in a document of its own
            rows.append((len(rows), " ".join(words(rng, 30) + part + words(rng, 30))))
        planted.append((10_000 + k, 20_000 + k, len(p)))
        rows += [(doc, " ".join(words(rng, 30) + p + words(rng, 30))) for doc in (10_000 + k, 20_000 + k)]
    found = substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(overlap(found, c, b, 30, 30 + n) == 1 for b, c, n in planted)


def test_bitmap_lets_all_its_seeds_through(spark):
    rng = random.Random(14)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 400))) for i in range(20)], "doc long, text string")
    every = {(r["h"], r["doc"], r["pos"]) for r in substring.seeds(docs).collect()}
    some = {h for h, _, _ in rng.sample(sorted(every), 300)}
    only = substring.bitmap(spark.createDataFrame([(h,) for h in some], "h long"))
    got = {(r["h"], r["doc"], r["pos"]) for r in substring.seeds(docs, only=only).collect()}
    assert {x for x in every if x[0] in some} <= got < every and len(got) < len(some) + 0.2 * len(every)
    assert substring.bitmap(docs.selectExpr("doc as h"), 3) is None


def test_repeated_seeds_are_counted(spark):
    rng = random.Random(15)
    shared = words(rng, 60)
    docs = spark.createDataFrame([(i, " ".join(words(rng, 300) + shared * (i % 3))) for i in range(30)] + [(30, None), (31, "")], "doc long, text string").repartition(4)
    docs_of, places = {}, {}
    for r in substring.seeds(docs).collect():
        docs_of.setdefault(r["h"], set()).add(r["doc"])
        places[r["h"]] = places.get(r["h"], 0) + 1
    want = {(h, len(d), places[h]) for h, d in docs_of.items() if len(d) > 1}
    for chunk in (1, 200, 1 << 20):
        assert {tuple(r) for r in substring.repeated_seeds(docs, chunk=chunk).collect()} == want and len(want) > 20


def test_partners_are_the_first_and_the_one_before():
    h = np.array([7] * 6 + [9] * 2)
    doc, pos = np.array([5, 1, 3, 3, 5, 4, 8, 8]), np.array([2, 9, 4, 6, 1, 3, 0, 5])
    none = np.ma.MaskedArray(np.zeros(8, np.int64), True)
    run = np.ma.MaskedArray(np.array([1, 2, 1, 0, 0, 2, 3, 3]), [0, 0, 0, 1, 1, 0, 0, 0])
    got = set(map(tuple, substring.partners(h, h * 0, doc, pos, [none]).tolist()))
    assert got == {(3, 4, 1, 9), (3, 6, 1, 9), (4, 3, 1, 9), (4, 3, 3, 4), (5, 1, 1, 9), (5, 1, 4, 3), (5, 2, 1, 9), (5, 2, 4, 3)}
    assert set(map(tuple, substring.partners(h, h * 0, doc, pos, [run]).tolist())) == got | {(5, 2, 3, 4)}


def test_hot_seeds_are_dealt_out(spark):
    """With seeds of more than two places dealt out, each document with the passage still has an earlier one."""
    rng = random.Random(16)
    p = words(rng, 60)
    rows = [(i, " ".join(words(rng, 40) + p + words(rng, 20))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for hot in (2, 20, 1000):
        found = substring.passages(frame, hot=hot).collect()
        assert {r["doc_id"] for r in found} == set(range(1, 60)) and all(r["source_doc_id"] < r["doc_id"] for r in found)
        for d in range(1, 60):
            covered = {i for r in found if r["doc_id"] == d for i in range(r["start_word"], r["end_word"])}
            assert covered >= set(range(40, 100))


def test_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(17)
    p, z = words(rng, 90), words(rng, 90)
    rows = [(1, " ".join(p), "a"), (2, " ".join(p), "b"), (2, " ".join(z), "c"), (2, " ".join(z), "d"), (3, " ".join(words(rng, 5) + z), "e"), (None, " ".join(z), "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    for n in (1, 5):
        out = {r["doc"]: r["text"].split() for r in substring.without_passages(frame.repartition(n)).collect()}
        assert out == {"a": p, "b": [], "c": z, "d": z, "e": rows[4][1].split()[:5], "f": z}
    found = substring.passages(frame).collect()
    assert sorted((r["doc_id"], r["source_doc_id"]) for r in found) == [(2, 1), (3, 2)] and all(r["text_sha256"] for r in found)


def test_run_hashes_name_runs():
    words = substring.word_hashes("a b c a b c a b")
    h = substring.run_hashes(words, np.arange(8), 3)
    assert h.mask.tolist() == [False] * 6 + [True] * 2
    assert h[:3].tolist() == h[3:6].tolist() and len(set(h[:3].tolist())) == 3


def test_first_document_keeps_the_passage(spark):
    rng = random.Random(4)
    p = words(rng, 80)
    texts = {3: words(rng, 20) + p, 5: p + words(rng, 30), 9: words(rng, 10) + p + words(rng, 10) + p, 2: words(rng, 50)}
    df = spark.createDataFrame([(i, "\n ".join(t), 0, "?") for i, t in texts.items()], "doc_id long, text string, n_chars int, start string")
    out = {r["doc_id"]: r for r in substring.without_passages(df).collect()}
    assert out[2]["text"].split() == texts[2] and out[3]["text"].split() == texts[3] and out[3]["n_chars"] == 0
    assert out[5]["text"].split() == texts[5][80:] and out[9]["text"].split() == texts[9][:10] + texts[9][90:100]
    assert out[5]["n_chars"] == len(out[5]["text"])


def test_cut_words():
    assert substring.cut_words("a  b\nc d", [(1, 3)]) == "a  d"
    assert substring.cut_words("a b c", [(0, 2), (1, 3)]) == ""
    assert substring.cut_words("a b c ", [(2, 9)]) == "a b "


def test_odd_rows(spark, odd_documents, no_documents):
    found = substring.passages(odd_documents).collect()
    assert [(r["doc_id"], r["source_doc_id"]) for r in found] == []
    kept = substring.without_passages(odd_documents)
    assert kept.schema == odd_documents.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd_documents.collect()))
    assert substring.passages(no_documents).count() == 0 and substring.without_passages(no_documents).count() == 0
    rng = random.Random(5)
    p = " ".join(words(rng, 100))
    rows = [(1, p), (1, p), (2, p), (2, p), (None, p), (3, p + " " + "z " * 100_000)]
    found = substring.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in found) == [(2, 1, 0, 100), (3, 1, 0, 100)]


def test_query_finds_what_exact_runs_show(spark, data):
    """Every run of 60 words that a document shares with an earlier one is in a found passage."""
    documents = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    spans = {}
    for r in queries.op6_substring(spark, data).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    first = {}
    for doc, text in documents:
        tokens = (text or "").encode().lower().split()
        for i in range(len(tokens) - 59):
            holder = first.setdefault(tuple(tokens[i : i + 60]), doc)
            if holder != doc:
                assert any(s <= i + 12 and i + 48 <= e for s, e in spans.get(doc, [])), (doc, i)
