"""The range join against all pairs."""

import numpy as np
import pytest

from factpanel.llm import embeddings, queries


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for size in {len(v) for _, v in rows if usable(v)}:
        of = [i for i, (_, v) in enumerate(rows) if usable(v) and len(v) == size]
        x = np.array([rows[i][1] for i in of], float)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, hit in enumerate(x @ x.T >= threshold):
            for b in np.flatnonzero(hit):
                if a != b:
                    links[of[a]] += 1
                    p, q = sorted((root(of[a]), root(of[b])))
                    parent[q] = p
    least = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[root(i)] = min(least.get(root(i), vec_id), vec_id)
    return sorted(((vec_id, links[i], least.get(root(i)), vec_id == least.get(root(i))) for i, (vec_id, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).tolist() for _ in range(400)]
    for k, c in enumerate(rng.normal(size=(4, 8))):  # groups from tight to loose
        vectors += (c + rng.normal(size=(150, 8)) * (0.05 + 0.07 * k)).tolist()
    vectors += [vectors[0]] * 30 + [vectors[450]] * 5
    vectors += [None, [], [0.0] * 8, [1.0, None] + [1.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1e300] * 8, [2e300] * 8, [1e-300] * 8, [-0.0, 1.0], [0.0, 4.0], [3.0]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    rows = list(zip(ids, vectors, strict=True))
    rows[5], rows[600] = (None, rows[5][1]), (None, rows[600][1])
    rows += [rows[420], (None, [5.0, 5.0, 5.0])]
    return rows


@pytest.mark.parametrize("block,pivots", [(4096, 1024), (64, 16), (16, 40)])
def test_equals_all_pairs(spark, odd, block, pivots, monkeypatch):
    monkeypatch.setattr(embeddings, "COPIES", 10)
    df = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    got = embeddings.near_duplicates(df, block=block, pivots=pivots).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd)


def test_threshold_and_names(spark):
    at = [(1, [1.0, 0.0], "x"), (2, [0.9, (1 - 0.81) ** 0.5], "x"), (3, [0.8, 0.6], "x"), (4, [-1.0, 0.0], "x")]
    df = spark.createDataFrame(at, "n long, v array<double>, vec_id string")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, id_col="n", vector_col="v").collect()}
    want = [sum(embeddings.exact_cosine(np.array(a[1]), np.array(b[1])) >= 0.9 for b in at) - 1 for a in at]
    assert [got[i] for i in (1, 2, 3, 4)] == want
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, id_col="n", vector_col="v", threshold=0.5).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
    with pytest.raises(ValueError):
        embeddings.near_duplicates(df, id_col="n", vector_col="v", threshold=1.0)


def test_nothing_to_join(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(empty).count() == 0
    none = spark.createDataFrame([(1, None), (None, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(none).collect()), key=str) == [(1, 0, 1, True), (None, 0, None, True)]


def test_query_matches_all_pairs(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op12_embeddings(spark, data).collect()), key=str) == brute(rows)
