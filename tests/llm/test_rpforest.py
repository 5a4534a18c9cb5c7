"""Forest search: exact scores and order, recall against brute force, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from sparkdraft.llm import rpforest


def brute(rows, every, k):
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = (x * x[q]).sum(axis=1) / (norm * norm[q])
            order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
            out[ids[q]] = [(ids[i], s[i]) for i in order]
    return out


def found(spark, rows, every, k, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, vec int, k1 int")
    out = {}
    for r in rpforest.nearest(spark, df, F.col("vec_id") % every == 0, k, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(n, dim=16, seed=0):
    return [(i, x.tolist()) for i, x in enumerate(np.random.RandomState(seed).standard_normal((n, dim)).astype(np.float32))]


def test_small_tables_are_searched_whole(spark):
    rows = vectors(300)
    got, want = found(spark, rows, 25, 5), brute(rows, 25, 5)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12) for q in want)


def test_recall_with_few_leaves_opened(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "BLOCK", 50)  # leaves and queries in parts
    rows = vectors(3000)
    got, want = found(spark, rows, 20, 5, leaf=100), brute(rows, 20, 5)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    exact = {q: dict(x) for q, x in brute(rows, 20, 3000).items()}
    assert all(abs(s - exact[q][v]) < 1e-12 for q, x in got.items() for v, s in x)


def test_equal_vectors_and_ties(spark):
    rows = vectors(40) + [(100 + i, [1.0] * 16) for i in range(60)] + [(300, [2.0] * 16)]
    got = found(spark, rows, 50, 5)
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]
    assert [v for v, _ in got[150]] == [100, 101, 102, 103, 104]
    assert [v for v, _ in got[300]] == [100, 101, 102, 103, 104]


def test_odd_rows(spark):
    good = vectors(6, 4)
    odd = [(None, [1.0] * 4), (50, None), (51, [0.0] * 4), (52, [1.0, None, 1.0, 1.0]), (53, [float("nan")] * 4), (54, [float("inf")] * 4), (55, [1.0] * 3), (56, []), (0, good[0][1])]
    got = found(spark, good + odd, 50, 5)
    assert set(got) == {0}
    assert [v for v, _ in got[0]] == [v for v, _ in brute(good, 50, 5)[0]]


def test_empty_and_single(spark):
    assert found(spark, [], 50, 5) == {}
    assert found(spark, [(0, [1.0, 2.0])], 50, 5) == {}
