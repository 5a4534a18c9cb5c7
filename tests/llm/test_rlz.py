"""Repeated windows against counting every window."""

import re
from collections import Counter

import numpy as np

from sparkdraft.llm import rlz


def plain(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rlz.without_repeats(spark, df, ["doc_id"], **options).collect()
    for r in got:
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=repr)


def corpus(seed, n=40, vocabulary=60):
    random = np.random.RandomState(seed)
    passages = [[f"p{i}x{j}" for j in random.randint(0, 9, random.randint(20, 90))] for i in range(6)]
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in random.randint(0, vocabulary, random.randint(0, 200))]
        for _ in range(random.randint(0, 3)):
            p = passages[random.randint(0, 6)]
            a, b = sorted(random.randint(0, len(p) + 1, 2))
            at = random.randint(0, len(words) + 1)
            words[at:at] = p[a:b]
        rows.append((i, random.choice([" ", "\n", "  "]).join(words)))
    return rows


def test_matches_counting_all_windows(spark):
    rows = corpus(1) + [(100, corpus(1)[3][1]), (101, corpus(1)[3][1])]
    assert found(spark, rows) == plain(rows, 35)


def test_small_windows_and_repeats_within_a_text(spark):
    rows = corpus(2, 15, 4) + [(50, "a b " * 30), (51, "a " * 100)]
    assert found(spark, rows, window=6, anchor=2) == plain(rows, 6)


def test_odd_rows(spark):
    long = " ".join(f"t{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (None, "x y z"), (3, long), (4, "É" * 100_000), (5, "one " * 34), (6, corpus(1)[0][1]), (6, corpus(1)[0][1]), (None, corpus(1)[0][1])]
    assert found(spark, rows) == plain(rows, 35)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rlz.without_repeats(spark, df, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, n_words long, a int")
    assert [tuple(r)[:1] for r in rlz.without_repeats(spark, df, ["doc_id"]).collect()] == [(1,)]


def test_factors_are_greedy_and_apart():
    assert rlz.factors([(40, 40), (0, 3), (5, 5), (200, 200)], 35) == [(0, 75), (200, 35)]
