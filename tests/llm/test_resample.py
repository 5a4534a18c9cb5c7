"""Importance resampling against counting every feature of every text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from sparkdraft.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, buckets=10_000, share=25, least=20):
    s, t = (Counter(bucket(f, buckets) for _, text in rows for f in features(text)) for rows in (docs, target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        fs = features(text)
        weight = sum(gain[bucket(f, buckets)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(WORD.findall((text or "").translate(LOWER))), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=repr)


def found(spark, docs, target, **options):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.drawn(spark, make(docs), make(target), **options)
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)


def corpus(seed, n):
    random = np.random.RandomState(seed)
    lines = [" ".join(f"{random.choice(['Wort', 'mot', 'É', 'x'])}{k}" for k in random.randint(0, 30, random.randint(0, 12))) for _ in range(40)]
    return [(i, random.choice(["\n", "\n\n", "\n - \n", "\r\n"]).join(lines[k] for k in random.randint(0, 40, random.randint(1, 12)))) for i in range(n)]


def test_matches_counting_every_feature(spark):
    docs, target = corpus(1, 80), corpus(2, 10)
    want = plain(docs, target)
    assert found(spark, docs, target) == want
    assert sum(r[-1] is not None for r in want) > 10


def test_few_buckets_and_other_shares(spark):
    docs, target = corpus(3, 40), corpus(4, 6)
    assert found(spark, docs, target, buckets=7, share=60, least_words=5) == plain(docs, target, 7, 60, 5)


def test_odd_rows(spark):
    long = "\n".join(f"t{i % 977} u{i % 13}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, "\n\n"), (None, "w " * 30), (4, long), (5, "É" * 100_000), (6, "a\x00b\x7fC d-e f"), (7, "w " * 30), (7, "w " * 30), (8, "x\n" * 25), (9, "y" * 200 + " z " * 24)]
    docs += [(None, "ß " * 22)]
    target = [(1, "w w x"), (2, None)]
    assert found(spark, docs, target, share=70) == plain(docs, target, share=70)


def test_empty_tables_and_clashing_columns(spark):
    docs = corpus(5, 12)
    assert found(spark, docs, []) == plain(docs, [])
    assert found(spark, [], docs) == []
    df = spark.createDataFrame([(1, "a b " * 20, 7, 8, 9)], "doc_id long, text string, id long, weight int, line int")
    assert resample.drawn(spark, df, df).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_hashes_of_words_and_pairs():
    text = "aB Cé x9 " + "q" * 70 + " " + "r" * 64 + " s"
    words = resample.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    names = WORD.findall(text.translate(LOWER))
    assert words.single(10_000).tolist() == [bucket(w, 10_000) for w in names]
    left = words.neighbours()
    assert words.pairs(left, left + 1, 10_000).tolist() == [bucket(f"{a} {b}", 10_000) for a, b in zip(names, names[1:])]


def test_query(spark):
    from sparkdraft.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key, "text").collect()]
    want = plain(rows("documents", "doc_id"), rows("benchmark", "item_id"))
    got = QUERIES["op13_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((r[0], *r[2:]) for r in want), key=repr)
