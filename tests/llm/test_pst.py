"""Suffix tree scores: counts against brute force, distributions that sum to 1, held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdraft.llm import pst
from sparkdraft.llm.folds import held_out_of
from sparkdraft.llm.words import string_buffers
from tests.llm import plain_tree

import pyarrow as pa


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def plain_base(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    n, v = sum(count.values()), len(count)
    return [
        (d, h, len(words(t)), sum(count[w] > 0 for w in words(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t)))
        for (d, t), h in zip(rows, held)
    ]


def corpus(n=150, seed=3):
    """Texts of a second-order rule over few words, and rare words."""
    random = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        out = ["the", "cat"]
        for _ in range(random.randint(0, 120)):
            a, b = zlib.crc32(out[-2].encode()) % 7, zlib.crc32(out[-1].encode()) % 5
            out.append(f"w{(a * 3 + b + (random.rand() < 0.1) * random.randint(0, 9)) % 11}" if random.rand() < 0.95 else f"rare{random.randint(0, 10**6)}")
        rows.append((i, random.choice([" ", "\n"]).join(out).title()))
    return rows


def scores(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "key": F.lit("k"), "_row": F.lit(0)})
    return pst.score_texts(spark, df, held_out_of("doc_id", 7, 2), **options).collect()


def matches(got, want):
    key = lambda r: repr(tuple(r)[:5])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r["base_score"] for r in got], [w[5] for w in want], rtol=1e-9)


def test_base_matches_brute_force_and_model_gains(spark, monkeypatch):
    monkeypatch.setattr(pst, "HEAD_SHARE", 1e-3)  # so that some words are rare
    rows = corpus()
    got = scores(spark, rows)
    matches(got, plain_base(rows))
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)  # log probabilities


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (16, "never seen"), (5, "É É " * 40_000), (6, " \t\n")]
    got = scores(spark, rows)
    matches(got, plain_base(rows))
    assert all(r["score"] <= 0 for r in got)


def test_empty_and_untrained(spark):
    assert scores(spark, []) == []
    only = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    assert [(r["train_tokens"], r["n_known"], r["score"]) for r in scores(spark, [(only, "a b")])] == [(0, 0, 0.0)]


def tree_of(spark, rows):
    df = spark.createDataFrame([(t,) for _, t in rows], "text string")
    counts = pst.word_counts(df).cache()
    return plain_tree.learn(spark, counts, df)


def test_distributions_sum_to_one(spark):
    tree = tree_of(spark, corpus())
    look = plain_tree.Lookup(tree)
    assert len(tree.parent) > 10 and max(len(k) > 0 and d for d, k in enumerate(tree.state_keys, 1)) >= 2
    every = np.arange(len(tree.words))
    for state in range(0, len(tree.parent), 7):
        known = 10 ** look.log10(np.full(len(every), state, np.int32), every)
        unknown = 10 ** look.log10(np.array([state], np.int32), np.array([-1]))[0] / (tree.n + tree.v + 1)
        assert known.sum() + unknown == pytest.approx(1, abs=1e-9)


def test_longest_suffix_is_used(spark):
    tree = tree_of(spark, corpus())
    look = plain_tree.Lookup(tree)
    text = corpus()[5][1]
    h, first = pst.tokens(*string_buffers(pa.array([text])))
    word = look.words.find(h)
    states = look.state_of(h, word, first)
    by_key = {int(k): int(i) for d in range(len(tree.state_keys)) for k, i in zip(tree.state_keys[d], tree.state_ids[d])}
    for i in range(len(h)):
        want = 0
        for d in range(1, len(tree.state_keys) + 1):
            if i >= d and (word[i - d : i] >= 0).all():
                want = by_key.get(int(plain_tree._context_keys(tree.words, word[None, i - d : i])[0]), want)
        assert states[i] == want


def test_hash_index():
    random = np.random.RandomState(1)
    keys = np.unique(random.randint(0, 2**62, 5000).astype(np.uint64))
    keys[0] = 0
    index = pst.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(2**62)) == -1).all()
    assert (pst.HashIndex(keys[:0]).find(keys) == -1).all()


def tree_scores(spark, rows):
    """Scores by the tree in memory."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    tree = tree_of(spark, [r for r, h in zip(rows, held) if not h])
    look = plain_tree.Lookup(tree)
    out = []
    for _, text in rows:
        h, first = pst.tokens(*string_buffers(pa.array([text])))
        word = look.words.find(h)
        out.append(look.log10(look.state_of(h, word, first), word).sum() - (word < 0).sum() * math.log10(tree.n + tree.v + 1))
    return out


@pytest.mark.parametrize("share, bits", [(1e-6, 27), (1e-2, 27), (1e-2, 8), (2.0, 12)])
def test_joined_scores_match_the_tree_in_memory(spark, monkeypatch, share, bits):
    monkeypatch.setattr(pst, "HEAD_SHARE", share)
    monkeypatch.setattr(pst, "BITS", bits)  # few bits: wrong positives, which must not count
    rows = corpus(100)
    got = {r["doc_id"]: r["score"] for r in scores(spark, rows)}
    assert np.allclose([got[d] for d, _ in rows], tree_scores(spark, rows), rtol=1e-9)


def test_keys_meet_by_blocks(spark, monkeypatch):
    rows = corpus(60) + [(None, "a b"), (700, "")]
    held_out = held_out_of("doc_id", 7, 2)
    for name, value in (("HEAD_SHARE", 2.0), ("BLOCK_BYTES", 1 << 11), ("_FLUSH", 1 << 8)):
        monkeypatch.setattr(pst, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert pst.block_bits(df.select("text")) >= 2
    plan = pst.score_texts(spark, df, held_out)
    kept = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in kept and "Generate" not in kept  # no row for each key of a text
    got = {r["doc_id"]: r["score"] for r in plan.collect()}
    assert len(got) == len(rows) and np.allclose([got[d] for d, _ in rows], tree_scores(spark, rows), rtol=1e-9)


def test_a_context_counts_at_any_size_of_the_corpus(spark):
    ids = [d for d in range(100) if zlib.crc32(str(d).encode()) % 7 != 2][:12]
    only = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    rows = [(ids[0], "some filler of words " * 200_000), *[(d, "ruby falcon") for d in ids[1:]], (only, "ruby falcon")]
    held = next(r for r in scores(spark, rows) if r["held_out"])
    assert held["score"] > held["base_score"] + 4  # falcon and the end are sure after ruby, 11 times in 800 000 tokens


def test_a_task_holds_few_occurrences_at_a_time(spark, monkeypatch):
    """Words are counted chunk by chunk, and a row of contexts holds no more than some hundred thousand."""
    assert pst._FLUSH <= 1 << 19
    sizes, plain = [], pst._counted
    monkeypatch.setattr(pst, "_counted", lambda parts: sizes.append(sum(map(len, parts))) or plain(parts))
    run = []
    monkeypatch.setattr(pst, "_FLUSH", 1 << 10)

    class Texts:
        def mapInArrow(self, f, _):
            run.append(f)
            return spark.createDataFrame([], "key long, n long")

    texts = ["some Words " * 30_000, *[f"x{i} some" for i in range(100_000)], None, ""]
    pst.word_counts(Texts())
    out = list(run[0](iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])] * 2)))
    got = Counter()
    for batch in out:
        got.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
    assert sum(got.values()) == 2 * (60_000 + 200_000 + len(texts)) and len(got) == 100_003
    assert len(sizes) == 4 and max(sizes) < 1 << 19  # a batch at once before: 2 counts


def test_ids_of_a_row_are_runs(spark):
    for ids in ([5], list(range(7, 3000)), [1, 2, 3, 9, 10, 40, 41, 42], [0, 1 << 33, (1 << 33) + 1]):
        steps = np.diff(np.array(ids, np.int64), prepend=0)
        step, times = pst._unpacked(pa.scalar(pst._packed(pst._runs(steps)), pa.binary()), np.int64).reshape(2, -1)
        assert np.cumsum(np.repeat(step, times)).tolist() == ids and len(step) <= 2 + 2 * int((steps > 1).sum())
    assert pst.BLOCK_BYTES <= 1 << 22  # of a block's rows a task holds several copies, in Spark and in Python


def made(node, name):
    """Rows that the named node of an executed plan has made."""
    while node.nodeName() == "AdaptiveSparkPlan" or "QueryStage" in node.nodeName():
        node = node.plan() if "QueryStage" in node.nodeName() else node.executedPlan()
    below = [node.children().apply(i) for i in range(node.children().size())]
    return (node.longMetric("pythonNumRowsReceived").value() if node.nodeName() == name else 0) + sum(made(x, name) for x in below)


def test_a_block_gives_a_row_for_each_piece(spark, monkeypatch):
    """Not for each text: such rows grow with texts times blocks."""
    rows = corpus(200)
    monkeypatch.setattr(pst, "HEAD_SHARE", 2.0)
    monkeypatch.setattr(pst, "BLOCK_BYTES", 1 << 11)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = 1 << pst.block_bits(df.select("text"))
    plan = pst.score_texts(spark, df, held_out_of("doc_id", 7, 2))
    got = {r["doc_id"]: r["score"] for r in plan.collect()}
    assert np.allclose([got[d] for d, _ in rows], tree_scores(spark, rows), rtol=1e-9)
    assert blocks >= 16 and len(rows) < made(plan._jdf.queryExecution().executedPlan(), "FlatMapCoGroupsInArrow") <= len(rows) + blocks


def test_blocks_of_the_scoring_grow_with_the_square_root():
    assert [pst.score_bits(b) for b in (0, 3, 6, 8, 10, 12, 14)] == [0, 3, 6, 7, 8, 9, 10]


def test_a_run_adds_as_an_entry_and_as_a_state():
    keys = np.array([9, -4, 9, 7, 7], np.int64)
    got = pst._merged(keys, np.array([0.5, 1.0, 2.0, -0.25, 4.0]), np.array([False, True, True, False, False]))
    assert [x.tolist() for x in got] == [[-4, 7, 9], [1.0, 0.0, 2.0], [0.0, 3.75, 0.5]]
    assert [len(x) for x in pst._merged(keys[:0], np.zeros(0), np.zeros(0, bool))] == [0, 0, 0]


def test_more_texts_than_a_piece_holds(spark, monkeypatch):
    monkeypatch.setattr(pst, "HEAD_SHARE", 2.0)
    rows = [(d, f"w{d % 50} w{d % 7}" if d % 3 else None) for d in range(70_000)]
    df = spark.range(0, 70_000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, null, concat('w', id % 50, ' w', id % 7))").alias("text"))
    matches(pst.score_texts(spark, df, held_out_of("doc_id", 7, 2)).collect(), plain_base(rows))
