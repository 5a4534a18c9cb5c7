"""Packing: exact ids, places without gaps, and the rule against its definition."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkdraft.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", " a b", "a b ", "a \n b", "x   y z", "a\t b  \n\n c", "<|endoftext|> it's we 'll a'll", "don't, isn't. x.'s", "e　f  g", "É é, ñ! ß", "a\x1cb c", "日本 語。x", "w1 2w,,, (y) [z]_ __q", "e\u3000\n g\u00a0 h", "\x85 a\x85", "a\n\n\nb \n c\t\td\r\ne", "\n", "a\x0bb\x0c c", "it's\n'll 'x", "x!'s y'"]


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_are_those_of_the_tokenizer():
    t, encoder = reference(), packing.TextEncoder(packing.load_tokenizer(PATH))
    texts = TEXTS * 2 + [" ".join(TEXTS), "\n".join(TEXTS)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_memory_starts_anew_and_grows(monkeypatch):
    monkeypatch.setattr(packing, "_PARTS", 300)
    t, encoder = reference(), packing.TextEncoder(packing.load_tokenizer(PATH))
    for k in range(0, 100_000, 7000):
        texts = [" ".join(f"word{i}, x{k}\n" for i in range(k, k + n)) for n in (50, 1, 200)] + [" ".join(f"w{i}" for i in range(k, k + 7000))]
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(packing, "_STRETCH", 50)
    t, encoder = reference(), packing.TextEncoder(packing.load_tokenizer(PATH))
    texts = ["  \n ".join(TEXTS) * 3, "a" * 400 + "  " * 60 + "b c " * 50, " " * 300, "é " * 200]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def plain_rule(lengths, capacity):
    """The rule by trying every open bin."""
    bins = []
    for size in lengths:
        def after(i):
            gaps = [capacity - sum(b) - (size if k == i else 0) for k, b in enumerate(bins)]
            gaps += [capacity - size] if i == len(bins) else []
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        choice = min([(after(i), capacity - sum(b), i) for i, b in enumerate(bins) if sum(b) + size <= capacity], default=(0, 0, len(bins)))
        if choice[2] == len(bins):
            bins.append([])
        bins[choice[2]].append(size)
    return sorted(map(tuple, bins))


def test_rule_matches_its_definition():
    random = np.random.RandomState(0)
    for _ in range(20):
        lengths = random.randint(1, 13, 40)
        b, place = packing.sum_of_squares(lengths, 12)
        bins = {}
        for k, size, at in zip(b.tolist(), lengths.tolist(), place.tolist()):
            assert at == sum(bins.get(k, ()))
            bins.setdefault(k, []).append(size)
        # Which of several bins of one gap is taken is open; the gaps are not.
        assert sorted(sum(x) for x in bins.values()) == sorted(sum(x) for x in plain_rule(lengths.tolist(), 12))


def check(rows, got, capacity=1024):
    t = reference()
    want = {}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((d, p, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())), []).append(1)
    seen, sequences = {}, {}
    for r in got:
        seen.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_pieces_and_sequences(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, TEXTS[3]), (50, None), (51, "long " * 5000), (52, "x " * 2047), (53, "x " * 2046)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, piece string, length int")
    sequences = check(rows, packing.pack_documents(spark, df, PATH).collect())
    total = sum(length for parts in sequences.values() for _, length in parts)
    assert len(sequences) <= -(-total // 1024) + 1


def test_shards_are_packed_together(spark):
    random = np.random.RandomState(4)
    rows = [(i, "x " * int(n)) for i, n in enumerate(random.randint(1, 1000, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = check(rows, packing.pack_documents(spark, df, PATH).collect())
    many = check(rows, packing.pack_documents(spark, df, PATH, shard_pieces=20).collect())
    assert len(many) <= 1.1 * len(one)


def test_pieces_that_fit_with_none_end_the_rounds(spark, monkeypatch):
    """No task gets more than its share, also if no round closes up anything."""
    pieces = spark.createDataFrame([(i, 600 + i % 400) for i in range(400)] + [(1000 + i, 3) for i in range(5)], "n long, length long")
    got = packing.pack_pieces(spark, pieces, shard_pieces=25).collect()
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 405 and 400 <= len(used) <= 402
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    rounds = []
    whole = packing._pack_shards
    monkeypatch.setattr(packing, "_pack_shards", lambda *a, **k: (rounds.append(a[3]), whole(*a, **k))[1])
    packing.pack_pieces(spark, pieces, shard_pieces=25)
    assert len(rounds) <= 4 and min(rounds) >= 400 // 25


def test_empty_table(spark):
    assert packing.pack_documents(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("capacity", [8, 64])
def test_other_capacities(spark, capacity):
    rows = [(i, "a b c " * i) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, packing.pack_documents(spark, df, PATH, capacity=capacity).collect(), capacity)
