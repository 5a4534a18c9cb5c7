"""Language profiles against a plain bundle of vectors, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from sparkdraft.llm import langid
from sparkdraft.llm.folds import held_out_of
from tests.conftest import SF_SMALL


def plain_profile(text, dim=256, order=3):
    symbols, out = [0], np.zeros(dim)
    for ch in (text or "").lower():
        s = ord(ch) if ch.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    for i in range(len(symbols) - order + 1):
        gram = symbols[i : i + order]
        if 0 in gram[1:-1]:
            continue
        v = np.ones(dim)
        for j, s in enumerate(reversed(gram)):
            v = v * np.roll(langid.letter_vector(s, dim), j)
        out += v
    return out


TEXTS = ["Hello, World!", "", "123 !!", "é à", "a", "Straße ab", "  x  ", "日本語 text", "İstanbul", "a" * 5000, "\x00b\x00", "no\nnew   line"]


def test_profiles_match_plain_bundles():
    got = langid.bundles(TEXTS, 256, 3)
    for row, text in zip(got, TEXTS):
        assert np.array_equal(row, plain_profile(text)), text


def test_many_grams_in_blocks(monkeypatch):
    monkeypatch.setattr(langid, "_COLUMNS", 7)
    monkeypatch.setattr(langid, "_ROWS", 2)
    assert np.array_equal(langid.bundles(TEXTS, 256, 3), np.stack([plain_profile(t) for t in TEXTS]))


def test_prototypes_are_sums(spark):
    rows = [("xx", "aba cab"), ("yy", "zuz"), ("xx", "bab"), (None, "aba"), ("yy", None), ("zz", "...")]
    langs, matrix = langid.prototypes(spark.createDataFrame(rows, "lang string, text string"), dim=256)
    assert langs == ["xx", "yy"]
    assert np.array_equal(matrix[0], plain_profile("aba cab") + plain_profile("bab"))
    assert np.array_equal(matrix[1], plain_profile("zuz"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("held", held_out_of("doc_id", 4, 2))
    langs, matrix = langid.prototypes(docs.filter("not held"))
    got = langid.identify(spark, docs, langs, matrix, ["doc_id", "lang", "held"]).filter("held and length(lang) > 0").select("lang", "lang_pred", "score").collect()
    assert len(got) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "the cat", "en"), (3, "12 34", "fr"), (4, "le chat", "fr"), (4, "le chat", "fr"), (5, "z" * 300_000, None)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, _text double").drop("_text")
    langs, matrix = langid.prototypes(docs)
    got = langid.identify(spark, docs, langs, matrix, ["doc_id"]).select(F.coalesce("doc_id", F.lit(-1)), "lang_pred").collect()
    assert sorted(map(tuple, got))[:-1] == [(-1, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "fr")]


def test_nothing_learned_or_nothing_there(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    langs, matrix = langid.prototypes(docs)
    assert langs == []
    assert [tuple(r) for r in langid.identify(spark, docs, langs, matrix, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    empty = docs.limit(0)
    assert langid.identify(spark, empty, *langid.prototypes(empty), ["doc_id"]).count() == 0
