"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds
the vectors of its letters, the j-th cyclically shifted by j: their product,
place by place. A text's profile bundles (adds) the vectors of its n-grams,
a language's prototype those of its labelled texts; a text gets the language
of the largest cosine between profile and prototype.

Letters are what Unicode calls letters, lower-cased; every run of other
characters is one gap, a symbol of its own, so that word ends count.

Defined results: a null text or one without a letter is ``und`` with score 0;
rows with a null lang or null text teach nothing; a null id is kept; ties go to the
language that comes first in order; repeated rows count as often as they
stand; extra columns are ignored; without any labelled text all is ``und``; an
empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import worker_cache
from sparkdraft.llm.words import text_chunks

DIM = 1024
ORDER = 3
UNDETERMINED = "und"
#: Most languages that a model may hold; prototypes are LANGUAGES x DIM numbers at most.
LANGUAGES = 2_000
#: Documents whose profiles are formed in one matrix product, and n-grams in it.
_ROWS, _COLUMNS = 128, 1 << 13
_GAP = 0


def _symbols() -> np.ndarray:
    """Symbol of every code point: itself for a letter, else the gap."""
    cache = worker_cache()
    if "letters" not in cache:
        table = np.zeros(0x110000, dtype=np.int32)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L"]] = 1
        cache["letters"] = table * np.arange(0x110000, dtype=np.int32)
    return cache["letters"]


def letter_vector(symbol: int, dim: int) -> np.ndarray:
    """The random vector of a letter or the gap; depends on nothing else."""
    bits = np.unpackbits(np.frombuffer(np.random.RandomState(symbol + 1).bytes(dim // 8), dtype=np.uint8))
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dim: int) -> np.ndarray:
    """Vectors of n-grams, given as rows of symbols: the bound letter vectors."""
    cache = worker_cache().setdefault(("letter vectors", dim), {})
    symbols, place = np.unique(grams, return_inverse=True)
    for s in symbols.tolist():
        if s not in cache:
            if len(cache) > 20_000:
                cache.clear()
            cache[s] = letter_vector(s, dim)
    base = np.stack([cache[s] if s in cache else letter_vector(s, dim) for s in symbols.tolist()])
    place = place.reshape(grams.shape)
    bound = base[place[:, -1]].copy()
    for j in range(1, grams.shape[1]):
        bound *= np.roll(base, j, axis=1)[place[:, -1 - j]]
    return bound


def grams_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, gram, text): the distinct n-grams of the texts as rows of symbols, and per
    occurrence its gram and its text. ``order`` is 3 or more. A text without a letter has none."""
    codes = _symbols()[np.frombuffer("\x00".join(["", *[t.lower() for t in texts], ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(t.lower()) for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts) + 1), np.append(lengths + 1, 1))
    # One gap for a run of other characters; the separators are gaps, too.
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _GAP) | (codes[:-1] != _GAP)
    # A separator before a text belongs to the text; keep it where the text before ended in a gap.
    codes, text = codes[keep], text[keep]
    if len(codes) < order:
        return np.zeros((0, order), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols, at = np.unique(codes, return_inverse=True)
    n = len(symbols)
    key = at[: len(at) - order + 1].astype(np.int64)
    for j in range(1, order):
        key = key * n + at[j : len(at) - order + 1 + j]
    # Grams that reach into the next text hold a gap inside; all with a gap inside are left out.
    inner = np.ones(len(key), dtype=bool)
    for j in range(1, order - 1):
        inner &= codes[j : len(key) + j] != _GAP
    key, text = key[inner], text[1 : len(inner) + 1][inner]
    if n**order <= 1 << 22:
        seen = np.zeros(n**order, dtype=np.int64)
        seen[key] = 1
        distinct = np.flatnonzero(seen)
        seen[distinct] = np.arange(len(distinct))
        gram = seen[key]
    else:
        distinct, gram = np.unique(key, return_inverse=True)
    rows = np.empty((len(distinct), order), dtype=np.int32)
    for j in range(order - 1, -1, -1):
        rows[:, j] = symbols[distinct % n]
        distinct = distinct // n
    return rows, gram, text


def bundles(texts: list[str], dim: int, order: int) -> np.ndarray:
    """Profiles of the texts, one row each; counts times vectors, block by block."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for lo in range(0, len(texts), _ROWS):
        part = texts[lo : lo + _ROWS]
        grams, gram, text = grams_of(part, order)
        counts = np.bincount(text * max(1, len(grams)) + gram, minlength=len(part) * len(grams)).reshape(len(part), -1).astype(np.float32) if len(grams) else np.zeros((len(part), 0), np.float32)
        for at in range(0, len(grams), _COLUMNS):
            out[lo : lo + _ROWS] += counts[:, at : at + _COLUMNS] @ gram_vectors(grams[at : at + _COLUMNS], dim).astype(np.float32)
    return out


def _text_blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    """About a megabyte of texts at a time."""
    lengths = np.array([len(t) if t else 0 for t in batch.column(column).to_pylist()], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    for lo, hi in text_chunks(offsets):
        yield lo, hi, [t or "" for t in batch.column(column).slice(lo, hi - lo).to_pylist()]


def prototypes(labelled: DataFrame, dim: int = DIM, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and their prototypes from rows (lang, text).

    Each batch of texts is bundled by language where it is read; only sums of
    ``dim`` numbers per language and batch are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi, texts in _text_blocks(batch, 1):
                grams, gram, text = grams_of(texts, order)
                if not len(grams):
                    continue
                names, of = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                counts = np.bincount(of[text] * len(grams) + gram, minlength=len(names) * len(grams)).reshape(len(names), -1).astype(np.float64)
                for at in range(0, len(grams), _COLUMNS):
                    part = counts[:, at : at + _COLUMNS] @ gram_vectors(grams[at : at + _COLUMNS], dim).astype(np.float64)
                    for name, total in zip(names.tolist(), part, strict=True):
                        sums[name] = sums[name] + total if name in sums else total
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "sums"])

    found = (
        labelled.filter("lang is not null and text is not null")
        .select("lang", "text")
        .mapInArrow(run, "lang string, sums array<bigint>")
        .select("lang", F.posexplode("sums"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("s"))
    )
    langs = [r[0] for r in found.select("lang").distinct().orderBy("lang").limit(LANGUAGES + 1).collect()]
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    matrix = np.zeros((len(langs), dim))
    table = found.toArrow()  # at most LANGUAGES x dim numbers
    if len(langs):
        row = np.searchsorted(np.array(langs, dtype=object), np.array(table.column("lang").to_pylist(), dtype=object))
        matrix[row, table.column("pos").to_numpy()] = table.column("s").to_numpy()
    return langs, matrix


def identify(spark: SparkSession, docs: DataFrame, langs: list[str], matrix: np.ndarray, keep: list[str], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The ``keep`` columns with lang_pred and score, the cosine with that language's prototype (0 if negative)."""
    dim, norms = matrix.shape[1], np.linalg.norm(matrix, axis=1)
    unit = (matrix / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
    model = spark.sparkContext.broadcast((list(langs), unit))
    inner = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototype = model.value
        for batch in batches:
            k = batch.num_columns - 1
            for lo, hi, texts in _text_blocks(batch, k):
                profile = bundles(texts, dim, order)
                size = np.linalg.norm(profile, axis=1)
                pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if names:
                    cosine = profile @ prototype.T / np.where(size > 0, size, 1)[:, None]
                    best = cosine.argmax(axis=1)
                    score = np.where(size > 0, np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0), 0.0).astype(np.float64)
                    pred = [names[b] if s > 0 else UNDETERMINED for b, s in zip(best.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in range(k)], pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:k], "lang_pred", "score"])

    return inner.mapInArrow(run, f"{kinds}, lang_pred string, score double")

