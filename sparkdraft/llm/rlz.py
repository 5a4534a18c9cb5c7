"""Substring deduplication by joins of hashed windows, which stand in for a relative
Lempel-Ziv parse: no document is factored from left to right.

The reference is the corpus itself, in blocks of words around *anchors*. The
anchor of a window (``window`` consecutive words) is the word k-gram in it with
the smallest hash, so equal windows share their anchor at the same place.
Consecutive windows with one anchor form a block; its content is hashed whole.

1. The index holds, for every anchor seen more than once, whether all its
   blocks are equal.
2. The blocks of all documents are joined with it. Where all blocks of an anchor
   are equal, or the block itself occurs again, all its windows are repeats;
   where an anchor is unknown, none is.
3. Blocks that share an anchor but differ hold the ends of repeats. One of each
   distinct block is taken apart and its windows are looked up one by one.
4. Runs of repeated windows that touch are merged into factors; factors of at least ``window`` words become duplicate spans.

The result is exact up to hash odds (a window is identified by 128 bits over
64-bit word hashes): a word is in a span if and only if a window over it
occurs at another place too, in the same document or elsewhere. The key of a
text is 96 bits of hash; documents with one text share their spans.

Defined results: null or empty text, or one of fewer words than a window, has
no spans; null ids stay; repeated rows are documents of their own, so they are
duplicates of each other; extra columns are carried or ignored, as stated; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import stored
from sparkdraft.llm.words import _mix, _powers, signed, string_buffers, text_chunks, window_hashes, word_hashes

WINDOW = 35
ANCHOR = 8
_ANCHOR_BASE, _BLOCK_BASE, _WINDOW_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def blocks_of(h: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Blocks of the texts whose word hashes are ``h``, text t from ``first[t]``:
    text number, anchor hash, block hash, first and last window (counted in the text)."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none, none
    grams = window_hashes(h, anchor, _ANCHOR_BASE)
    # Hash above, place below: the leftmost of the smallest.
    ranked = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(ranked, window - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    i = np.arange(len(at))
    i = i[i + window <= first[1:][text[i]]]
    if not len(i):
        return none, none, none, none, none
    new = np.ones(len(i), dtype=bool)
    new[1:] = (at[i[1:]] != at[i[:-1]]) | (i[1:] != i[:-1] + 1)
    starts = np.flatnonzero(new)
    i0, i1 = i[starts], i[np.append(starts[1:], len(i)) - 1]
    power, inverse = _powers(_BLOCK_BASE, len(h) + 1)
    prefix = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power[: len(h)], out=prefix[1:])
    body = (prefix[i1 + window] - prefix[i0]) * inverse[i0]
    shape = ((at[i0] - i0) * 4096 + (i1 - i0)).astype(np.uint64)
    t = text[i0]
    return t, signed(grams[at[i0]]), signed(_mix(_mix(body) + shape)), i0 - first[t], i1 - first[t]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` and _text, _k1, _k2."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn("_text", text).withColumns({"_k1": F.xxhash64("_text"), "_k2": F.hash("_text")})


def _count_blocks(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, c, n): anchors and blocks, counted batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            for lo, hi in text_chunks(offsets):
                h, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                _, a, c, _, _ = blocks_of(h, first, window, anchor)
                order = np.lexsort((c, a))
                a, c = a[order], c[order]
                new = np.ones(len(a), dtype=bool)
                new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
                starts = np.flatnonzero(new)
                n = np.diff(np.append(starts, len(a)))
                yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(c[starts]), pa.array(n.astype(np.int64))], names=["a", "c", "n"])

    return texts.mapInArrow(run, "a bigint, c bigint, n bigint")


def _list_blocks(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(a, c, _k1, _k2, i0, i1) of every block of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            for lo, hi in text_chunks(offsets):
                h, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                t, a, c, i0, i1 = blocks_of(h, first, window, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, c, k1[lo + t], k2[lo + t], i0.astype(np.int32), i1.astype(np.int32))], names=["a", "c", "_k1", "_k2", "i0", "i1"])

    return texts.select("_text", "_k1", "_k2").mapInArrow(run, "a bigint, c bigint, _k1 bigint, _k2 int, i0 int, i1 int")


def _windows_of(texts: DataFrame, window: int) -> DataFrame:
    """(w1, w2, _k1, _k2, i, n): the windows of the listed blocks, column ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            for t in range(batch.num_rows):
                h, _ = word_hashes(data[offsets[t] : offsets[t + 1]], offsets[t : t + 2] - offsets[t])
                blocks = batch.column(3)[t].values
                i0, i1 = (blocks.field(f).to_numpy() for f in ("i0", "i1"))
                size = i1 - i0 + 1
                i = np.repeat(i0 - np.cumsum(size) + size, size) + np.arange(size.sum())
                n = np.repeat(blocks.field("n").to_numpy(), size)
                w = [signed(window_hashes(h, window, base)[i]) for base in (_WINDOW_BASE, _ANCHOR_BASE)]
                k1, k2 = (np.repeat(batch.column(k)[t].as_py(), len(i)) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([*map(pa.array, w), pa.array(k1, pa.int64()), pa.array(k2, pa.int32()), pa.array(i.astype(np.int32)), pa.array(n, pa.int64())], names=["w1", "w2", "_k1", "_k2", "i", "n"])

    return texts.select("_text", "_k1", "_k2", "blocks").mapInArrow(run, "w1 bigint, w2 bigint, _k1 bigint, _k2 int, i int, n bigint")


def repeated_windows(spark: SparkSession, keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_k1, _k2, i0, i1): runs of windows that occur elsewhere too, by text key."""
    texts = keyed.select("_text", "_k1", "_k2")
    index = (
        _count_blocks(keyed.select("_text"), window, anchor)
        .groupBy("a")
        .agg(F.sum("n").alias("n"), (F.min("c") != F.max("c")).alias("mixed"))
        .filter("n > 1")
        .select("a", "mixed")
    )
    found = stored(spark, _list_blocks(texts, window, anchor).join(stored(spark, index, "anchors"), "a"), "blocks")
    mixed = found.filter("mixed")
    distinct = stored(spark, mixed.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("_k1", "_k2", "i0", "i1")).alias("one")), "distinct-blocks")
    listed = distinct.groupBy("one._k1", "one._k2").agg(F.collect_list(F.struct("one.i0", "one.i1", "n")).alias("blocks"))
    # Several documents can have the text of a key; its windows count once.
    windows = stored(spark, _windows_of(texts.join(listed, ["_k1", "_k2"]), window).groupBy("w1", "w2", "_k1", "_k2", "i").agg(F.max("n").alias("n")), "windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).filter("all > 1").select("w1", "w2")
    single = windows.filter("n = 1").join(again, ["w1", "w2"]).select("_k1", "_k2", F.col("i").alias("i0"), F.col("i").alias("i1"))
    whole = mixed.join(distinct.filter("n > 1").select("a", "c"), ["a", "c"]).select("_k1", "_k2", "i0", "i1")
    return found.filter("not mixed").select("_k1", "_k2", "i0", "i1").unionByName(whole).unionByName(single)


def factors(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """(first word, number of words) of the factors that the runs of windows
    (first, last) make up: runs that overlap or touch are one."""
    out: list[list[int]] = []
    for i0, i1 in sorted(runs):
        if out and i0 <= out[-1][1]:
            out[-1][1] = max(out[-1][1], i1 + window)
        else:
            out.append([i0, i1 + window])
    return [(a, b - a) for a, b in out]


def without_repeats(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The ``keep`` columns with n_words, spans (first word, words) of the duplicate
    factors, n_removed and kept, the words left joined by one space."""
    keyed = _keyed(docs.select(*dict.fromkeys([*keep, text_col])), text_col)
    runs = repeated_windows(spark, keyed, window, anchor).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("i0", "i1")).alias("_runs"))
    joined = keyed.join(runs, ["_k1", "_k2"], "left").select(*keep, "_text", "_runs")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(batch.num_columns - 2))
            raw, runs = data.tobytes(), batch.column(batch.num_columns - 1)
            n_words, spans, removed, kept = [], [], [], []
            for t in range(batch.num_rows):
                words = raw[offsets[t] : offsets[t + 1]].split()
                n_words.append(len(words))
                own = [(r["i0"], r["i1"]) for r in runs[t].as_py() or ()]
                own = factors(own, window)
                left, at = [], 0
                for start, length in own:
                    left += words[at:start]
                    at = start + length
                left += words[at:]
                spans.append([{"start": a, "length": b} for a, b in own])
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*batch.schema.names[:-2], "n_words", "spans", "n_removed", "kept"])

    return joined.mapInArrow(run, f"{kinds}, n_words bigint, spans array<struct<start: bigint, length: bigint>>, n_removed bigint, kept string")
