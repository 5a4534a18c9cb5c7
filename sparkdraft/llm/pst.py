"""Language-model scores by a probabilistic suffix tree over words.

Tokens are the words of a text, A-Z lower-cased, and one end per text.

*Counts* of all training tokens are gathered by Spark: every word, and level
by level every pair of a candidate context (one word, then two, ...) and its
next token. A context is a candidate from ``CONTEXT_MIN`` occurrences on, a next
token is listed from ``ENTRY_MIN`` on, at any size of the corpus. Occurrences that
cannot reach these counts, because a shorter part does not, are left out
before the shuffle by bitmaps of fixed size; a wrong positive costs a row, the
counts that decide are exact.

*Retention*: a context becomes a state if the Kullback-Leibler divergence of
its next-token distribution from that of its longest retained suffix is at
least ``DIVERGENCE`` nats.

*Smoothing*: absolute discounting, interpolated with the longest retained
suffix; the root is the add-one unigram distribution over the V known words
and one unknown symbol. All distributions sum to 1.

*Scoring*: a token is scored by the state of the longest suffix of what stands
before it in the text. States and entries are tables of (key, value): a state
adds the logarithm of its weight, an entry what it gains over the weighted
distribution of the parent, a word its count, so the score of a text is a sum
over keys. A run of words is looked up once, as an entry and as the state of the
token after it: only a text's last token, its end, has none after it, and no run
with an end is a state. Keys above ``HEAD_SHARE`` of the training tokens are broadcast (at
most ``1 / HEAD_SHARE`` a table); all others meet the tables by key, none of
which is frequent: a task packs its keys by ranges of the hash (*blocks*, whose
number grows with the corpus), a block's keys and its part of the tables are grouped together.
What a block adds to the texts of a *piece*, a task's keys packed at once, comes back as one row; the
rows of a piece are summed together. Contexts are counted by blocks too, one for about ``BLOCK_BYTES`` of text.

Words are identified by 64-bit hashes. Defined results: null or empty text is
the end token alone; a null doc_id is not held out; repeated rows are texts of
their own; extra columns are ignored; an empty table gives no rows; without
training tokens every token has probability 1.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkdraft.llm.store import discard, shuffles_removed, stored, worker_cache
from sparkdraft.llm.words import signed, string_buffers, text_chunks, word_hashes

DEPTH = 3
HEAD_SHARE = 1e-6
CONTEXT_MIN = 8
ENTRY_MIN = 2
#: Bitmaps have 16 bits a key, and no more than 2**BITS.
BITS = 28
DIVERGENCE = 0.02
DISCOUNT = 0.5
END = np.uint64(0x454E445F4F465F54)
#: Occurrences that a task counts at a time: some 100 bytes each while they are sorted and packed.
_FLUSH = 1 << 19
#: Bytes of text for each block of keys.
BLOCK_BYTES = 1 << 22


class HashIndex:
    """Positions of 64-bit keys, by open addressing; all operations on whole arrays."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.zeros(size, dtype=np.uint64)
        self.at = np.full(size, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), keys & self.mask
        while len(left):
            s = slot[left].astype(np.int64)
            free = self.at[s] < 0
            self.keys[s[free]] = keys[left[free]]
            self.at[s[free]] = left[free]  # of several the last stays; the others go on
            left = left[self.at[s] != left]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 if it is not there."""
        slot = (keys & self.mask).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.at[slot], -1)
        left = np.flatnonzero((out < 0) & (self.at[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            s = slot[left]
            hit = (self.at[s] >= 0) & (self.keys[s] == keys[left])
            out[left[hit]] = self.at[s[hit]]
            left = left[~hit & (self.at[s] >= 0)]
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the texts, each with its end, and the first index of each text."""
    h, first = word_hashes(data, offsets, lower=True)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def _chunks(batch: pa.RecordBatch, column: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch.column(column))
    for lo, hi in text_chunks(offsets):
        yield lo, hi, *tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, n): training count of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A chunk's words are counted at once: of a task's tokens only the distinct ones are held.
        parts, size = [], 0
        for batch in batches:
            for _, _, h, _ in _chunks(batch):
                parts.append(_counted([signed(h)]))
                size += parts[-1].num_rows
                if size >= 2 * _FLUSH:
                    yield merged(parts)
                    parts, size = [], 0
        if size:
            yield merged(parts)

    def merged(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sums = pa.Table.from_batches(parts).group_by("key", use_threads=False).aggregate([("n", "sum")]).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([sums.column("key"), sums.column("n_sum")], names=["key", "n"])

    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for two bigint columns."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    seed = np.uint64(42)
    for x in (a, b):
        h = (seed + (p5 + np.uint64(8))) ^ (_rotated(x * p2, 31) * p1)
        h = _rotated(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        seed = h ^ (h >> np.uint64(32))
    return seed


def _grams(h: np.ndarray, width: int) -> list[np.ndarray]:
    """Keys of the runs of one token, of two, ... and of ``width``, by their first token. A run's
    key is the hash of the keys of the runs without its last and without its first token."""
    out = [h]
    while len(out) < width:
        out.append(_pair_hash(out[-1][:-1], out[-1][1:]))
    return out


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Bits set at the top and at the low places of each key (one bigint column)."""
    width = max(6, min(BITS, (16 * keys.count()).bit_length()))
    slots = keys.toDF("key").select(F.explode(F.array(F.shiftrightunsigned("key", 64 - width), F.col("key").bitwiseAND(F.lit((1 << width) - 1)))).alias("s"))
    words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    size = 64 * len(bits)
    out = np.ones(len(keys), dtype=bool)
    for slot in (keys >> np.uint64(65 - size.bit_length()), keys & np.uint64(size - 1)):
        out &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return out


def block_bits(texts: DataFrame) -> int:
    """Leading bits of a key that tell its block, by the size of the ``texts`` (one string column)."""
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]).cast("bigint"))).first()[0] or 0
    return max(0, (size // BLOCK_BYTES).bit_length())


def score_bits(bits: int) -> int:
    """Leading bits for the blocks of the scoring. Beyond 64 blocks of the counting their number grows with its
    square root: a piece has a row in every block, and those rows would grow with the square of the corpus."""
    return min(bits, bits // 2 + 3)


def _block_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """All first bytes, all second bytes, ...: bytes that hardly vary compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _runs(values: np.ndarray) -> np.ndarray:
    """The values without repeats in a row, then how often each is repeated: steps between texts that follow each other are two pairs."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return np.concatenate([values[starts], np.diff(np.append(starts, len(values)))])


def _merged(keys: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, what each adds as a word (0: none) and what it adds as an entry and a state."""
    order = np.argsort(keys)
    keys, values, known = keys[order], values[order], known[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(starts):
        return keys, values, values
    return keys[starts], *(np.add.reduceat(np.where(known == kind, values, 0.0), starts) for kind in (True, False))


def _slices(sorted_keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Block, start and end of each block's part of sorted keys."""
    of = _block_of(sorted_keys, bits)
    cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
        if hi > lo:
            yield int(of[lo]), lo, hi


def gram_counts(texts: DataFrame, depth: int, maps: Broadcast, bits: int) -> DataFrame:
    """(ctx, suf, n): count, if it is ``ENTRY_MIN`` or more, of every context of ``depth`` words
    with its next token, by the keys of the context and of the same run without its first
    word; only where the context may be in the first bitmap of ``maps`` and the other in the second."""

    def counted(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, ctx, suf = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, at, n = np.unique(key, return_index=True, return_counts=True)
        ctx, suf, n = ctx[at], suf[at], n.astype(np.uint32)
        rows = [(block, *(_packed(x[lo:hi]) for x in (ctx, suf, n))) for block, lo, hi in _slices(key, bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "ctx", "suf", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for _, _, h, first in _chunks(batch):
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                at = np.flatnonzero(place >= depth) - depth
                if not len(at):
                    continue
                short = _grams(h, depth)[-1]
                at = at[_in_bitmap(maps.value[0], short[at])]
                at = at[_in_bitmap(maps.value[1], short[at + 1])]
                parts.append([_pair_hash(short[at], short[at + 1]), short[at], short[at + 1]])
                size += len(at)
                if size >= _FLUSH:
                    yield counted(parts)
                    parts, size = [], 0
        if size:
            yield counted(parts)

    def added(block: pa.Table) -> pa.Table:
        ctx, suf, n = (np.concatenate([_unpacked(x, kind) for x in block.column(c)]) for c, kind in (("ctx", np.uint64), ("suf", np.uint64), ("n", np.uint32)))
        key = _pair_hash(ctx, suf)
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(n[order].astype(np.int64), starts)
        kept = n >= ENTRY_MIN
        at = order[starts[kept]]
        return pa.table([pa.array(signed(ctx[at])), pa.array(signed(suf[at])), pa.array(n[kept])], names=["ctx", "suf", "n"])

    packed = texts.mapInArrow(run, "block int, ctx binary, suf binary, n binary")
    return packed.groupBy("block").applyInArrow(added, "ctx bigint, suf bigint, n bigint")


def model_table(spark: SparkSession, counts: DataFrame, texts: DataFrame, n: int, v: int, depth: int = DEPTH, bits: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(key, value, n, known): what each word, state and entry adds to the log10 score of a
    token, and its training count; contexts that are no states have no value. Also the stored tables it reads."""
    tables = [counts.select("key", F.log10(F.col("n") + 1).alias("value"), "n", F.lit(True).alias("known"))]
    made = []
    last = counts.select("key", "n", ((F.col("n") + 1) / (n + v + 1)).alias("p"))
    for d in range(1, depth + 1):
        listed, candidates = last.filter(F.col("n") >= ENTRY_MIN), last.filter(F.col("n") >= CONTEXT_MIN)
        maps = spark.sparkContext.broadcast((_bitmap(candidates.select("key")), _bitmap(listed.select("key"))))
        grams = gram_counts(texts, d, maps, bits)
        # What is listed after a context is listed after its suffix too.
        entries = stored(spark, grams.join(listed.select(F.col("key").alias("suf"), F.col("p").alias("q")), "suf").select(F.xxhash64("ctx", "suf").alias("key"), "ctx", "n", "q"), f"entries-{d}")
        maps.destroy()
        sums = entries.groupBy("ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("q"))).alias("logs"), F.sum("n").alias("seen"), F.sum("q").alias("q"), F.count("*").alias("kinds"))
        rest_p, rest_q = F.greatest(1 - F.col("seen") / F.col("total"), F.lit(0.0)), F.greatest(1 - F.col("q"), F.lit(1e-12))
        divergence = (F.col("logs") - F.col("seen") * F.log("total")) / F.col("total") + F.when(rest_p > 0, rest_p * F.log(rest_p / rest_q)).otherwise(0.0)
        weight = (F.col("total") - F.col("seen") + DISCOUNT * F.col("kinds")) / F.col("total")
        states = stored(spark, sums.join(candidates.select(F.col("key").alias("ctx"), F.col("n").alias("total")), "ctx").select("ctx", "total", F.when(divergence >= DIVERGENCE, weight).alias("weight")), f"states-{d}")
        p = F.when(F.col("weight").isNull(), F.col("q")).otherwise((F.col("n") - DISCOUNT) / F.col("total") + F.col("weight") * F.col("q"))
        level = entries.join(states, "ctx").select("key", "n", p.alias("p"), F.log10(p / (F.col("weight") * F.col("q"))).alias("value"))
        level = stored(spark, level, f"level-{d}")
        discard(spark, entries)
        made += [states, level]
        tables += [level.select("key", "value", "n", F.lit(False)), states.select("ctx", F.log10("weight"), "total", F.lit(False))]
        last = level
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out, made


def packed_table(table: DataFrame, bits: int) -> DataFrame:
    """(block, keys, values, known): the rows (key, value, known), a task's rows of a block in one row."""

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, values, known = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(3))
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        keys, values, known = keys[order], values[order], known[order].astype(np.uint8)
        rows = [(of, _packed(np.diff(keys[lo:hi], prepend=np.uint64(0))), _packed(values[lo:hi]), known[lo:hi].tobytes()) for of, lo, hi in _slices(keys, bits)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "keys", "values", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= _FLUSH:
                yield packed(parts)
                parts, size = [], 0
        if size:
            yield packed(parts)

    return table.select("key", "value", "known").mapInArrow(run, "block int, keys binary, values binary, known binary")


def score_texts(spark: SparkSession, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the tree) of every text; the texts that are not held
    out are learned from."""
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    training = rows.filter("not held_out").select("_text")
    with shuffles_removed(spark):
        counts = stored(spark, word_counts(training), "word-counts")
        n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        block = block_bits(rows.select("_text"))
        table, made = model_table(spark, counts, training, n, v, depth, block)
        block = score_bits(block)
        valued = table.filter("value is not null")
        # With the frequent contexts that are no states, so that none of them is joined.
        head = table.filter(F.col("n") >= HEAD_SHARE * n).select("key", F.coalesce("value", F.lit(0.0)).alias("value"), "known").toArrow()
        keys, words, runs = _merged(*(head.column(c).to_numpy() for c in ("key", "value", "known")))
        model = spark.sparkContext.broadcast({"name": uuid.uuid4().hex, "bits": _bitmap(valued.select("key")), "keys": keys.view(np.uint64), "words": words, "runs": runs})
        tail = stored(spark, packed_table(valued.filter(F.col("n") < HEAD_SHARE * n), block), "tail")
        for t in (counts, *made):
            discard(spark, t)
    norm = math.log10(n + v + 1)
    id_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("suffix model", (None,))[0] != model.value["name"]:
            cache["suffix model"] = (model.value["name"], HashIndex(model.value["keys"]))
        index, bits, words, runs = cache["suffix model"][1], *(model.value[k] for k in ("bits", "words", "runs"))
        rare, size, held, piece, most = [], 0, 0, 0, np.iinfo(np.uint16).max
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, h, first in _chunks(batch, 3):
                n_texts = hi - lo
                text = np.repeat(np.arange(n_texts), np.diff(first))
                place = np.arange(len(h)) - first[text]
                sums, known, rare_keys, rare_texts = np.zeros((2, n_texts)), np.zeros(n_texts), [], []
                for d, keys in enumerate(_grams(h, depth + 1)):
                    at = np.flatnonzero(place >= d)
                    keys, of = keys[at - d], text[at]
                    may = _in_bitmap(bits, keys)
                    keys, of = keys[may], of[may]
                    at = index.find(keys)
                    here = at >= 0
                    rare_keys.append(keys[~here])
                    rare_texts.append(of[~here])
                    at, of = at[here], of[here]
                    sums[1] += np.bincount(of, runs[at], n_texts)
                    if not d:
                        # A word's count less the norm: a difference of sums would lose digits.
                        sums[0] += np.bincount(of, words[at] - norm, n_texts)
                        known += np.bincount(of, minlength=n_texts)
                sums[0] -= norm * (np.diff(first) - known)
                keys, of = np.concatenate(rare_keys), np.concatenate(rare_texts)
                for a in range(0, n_texts, most):
                    b = min(a + most, n_texts)
                    here = slice(None) if b - a == n_texts else (of >= a) & (of < b)
                    if rare and (size + len(keys[here]) > _FLUSH or held + b - a > most):
                        yield packed(piece, rare)
                        rare, size, held = [], 0, 0
                    if not rare:
                        piece = int(ids[lo + a])
                    rare.append((keys[here], of[here] - a + held))
                    yield as_batch(
                        block=pa.array((-1 - ids[lo + a : lo + b] % spread).astype(np.int32)),
                        piece=pa.array(np.full(b - a, piece)),
                        place=pa.array(np.arange(held, held + b - a, dtype=np.int32)),
                        **{"_id": batch.column(1).slice(lo + a, b - a)},
                        held_out=batch.column(2).slice(lo + a, b - a),
                        n_tokens=pa.array(np.diff(first)[a:b].astype(np.int64)),
                        n_known=pa.array(known[a:b].astype(np.int64)),
                        base_score=pa.array(sums[0, a:b]),
                        score=pa.array(sums[0, a:b] + sums[1, a:b]),
                    )
                    size, held = size + len(rare[-1][0]), held + b - a
        if size:
            yield packed(piece, rare)

    def packed(piece: int, rare: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """A row for each block: distinct keys, how often each is there, and the texts it is in."""
        keys, of = (np.concatenate(x) for x in zip(*rare, strict=True))
        order = np.argsort(keys)
        keys, of = keys[order], of[order].astype(np.uint16)
        out = {c: [] for c in ("block", "piece", "keys", "times", "texts")}
        for at, lo, hi in _slices(keys, block):
            starts = np.flatnonzero(np.append(True, keys[lo + 1 : hi] != keys[lo : hi - 1]))
            steps = np.diff(keys[lo:hi][starts], prepend=np.uint64(0))
            times = np.diff(np.append(starts, hi - lo)).astype(np.uint32)
            for c, x in zip(out, (at, piece, _packed(steps), _packed(times), _packed(of[lo:hi])), strict=True):
                out[c].append(x)
        return as_batch(**{c: pa.array(x, simple[all_kinds[c]]) for c, x in out.items()})

    kinds = {"_id": id_type, "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    places, blobs, sent = {"piece": "bigint", "place": "int"}, dict.fromkeys(("keys", "times", "texts"), "binary"), dict.fromkeys(("texts", "seen", "words", "runs"), "binary")
    all_kinds = {"block": "int"} | places | kinds | blobs | sent
    simple = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow_of = lambda fields: pa.schema([(c, to_arrow_type(rows.schema[0].dataType) if c == "_id" else simple[t]) for c, t in fields.items()])
    arrow, added = arrow_of({"block": "int"} | places | kinds | blobs), arrow_of(places | kinds | sent)

    def as_batch(schema: pa.Schema = arrow, **columns: pa.Array) -> pa.RecordBatch:
        size = len(columns["piece"])
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def valued_texts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return added.empty_table()
        if left.column("block")[0].as_py() < 0:
            return pa.Table.from_arrays([left.column(f.name) if f.name in places | kinds else pa.nulls(left.num_rows, f.type) for f in added], schema=added)
        if not right.num_rows:
            return added.empty_table()
        of_key = np.concatenate([np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in right.column("keys")])
        value = np.concatenate([_unpacked(x, np.float64) for x in right.column("values")])
        is_word = np.concatenate([_unpacked(x, np.uint8) for x in right.column("known")]) > 0
        of_key, word, run_ = _merged(of_key, value, is_word)
        out = {c: [] for c in ("piece", *sent)}
        for i in range(left.num_rows):
            keys = np.cumsum(_unpacked(left.column("keys")[i], np.uint64), dtype=np.uint64)
            at = np.minimum(np.searchsorted(of_key, keys), len(of_key) - 1)
            times, text = _unpacked(left.column("times")[i], np.uint32), _unpacked(left.column("texts")[i], np.uint16)
            found = np.repeat(of_key[at] == keys, times)
            at, text = np.repeat(at, times)[found], text[found]
            if not len(at):
                continue
            here = np.flatnonzero(np.bincount(text))
            sums = [np.bincount(text, x[at])[here] for x in (word > 0, word, run_)]
            for c, x in zip(out, (left.column("piece")[i].as_py(), *map(_packed, (_runs(np.diff(here, prepend=0)), sums[0].astype(np.uint32), *sums[1:]))), strict=True):
                out[c].append(x)
        return pa.Table.from_batches([as_batch(added, **{c: pa.array(x, simple[all_kinds[c]]) for c, x in out.items()})])

    def summed(piece: pa.Table) -> pa.Table:
        """The rows of a piece's texts with what the blocks add to them."""
        texts = piece.filter(pc.is_valid(piece.column("place")))
        place, parts = texts.column("place").to_numpy(), piece.filter(pc.is_valid(piece.column("texts"))).select(list(sent))
        sums = np.zeros((3, len(place)))
        for columns in zip(*parts.columns, strict=True):
            here, *more = (_unpacked(x, kind) for x, kind in zip(columns, (np.int64, np.uint32, np.float64, np.float64), strict=True))
            sums[:, np.cumsum(np.repeat(*here.reshape(2, -1)))] += more
        seen, word, run_ = sums[:, place]
        for c, more in (("n_known", seen.astype(np.int64)), ("base_score", word), ("score", word + run_)):
            texts = texts.set_column(texts.schema.get_field_index(c), c, pa.array(texts.column(c).to_numpy() + more))
        return texts.select(list(kinds))

    spread = 16 << block
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), "*")
    text_of = lambda fields: ", ".join(f"{c} {t}" for c, t in fields.items())
    found = numbered.mapInArrow(run, text_of({"block": "int"} | places | kinds | blobs))
    parts = found.groupBy("block").cogroup(tail.groupBy("block")).applyInArrow(valued_texts, text_of(places | kinds | sent))
    scored = parts.groupBy("piece").applyInArrow(summed, text_of(kinds))
    return scored.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
