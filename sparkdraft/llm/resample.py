"""Importance resampling towards a target distribution, with lines counted once.

Features are single words and pairs of neighbouring words, hashed into
buckets. Words hold no line break, so a text is cut into lines at its
newlines: the features of a line are the same wherever it stands.

1. Counting: distinct lines of all texts are grouped with their number of
   occurrences (combined before the shuffle); each is taken apart once and its
   counts are multiplied. Pairs that reach from one line into the next are no
   feature of a line and are added separately, text by text.
2. A bucket's gain is the logarithm of its smoothed share in the target over
   that in the documents, in thousandths, floored.
3. Weighing: in blocks of texts, each distinct line's sum of gains is computed
   once and looked up for all its occurrences; pairs across lines are added.
   A document's weight is the floored mean over its features. Gains are one
   number a bucket, whatever the size of the input.
4. Drawing: Gumbel noise from a hash of the id is added, and the highest
   scores of the documents with enough words are drawn, without replacement;
   ranks come from a range-partitioned sort of narrow rows.

Defined results: a null or empty text, or one without words, has no features,
weight 0, and is not drawn; a null id counts as the empty text in the noise
and comes last among equal scores; repeated rows are documents of their own,
with one noise; extra columns are ignored; empty documents give no rows, an
empty target gives weights all the same (every bucket's share is the smoothed one).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import stored, worker_cache
from sparkdraft.llm.words import string_buffers, text_chunks
from sparkdraft.operators.ordering import with_global_index

BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SEED = 7
_CHUNK = 4 << 20
#: Longer words are hashed one by one.
_LONG = 64
_POLYNOMIAL = 0xEDB88320


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of single bytes, A-Z to lower case, and which bytes are part of words."""
    got = worker_cache().get("resample")
    if got is None:
        crc = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            crc = (crc >> np.uint32(1)) ^ (crc & np.uint32(1)) * np.uint32(_POLYNOMIAL)
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 0x20
        part = np.zeros(256, dtype=bool)
        part[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
        got = worker_cache()["resample"] = (crc, lower, part)
    return got


class Words:
    """Words of some bytes, row r being data[cuts[r]:cuts[r + 1]], and hashes of their features."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        self.crc, lower, part = _tables()
        self.data = lower[data]
        inside = part[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        begins[inner] = inside[inner]
        ends[inner - 1] = inside[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: The first word of each row, and how many there are in all.
        self.first = np.searchsorted(self.starts, cuts)
        self.state = self._fed(np.full(len(self.starts), 0xFFFFFFFF, np.uint32), np.arange(len(self.starts)))

    def _fed(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """CRC registers after the bytes of words, a byte of all of them at a time, long words first."""
        size = (self.ends - self.starts)[word]
        order = np.argsort(-np.minimum(size, _LONG + 1).astype(np.int8), kind="stable")
        state, at, size = state[order], self.starts[word][order], size[order]
        long = int(np.searchsorted(-size.clip(max=_LONG + 1), -_LONG))
        for i in range(long):
            state[i] = zlib.crc32(self.data[at[i] : at[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        counts = np.bincount(size[long:], minlength=_LONG + 1)
        left = len(word) - long
        for j in range(_LONG):
            left -= int(counts[j])
            if not left:
                break
            s = slice(long, long + left)
            state[s] = self.crc[(state[s] ^ self.data[at[s] + j]) & np.uint32(255)] ^ (state[s] >> np.uint32(8))
        out = np.empty_like(state)
        out[order] = state
        return out

    def single(self, buckets: int) -> np.ndarray:
        """Bucket of every word."""
        return ((self.state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
        """Bucket of the words left[i] and right[i], joined by a space."""
        spaced = self.crc[(self.state[left] ^ np.uint32(0x20)) & np.uint32(255)] ^ (self.state[left] >> np.uint32(8))
        return ((self._fed(spaced, right) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)

    def neighbours(self) -> np.ndarray:
        """Words that have another one after them in their row."""
        last = np.zeros(len(self.starts) + 1, dtype=bool)
        last[self.first[1:] - 1] = True
        return np.flatnonzero(~last[:-1])

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


class Lines:
    """The distinct lines of a block of texts, once each, and which lines each text has."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray):
        seen: dict[bytes, int] = {}
        raw, ids, counts = data.tobytes(), [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            lines = raw[a:b].split(b"\n")
            ids += [seen.setdefault(line, len(seen)) for line in lines]
            counts.append(len(lines))
        self.lines = np.array(ids, dtype=np.int64)
        self.at = np.cumsum([0, *counts])
        sizes = np.fromiter(map(len, seen), np.int64, len(seen))
        self.words = Words(np.frombuffer(b"".join(seen), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
        self.n_words = np.diff(self.words.first)

    def summed(self, of_line: np.ndarray) -> np.ndarray:
        """Sums over the lines of each text."""
        total = np.concatenate([[0], np.cumsum(of_line[self.lines])])
        return total[self.at[1:]] - total[self.at[:-1]]

    def across(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the pairs that reach from a line into the next one that has words."""
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        some = np.flatnonzero(self.n_words[self.lines] > 0)
        line, text = self.lines[some], text[some]
        same = np.flatnonzero(text[1:] == text[:-1])
        left, right = self.words.first[line[same] + 1] - 1, self.words.first[line[same + 1]]
        return text[same], self.words.pairs(left, right, buckets)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = string_buffers(batch.column(column))
    for lo, hi in text_chunks(offsets, _CHUNK):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _listed(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def feature_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any."""
    text = docs.select(_text(text_col).alias("text"))
    lines = text.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n = batch.column(1).to_numpy()
            for lo, hi, data, cuts in _blocks(batch, 0):
                words, times = Words(data, cuts), n[lo:hi]
                left = words.neighbours()
                np.add.at(total, words.single(buckets), np.repeat(times, np.diff(words.first)))
                np.add.at(total, words.pairs(left, left + 1, buckets), times[words.row_of(left)])
        yield _listed(total)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, cuts in _blocks(batch, 0):
                total += np.bincount(Lines(data, cuts).across(buckets)[1], minlength=buckets)
        yield _listed(total)

    kind = "bucket bigint, n bigint"
    counted = lines.mapInArrow(within, kind).unionByName(text.filter(F.contains("text", F.lit("\n"))).mapInArrow(between, kind))
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """One number a bucket, on the driver."""
    out = np.zeros(buckets)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Floored thousandths of the logarithm of each bucket's smoothed share in the target over that in the documents."""
    s, t = (_collected(feature_counts(df, text_col, buckets), buckets) for df in (docs, target))
    ratios = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def target_weights(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str = "text") -> DataFrame:
    """id, n_words, n_features and weight of every document."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, cuts in _blocks(batch, 1):
                block = Lines(data, cuts)
                words, left = block.words, block.words.neighbours()
                # Sums of a line are differences of running sums over all words.
                of_word = gains[words.single(buckets)]
                of_word[left] += gains[words.pairs(left, left + 1, buckets)]
                running = np.concatenate([[0], np.cumsum(of_word)])
                total = block.summed(running[words.first[1:]] - running[words.first[:-1]])
                text, bucket = block.across(buckets)
                np.add.at(total, text, gains[bucket])
                n = block.summed(block.n_words)
                features = n + np.maximum(n - 1, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (n, features, total // np.maximum(features, 1)))], names=["id", "n_words", "n_features", "weight"])

    found = docs.select(F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("text"))
    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def drawn(spark: SparkSession, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features, weight, score and rank (from 1; null if not
    drawn) of every document: ``share`` hundredths of those with enough words."""
    weights = target_weights(docs, bucket_gains(docs, target, text_col, buckets), id_col, text_col)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(spark, weights.withColumn("score", F.col("weight") + noise), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    most = share * able.count() // 100
    placed = with_global_index(able, [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < most, F.col("place") + 1)).drop("place")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).withColumnRenamed("id", id_col)


# CRC-32 (reflected polynomial EDB88320) of half bytes.
_HALF_BYTES = """0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108"""

#: Every distinct feature is hashed by half bytes of its UTF-8, the low half of a byte first.
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 't', item_id, coalesce(text, '') FROM benchmark),
words AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
distinct_features AS (SELECT f, hex(encode(f)) AS x FROM features GROUP BY f),
hashed AS (
  SELECT f, xor(list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(0, len(x)::BIGINT), lambda i: (instr('0123456789ABCDEF', x[i + 2 - 2 * (i % 2)]) - 1)::BIGINT)),
      lambda c, d: xor([{_HALF_BYTES}][(xor(c, d) & 15) + 1]::BIGINT, c >> 4)), 4294967295::BIGINT) % {BUCKETS} AS b
  FROM distinct_features),
placed AS (SELECT side, id, b FROM features JOIN hashed USING (f)),
counted AS (
  SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM placed GROUP BY b),
totals AS (SELECT sum(s)::DOUBLE AS total_s, sum(t)::DOUBLE AS total_t FROM counted),
gains AS (
  SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (total_s + {BUCKETS}) / ((s + 1)::DOUBLE * (total_t + {BUCKETS}))))::BIGINT AS gain FROM counted, totals),
summed AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM placed JOIN gains USING (b) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT words.id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
    coalesce((total - ((total % n + n) % n)) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || words.id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN summed ON words.id = summed.id WHERE side = 'd'),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, {SHARE} * count(*) OVER () // 100 AS most
  FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT scored.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
  CASE WHEN rank <= most THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
