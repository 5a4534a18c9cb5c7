"""Runs of periodic words, found by internal pattern matching.

A run of a text is a stretch of consecutive words whose smallest period q
makes words q apart identical, which no neighbouring word extends, and which
is long enough (``least`` words and ``repeats`` periods). Per block of texts:

1. Suffixes are sorted by their first 8, 16, 32, ... words (by ranks of the
   two halves), as far as their beginning occurs again in the same text. At
   every length L, the suffixes that begin alike are an interval of the array.
2. Each dyadic block (L words from a multiple of L) asks a wavelet tree over
   that array for its first three occurrences in the neighbouring window of L
   places, by range successor in its interval: a run whose period is in
   [L, 2L) holds a dyadic block together with its copy one period later. The
   shortest blocks, of 8 words, take the places nearer than 8, too.
3. One or two occurrences are candidate periods as they are. Three or more
   form a progression, whose difference d is the block's own period; then the
   copy one period later is the one that stands alike in its stretch of period
   d, so the distances of the stretches' ends, and d, are the candidates.
4. A candidate is extended in both directions by binary search over prefix
   hashes; equal stretches are one run, of the smallest period found.

Words are told by 64-bit hashes, joined with their text, so nothing matches
across texts. No pairs are listed and nothing is cut: the work is a few sorts
of the text's words, memory some 100 bytes a word of one text or block.

Defined results: a null or empty text, or one of fewer than ``least`` words,
has no runs; null ids stay; repeated rows are documents of their own; extra
columns are carried if asked for, whatever their names, but for those named
like a result, which the result replaces; an empty table gives no rows. Runs may overlap; they come by start, then period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from sparkdraft.llm.wavelet import WaveletTree
from sparkdraft.llm.words import _mix, _powers, string_buffers, text_chunks, window_hashes, word_hashes

LEAST = 24
REPEATS = 3
#: Words of the shortest dyadic blocks; 3 * SHORTEST <= LEAST keeps them inside any run of a short period.
SHORTEST = 8
_CHUNK = 4 << 20
_GRAM_BASE, _EXTEND_BASE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


class _Extension:
    """Longest common extensions of places by prefix hashes."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        power, self.inverse = _powers(_EXTEND_BASE, self.n + 1)
        self.prefix = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(x * power[: self.n], out=self.prefix[1:])

    def _same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        one = (self.prefix[i + size] - self.prefix[i]) * self.inverse[i]
        return one == (self.prefix[j + size] - self.prefix[j]) * self.inverse[j]

    def _longest(self, most: np.ndarray, same) -> np.ndarray:
        """The largest size up to ``most`` for which ``same`` holds (as it does for all below it)."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) >> 1
            good = same(open_, mid)
            low[open_[good]] = mid[good]
            high[open_[~good]] = mid[~good] - 1

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, i < j."""
        return self._longest(self.n - j, lambda at, size: self._same(i[at], j[at], size))

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, i < j."""
        return self._longest(i.copy(), lambda at, size: self._same(i[at] - size, j[at] - size, size))


def _starts(key: np.ndarray) -> np.ndarray:
    """For sorted keys, where the group of each begins."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))


def _sizes(group: np.ndarray) -> np.ndarray:
    """Size of the group of each suffix; groups are told by the slot they begin at."""
    return np.bincount(group, minlength=len(group))[group]


def _suffixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Places whose first SHORTEST words occur again, their suffix array (as
    ranks among these places), and (L, place's rank, interval) of the dyadic
    blocks that occur again."""
    grams = window_hashes(x, SHORTEST, _GRAM_BASE)
    order = np.argsort(grams)
    twin = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= twin
    again[:-1] |= twin
    place = np.sort(order[again])
    m = len(place)
    array = np.argsort(grams[place], kind="stable")
    group = np.empty(m, dtype=np.int64)
    group[array] = _starts(grams[place[array]])
    blocks, size, length = [], _sizes(group), SHORTEST
    while m:
        live = size > 1
        at = np.flatnonzero(live & (place % length == 0))
        blocks.append((length, at, group[at], group[at] + size[at]))
        # The first 2 L words: ranks of both halves; a half that occurs nowhere else tells the suffix apart.
        slots = np.flatnonzero(live[array])
        if not len(slots):
            break
        ranked = array[slots]
        nxt = np.minimum(np.searchsorted(place, place[ranked] + length), m - 1)
        second = np.where((place[nxt] == place[ranked] + length) & live[nxt], group[nxt], m + ranked)
        turn = np.lexsort((second, group[ranked]))
        ranked, second = ranked[turn], second[turn]
        first = group[ranked]
        array[slots] = ranked
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group[ranked] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        size = _sizes(group)
        length *= 2
    return place, array, blocks


def _occurrences(place: np.ndarray, tree: WaveletTree, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: int, far: int) -> list[np.ndarray]:
    """For blocks at place[at], whose interval is [lo, hi): the first three
    places of an equal block that are ``near`` or more and less than ``far`` words on, else -1."""
    found, end = [], place[at] + far
    ask = np.searchsorted(place, place[at] + near)
    some = np.arange(len(at))
    for _ in range(3):
        got = tree.successor(lo[some], hi[some], ask)
        ok = got >= 0
        ok[ok] = place[got[ok]] < end[some[ok]]
        some, got = some[ok], got[ok]
        row = np.full(len(at), -1, dtype=np.int64)
        row[some] = place[got]
        found.append(row)
        ask = got + 1
    return found


def _candidates(place: np.ndarray, array: np.ndarray, blocks: list, longest: int, extend: _Extension, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) to be tried."""
    tree, places, periods = WaveletTree(array), [], []

    def add(s: np.ndarray, q: np.ndarray, below: int) -> None:
        ok = (q > 0) & (q < below)
        places.append(s[ok])
        periods.append(q[ok])

    for length, at, lo, hi in blocks:
        if length * repeats > longest and length > SHORTEST:
            break
        for near, far in ([(1, length)] if length == SHORTEST else []) + [(length, 2 * length)]:
            one, two, three = _occurrences(place, tree, at, lo, hi, near, far)
            s = place[at]
            few = (one >= 0) & (three < 0)
            add(s[few], one[few] - s[few], far)
            few &= two >= 0
            add(s[few], two[few] - s[few], far)
            many = three >= 0
            s, f, d = s[many], one[many], two[many] - one[many]
            add(s, d, far)
            add(s, f + extend.right(f, f + d) - s - extend.right(s, s + d), far)
            add(s, f - extend.left(f, f + d) - s + extend.left(s, s + d), far)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def periodic_stretches(h: np.ndarray, first: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in texts whose word hashes are ``h``,
    text t from ``first[t]``; places count over all texts; by start, then period."""
    if least < 3 * SHORTEST or repeats < 3:
        raise ValueError(f"runs of at least {3 * SHORTEST} words and 3 periods")
    size = np.diff(first)
    none = np.zeros(0, np.int64)
    if len(h) < SHORTEST + 1:
        return none, none, none
    text = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    x = _mix(h ^ _mix(text + np.uint64(0x9E3779B97F4A7C15)))
    place, array, blocks = _suffixes(x)
    if not len(place):
        return none, none, none
    extend = _Extension(x)
    s, q = _candidates(place, array, blocks, int(size.max()), extend, repeats)
    ok = s + q < len(x)
    s, q = s[ok], q[ok]
    start, end = s - extend.left(s, s + q), s + q + extend.right(s, s + q)
    ok = end - start >= np.maximum(least, repeats * q)
    start, end, q = start[ok], end[ok], q[ok]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def periodic_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """The ``keep`` columns with n_words, runs (start, length, period) and
    collapsed: the words that no run holds after its first period, joined by one space."""
    keep = [c for c in keep if c not in ("n_words", "runs", "collapsed")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for lo, hi in text_chunks(offsets, _CHUNK):
                part = data[offsets[lo] : offsets[hi]]
                cuts = offsets[lo : hi + 1] - offsets[lo]
                h, first = word_hashes(part, cuts)
                start, end, period = periodic_stretches(h, first, least, repeats)
                text = np.searchsorted(first, start, side="right") - 1
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, end, -1)
                dropped = np.cumsum(edge) > 0
                raw, collapsed = part.tobytes(), []
                some = np.bincount(text, minlength=hi - lo) > 0
                for t in range(hi - lo):
                    words = raw[cuts[t] : cuts[t + 1]].split()
                    if some[t]:
                        words = [words[i] for i in np.flatnonzero(~dropped[first[t] : first[t + 1]])]
                    collapsed.append(b" ".join(words))
                at = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(np.bincount(text, minlength=hi - lo), out=at[1:])
                found = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(end - start), pa.array(period)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at), found), pa.array(collapsed, pa.binary()).view(pa.string())],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    results = T.StructType.fromDDL("n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    found = packed.mapInArrow(run, T.StructType([packed.schema["row"], *results]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in keep], "n_words", "runs", "collapsed")


WHITE = r"[\x20\x09-\x0D]+"


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document by crc32 of its id, the words
    from a place on, given by the same hash, repeat periodically."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", WHITE), lambda w: w != "")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = planted.withColumns({"n": n, "a": F.when(n > 0, g % n)}).withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)))
    i = lambda c: c.cast("int")
    rest = F.col("n") - F.col("a")
    cycle = F.slice("words", i(F.col("a") + 1), i(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(cycle, i(F.ceil(rest / F.col("p"))))), F.lit(1), i(rest))
    head = F.when(F.col("a") > 0, F.slice("words", F.lit(1), i(F.greatest(F.col("a"), F.lit(1))))).otherwise(F.array().cast("array<string>"))
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exact exponent, and digests of all runs and of the text left."""
    # Two unequal fractions of integers below 2**26 differ as doubles, too.
    best = F.array_max(F.transform("runs", lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("q"), r["length"].alias("length"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(F.expr("best.length * 1000 div -best.q")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
