"""Benchmark decontamination with the q-gram lemma.

Texts are compared by characters, letters lower-cased and every white-space
character as a space, which keeps all offsets. A benchmark item is looked for by every
window of ``WINDOW`` characters in it (shorter items: whole), each with a budget
of ``EDITS`` edits (shorter items: in proportion). So every passage of ``WINDOW``
characters within ``EDITS`` edits is found, and every exact one of
``WINDOW - EDITS``.

1. A region within k edits of a window of m characters shares at least
   ``m - q + 1 - k * q`` of its q-grams, on diagonals (place in the text less
   place in the item) at most k apart. So the shared q-grams of each item are
   put in bands of 2 * (k + 1) diagonals, one beginning every k + 1. Stretches
   of one repeated q-gram meet as stretches: a band gets the interval of places
   that they share in it, not every pair of their places.
2. Windows of which a band holds that many are retained. Of equal windows of an
   item only the first is looked for.
3. Each is verified by an alignment within its band: the edit distance of the
   window to the best part of the text there. What is within the budget is a hit.

A text that would still put more than ``WORK`` places in bands (rules, tables,
long repeats) is searched in short segments that overlap by two windows, and the
middle of a stretch of period 8 or less is left out before, as every place in it
is like the ones that stay; its hits are extended over what was left out. So
memory is bounded, and time grows with the length of the text.

The q-grams of the benchmark are broadcast in blocks of items of bounded size;
a larger benchmark takes more blocks, each held against all documents.

Defined results: a null text or item text has no hits; null ids are kept; repeated rows
are reported as often as they stand; items of fewer than ``EXACT`` characters
have to stand as they are, between characters that are no letter or digit (where
the item begins or ends with one); an empty item has no hits; extra
columns are ignored; an empty table on either side gives no rows; of several hits of an item in one
text the spans that touch are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import worker_cache
from sparkdraft.llm.words import text_chunks

Q = 8
WINDOW = 80
EDITS = 6
#: Items of fewer characters have no budget and stand alone.
EXACT = 16
#: Characters of the shortest item for which ``without_contaminated`` drops a text: single words and names are no leak.
LEAST = 32
#: Places in bands from which on a text is searched by segments, and their characters.
WORK = 1 << 18
_SHORT_SEGMENT = 4096
#: Characters of items in one broadcast block.
BLOCK_CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22
#: Characters of a long text that are searched at a time.
_SEGMENT = 1 << 20


def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letter of every code point (if it is one code point), a space for
    white space; and which code points are letters or digits."""
    cache = worker_cache()
    if "folded" not in cache:
        table, wordy = np.arange(0x110001, dtype=np.uint32), np.zeros(0x110001, dtype=bool)
        for i in range(0x110000):
            ch = chr(i)
            wordy[i] = ch.isalnum()
            if ch.isspace():
                table[i] = 32
            elif ch.isupper() and len(ch.lower()) == 1:
                table[i] = ord(ch.lower())
        cache["folded"] = table, wordy
    return cache["folded"]


def characters(text: str) -> np.ndarray:
    """Code points, letters lower-cased, white space as spaces; same length as the text."""
    return _folded()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hash of ``c[i:i+q]`` for every i; q is a power of two."""
    h, size, power = c.astype(np.uint64) + np.uint64(1), 1, _BASE
    while size < q:
        h = h[:-size] * power + h[size:] if len(h) > size else h[:0]
        size *= 2
        with np.errstate(over="ignore"):
            power = power * power
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _windows(length: int) -> list[tuple[int, int]]:
    """(start, characters) of the windows of an item."""
    if length <= WINDOW:
        return [(0, length)]
    return [(s, WINDOW) for s in range(length - WINDOW + 1)]


def _edits(size: int) -> int:
    """Budget of a window: EDITS, or in proportion, and no more than the q-gram bound can tell."""
    return max(0, min(EDITS * size // WINDOW, (size - Q) // Q))


def _stretches(key: np.ndarray, at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where stretches begin: the key and ``same`` stay, ``at`` goes on by one."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _first_windows(h: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of an item (``h``: its q-grams) that no earlier one equals."""
    if length <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    n = length - WINDOW + 1
    # The first 64 q-grams, one after them and the last one: all 80 characters.
    both = np.stack([gram_hashes(h, 64)[:n], h[64 : 64 + n], h[WINDOW - Q :][:n]], axis=1)
    _, at = np.unique(both, axis=0, return_index=True)
    return np.sort(at)


def build_index(items: list[tuple[int, str]]) -> dict:
    """Arrays of one block: item texts, their windows' shapes, and stretches of
    (q-gram, item, first place, last place) sorted by q-gram."""
    texts = [characters(t) for _, t in items]
    lengths = np.array([len(c) for c in texts], dtype=np.int64)
    sizes = np.minimum(lengths, WINDOW)
    edits = np.array([_edits(m) for m in sizes.tolist()], dtype=np.int64)
    parts, windows = [], []
    for i, c in enumerate(texts):
        canon = np.zeros(len(c) + 1, dtype=bool)
        if len(c) >= Q:
            h = gram_hashes(c, Q)
            starts = _first_windows(h, len(c))
            canon[starts] = True
            # Only places in one of these windows count.
            cover = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(cover, starts, 1)
            np.add.at(cover, np.minimum(starts + sizes[i] - Q + 1, len(h)), -1)
            place = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            parts.append((h[place], np.full(len(place), i), place))
        windows.append(canon)
    g, item, place = (np.concatenate([*x, np.zeros(0, k)]) for x, k in zip(zip(*parts) if parts else ((), (), ()), (np.uint64, np.int64, np.int64)))
    order = np.lexsort((place, item, g))
    g, item, place = g[order], item[order], place[order]
    begin = _stretches(g, place, item)
    last = place[np.append(begin[1:], len(place)) - 1] if len(begin) else place
    keys, first = np.unique(g[begin], return_index=True)
    filter_ = np.zeros(1 << _BITS, dtype=bool)
    filter_[_slot(keys)] = True
    return {
        "ids": [i for i, _ in items],
        "chars": np.concatenate([*texts, np.zeros(0, np.uint32)]),
        # Where each item begins, its characters, those of a window, the budget, the q-grams to share.
        "items": np.stack([np.cumsum(lengths) - lengths, lengths, sizes, edits, sizes - Q + 1 - edits * Q], axis=1).reshape(-1, 5),
        # By item and start: whether the window there is the first of its kind.
        "canon": np.concatenate([*windows, np.zeros(0, bool)]),
        "canon_at": np.cumsum(lengths + 1) - lengths - 1,
        "keys": keys,
        "first": np.append(first, len(begin)),
        "item": item[begin],
        "low": place[begin],
        "high": last,
        # Places of all stretches before one.
        "places": np.concatenate(([0], np.cumsum(last - place[begin] + 1))),
        "filter": filter_,
    }


def _shared(c: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, key) of the stretches of one q-gram in ``c`` that the block has, where enough are near each other."""
    none = (np.zeros(0, np.int64),) * 3
    items = index["items"]
    if len(c) < Q or not len(index["keys"]):
        return none
    h = gram_hashes(c, Q)
    hit = index["filter"][_slot(h)]
    # A region that reaches some bound has that many hits within a window and its budget.
    long = items[items[:, 1] >= Q]
    reach, bound = int((long[:, 2] + long[:, 3]).max()) - Q + 1, int(long[:, 4].min())
    sums = np.concatenate(([0], np.cumsum(hit, dtype=np.int32), np.full(reach, hit.sum(), np.int32)))
    dense = np.concatenate(([0], np.cumsum(sums[reach:] - sums[:-reach] >= bound, dtype=np.int32)))
    at = np.flatnonzero(hit)
    at = at[dense[at + 1] > dense[np.maximum(at - reach + 1, 0)]]
    if not len(at):
        return none
    key = np.searchsorted(index["keys"], h[at])
    key[key == len(index["keys"])] = 0
    real = index["keys"][key] == h[at]
    at, key = at[real], key[real]
    if not len(at):
        return none
    begin = _stretches(key, at)
    return at[begin], at[np.append(begin[1:], len(at)) - 1], key[begin]


def _work(low: np.ndarray, high: np.ndarray, key: np.ndarray, index: dict) -> np.ndarray:
    """About how many places each stretch of a text puts in bands."""
    times = index["first"][key + 1] - index["first"][key]
    places = index["places"]
    all_places = places[index["first"][key + 1]] - places[index["first"][key]]
    # Each place of a stretch in an item is in the bands that the stretch of the text reaches.
    return times + all_places * (2 + 2 * (high - low) // (EDITS + 1))


def candidates(shared: tuple[np.ndarray, np.ndarray, np.ndarray], bounds: np.ndarray, index: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(item, start of the window, first diagonal, text) of the windows whose shared q-grams
    reach the bound, some at a time. ``shared`` are the stretches of the texts, which lie one
    after another, ``bounds`` where each begins and the last ends; diagonals are counted over all."""
    x0, x1, key = shared
    part = np.searchsorted(bounds, x0, side="right") - 1
    for run in _blocks(part, _work(x0, x1, key, index)):
        times = index["first"][key[run] + 1] - index["first"][key[run]]
        flat = np.repeat(index["first"][key[run]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        of = np.repeat(np.arange(run.start, run.stop), times)
        item, text = index["item"][flat], part[of]
        order = np.lexsort((item, text))
        pairs = x0[of][order], x1[of][order], index["low"][flat][order], index["high"][flat][order], item[order], text[order]
        lengths = pairs[3] - pairs[2] + 1
        for some in _blocks(pairs[5] * len(index["items"]) + pairs[4], lengths * (2 + 2 * (pairs[1] - pairs[0]) // (EDITS + 1))):
            yield _candidates(*(x[some] for x in pairs), index["items"], index)


def _blocks(group: np.ndarray, work: np.ndarray) -> Iterator[slice]:
    """Stretches of whole groups with about ``4 * WORK`` or less each; a larger group stands alone."""
    n, at = len(group), 0
    total = np.concatenate(([0], np.cumsum(work)))
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + 4 * WORK, side="right")) - 1)
        if end < n:
            # Back to where the last group begins, or on to its end if it is the first.
            begin = int(np.searchsorted(group, group[end - 1], side="left")) if group[end] == group[end - 1] else end
            end = begin if begin > at else int(np.searchsorted(group, group[at], side="right"))
        yield slice(at, end)
        at = end


def _candidates(x0: np.ndarray, x1: np.ndarray, p0: np.ndarray, p1: np.ndarray, item: np.ndarray, text: np.ndarray, items: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``candidates`` of stretches x0 to x1 of a text that meet p0 to p1 of an item."""
    none = (np.zeros(0, np.int64),) * 4
    # The steps of k + 1 diagonals that two stretches reach, and the places they share in each.
    wide = items[item, 3] + 1
    low_step = (x0 - p1) // wide
    n = (x1 - p0) // wide - low_step + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.repeat(low_step - np.cumsum(n) + n, n) + np.arange(n.sum())
    lo = np.maximum(p0[of], x0[of] - (step + 1) * wide[of] + 1)
    hi = np.minimum(p1[of], x1[of] - step * wide[of])
    # Band b covers the steps b and b + 1.
    w, t, lo, hi = (np.tile(x, 2) for x in (item[of], text[of], lo, hi))
    b = np.concatenate([step, step - 1])
    order = np.lexsort((hi, lo, b, w, t))
    w, b, t, lo, hi = w[order], b[order], t[order], lo[order], hi[order]
    group = np.ones(len(w), dtype=bool)
    group[1:] = (w[1:] != w[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])
    number = np.cumsum(group) - 1
    # A place of the item counts once: what an interval adds to those before it in its group.
    most = int(items[:, 1].max()) + 2
    reached = np.maximum.accumulate(number * most + hi + 1)
    before = np.where(group, 0, np.concatenate(([0], reached[:-1])) - number * most)
    lo = np.maximum(lo, before)
    size = np.maximum(hi - lo + 1, 0)
    total = np.bincount(number, size)
    enough = (total[number] >= items[w, 4]) & (size > 0)
    w, b, t, lo, size, number = (x[enough] for x in (w, b, t, lo, size, number))
    if not len(w):
        return none
    p = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
    w, b, t, number = (np.repeat(x, size) for x in (w, b, t, number))
    # The last of as many q-grams as the bound, from each on: the windows that hold them all.
    last = np.arange(len(w)) + items[w, 4] - 1
    within = last < len(w)
    last[~within] = 0
    span = items[w, 2] - Q
    within &= (number[last] == number) & (p[last] - p <= span)
    one = np.flatnonzero(within)
    lo = np.maximum(p[last[one]] - span[one], 0)
    hi = np.minimum(p[one], items[w[one], 1] - items[w[one], 2])
    times = np.maximum(hi - lo + 1, 0)
    one, start = np.repeat(one, times), np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
    first = index["canon"][index["canon_at"][w[one]] + start]
    one, start = one[first], start[first]
    _, kept = np.unique(number[one] * most + start, return_index=True)
    one, start = one[kept], start[kept]
    return w[one], start, b[one] * (items[w[one], 3] + 1), t[one]


def _short_hits(c: np.ndarray, bounds: np.ndarray, index: dict) -> Iterator[tuple[int, int, int]]:
    """(item, place in ``c``, text) of the items that have no q-gram."""
    for i in np.flatnonzero((index["items"][:, 1] > 0) & (index["items"][:, 1] < Q)).tolist():
        begin, length = index["items"][i, :2].tolist()
        if len(c) < length:
            continue
        same = np.ones(len(c) - length + 1, dtype=bool)
        for j in range(length):
            same &= c[j : j + len(same)] == index["chars"][begin + j]
        at = np.flatnonzero(same)
        at = at[_stands_alone(c, at, at + length)]
        for place, text in zip(at.tolist(), (np.searchsorted(bounds, at, side="right") - 1).tolist(), strict=True):
            yield i, place, text


def _stands_alone(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether no letter or digit goes on at either end of c[lo:hi]; text ends are no letters."""
    wordy = np.concatenate(([False], _folded()[1][c], [False]))
    return ~(wordy[lo] & wordy[lo + 1]) & ~(wordy[hi] & wordy[hi + 1])


def align(c: np.ndarray, lo: np.ndarray, hi: np.ndarray, patterns: np.ndarray, diagonal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the part of ``c[lo:hi]`` nearest to each row of ``patterns``,
    on the diagonals from ``diagonal`` to ``diagonal + width - 1``; all rows at once."""
    big = 1 << 20
    offsets = np.arange(width)
    lo, hi = lo[:, None], hi[:, None]
    columns = diagonal[:, None] + offsets  # text place opposite the pattern's first, by diagonal
    cost = np.where((columns >= lo) & (columns <= hi), 0, big)
    start = columns.copy()
    for i in range(patterns.shape[1]):
        at = columns + i
        inside = (at >= lo) & (at < hi)
        step = cost + (c[np.where(inside, at, 0)] != patterns[:, i : i + 1])
        step[~inside] = big
        # A pattern character with nothing opposite comes from the next diagonal.
        skip = np.full_like(cost, big)
        skip[:, :-1] = cost[:, 1:] + 1
        better = skip < step
        begin = start.copy()
        begin[:, :-1][better[:, :-1]] = start[:, 1:][better[:, :-1]]
        step = np.minimum(step, skip)
        # Text characters with nothing opposite run along the row.
        low = np.minimum.accumulate(step - offsets, axis=1)
        source = np.maximum.accumulate(np.where(step - offsets == low, offsets, 0), axis=1)
        cost = np.where((at + 1 >= lo) & (at + 1 <= hi), np.minimum(low + offsets, big), big)
        start = np.take_along_axis(begin, source, axis=1)
    best = np.argmin(cost, axis=1)
    row = np.arange(len(best))
    return cost[row, best], start[row, best], columns[row, best] + patterns.shape[1]


def _laid_out(texts: list[np.ndarray], segment: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of the texts one after another, a value that is no character after each;
    bounds, text number and offset in the text. Long texts lie in overlapping segments."""
    end = np.array([0x110000], dtype=np.uint32)
    parts = [(t, at, c[at : at + segment + overlap]) for t, c in enumerate(texts) for at in range(0, max(1, len(c) - overlap), segment)]
    bounds = np.concatenate(([0], np.cumsum([len(p[2]) + 1 for p in parts]))).astype(np.int64)
    c = np.concatenate([x for p in parts for x in (p[2], end)]) if parts else end[:0]
    return c, bounds, np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)


#: Characters that stay at each end of a stretch of a short period: more than a window, its budget and a period.
_STAY = 2 * WINDOW


def _shortened(c: np.ndarray, longest: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters without the middle of long stretches of a period of up to
    ``longest``, and where (counted in what is left) how many were left out."""
    left_out = np.zeros(len(c), dtype=bool)
    for q in range(1, longest + 1):
        if len(c) <= 2 * _STAY + 2 * q:
            break
        same = np.zeros(len(c) - q + 2, dtype=np.int8)
        same[1:-1] = c[q:] == c[:-q]
        edge = np.diff(same)
        begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + q
        more = (end - begin - 2 * _STAY) // q * q
        for i in np.flatnonzero(more > 0).tolist():
            # A stretch that a shorter period has shortened is left as it is.
            if not left_out[begin[i] : end[i]].any():
                left_out[begin[i] + _STAY : begin[i] + _STAY + more[i]] = True
    edge = np.diff(np.concatenate(([0], left_out.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    sizes = end - begin
    return c[~left_out], begin - (np.cumsum(sizes) - sizes), sizes


def _found(c: np.ndarray, bounds: np.ndarray, shared: tuple, index: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the windows within their budget, counted in ``c``."""
    items = index["items"]
    for i, at, t in _short_hits(c, bounds, index):
        yield t, i, at, at + int(items[i, 1]), 0
    for item, start, diagonal, part in candidates(shared, bounds, index):
        shapes = items[item, 2] * 1000 + items[item, 3]
        for shape in np.unique(shapes).tolist():
            own = np.flatnonzero(shapes == shape)
            size, edits = divmod(shape, 1000)
            for at in range(0, len(own), 4096):
                w, s, d, t = (x[own[at : at + 4096]] for x in (item, start, diagonal, part))
                patterns = index["chars"][(items[w, 0] + s)[:, None] + np.arange(size)]
                got, lo, hi = align(c, bounds[t], bounds[t + 1] - 1, patterns, d + s, 2 * (edits + 1))
                ok = got <= edits
                if size < EXACT:
                    ok[ok] = _stands_alone(c, lo[ok], hi[ok])
                yield from zip(*(x[ok].tolist() for x in (t, w, lo, hi, got)), strict=True)


def hits(texts: list[str], index: dict) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the verified regions, touching ones of an item as one."""
    if not len(index["items"]) or not texts:
        return []
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    c, bounds, number, offset = _laid_out([characters(t) for t in texts], _SEGMENT, 2 * WINDOW)
    shared = _shared(c, index)
    part = np.searchsorted(bounds, shared[0], side="right") - 1
    busy = np.bincount(part, _work(*shared, index), minlength=len(number)) > WORK
    for p in np.flatnonzero(busy).tolist():
        for item, lo, hi, got in _segment_hits(c[bounds[p] : bounds[p + 1] - 1], index):
            found.setdefault((int(number[p]), item), []).append((lo + int(offset[p]), hi + int(offset[p]), got))
    calm = ~busy[part]
    for p, item, lo, hi, got in _found(c, bounds, tuple(x[calm] for x in shared), index):
        shift = int(offset[p] - bounds[p])
        found.setdefault((int(number[p]), item), []).append((lo + shift, hi + shift, got))
    return [(t, item, *span) for (t, item), spans in sorted(found.items()) for span in _merged(spans)]


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    merged: list[list[int]] = []
    for lo, hi, got in sorted(spans):
        if merged and lo <= merged[-1][1]:
            merged[-1] = [merged[-1][0], max(hi, merged[-1][1]), min(got, merged[-1][2])]
        else:
            merged.append([lo, hi, got])
    return [tuple(m) for m in merged]


def _segment_hits(c: np.ndarray, index: dict) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, edits) in one text that holds many repeats, by short segments."""
    short, cuts, sizes = _shortened(c)
    spans: dict[int, list[tuple[int, int, int]]] = {}
    segments, bounds, _, offset = _laid_out([short], _SHORT_SEGMENT, 2 * WINDOW)
    for i, at in enumerate(offset.tolist()):
        piece = segments[bounds[i] : bounds[i + 1]]
        own = np.array([0, len(piece)], dtype=np.int64)
        for _, item, lo, hi, got in _found(piece, own, _shared(piece, index), index):
            spans.setdefault(item, []).append((lo + at, hi + at, got))
    gone = np.concatenate(([0], np.cumsum(sizes)))
    for item, all_ in spans.items():
        for lo, hi, got in _merged(all_):
            # What begins at a cut begins after what was left out, what ends at it ends before.
            yield item, lo + int(gone[np.searchsorted(cuts, lo, side="right")]), hi + int(gone[np.searchsorted(cuts, hi, side="left")]), got


def _index_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Broadcast indexes of the items, about BLOCK_CHARS characters each."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).filter("item_text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == b).orderBy("item_id", "item_text").collect()
        yield spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in block]))


def _batch_hits(texts: list[str | None], index: dict) -> list[tuple[int, int, int, int, int]]:
    """``hits`` of a batch, some hundred thousand characters at a time."""
    offsets = np.concatenate(([0], np.cumsum([len(t or "") for t in texts]))).astype(np.int64)
    return [(lo + t, *rest) for lo, hi in text_chunks(offsets, 1 << 18) for t, *rest in hits([t or "" for t in texts[lo:hi]], index)]


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per hit: the ``keep`` columns, item_id, span_start and span_end
    (characters of the text) and edits (of the best window in it)."""
    inner = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def against(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = model.value
            for batch in batches:
                k = batch.num_columns - 1
                rows = _batch_hits(batch.column(k).to_pylist(), index)
                if rows:
                    t, item, start, end, edits = (list(x) for x in zip(*rows, strict=True))
                    taken = batch.take(pa.array(t))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns[:k], pa.array([index["ids"][i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                        names=[*batch.schema.names[:k], "item_id", "span_start", "span_end", "edits"],
                    )

        return run

    out = None
    for model in _index_blocks(spark, benchmark, item_col, item_text_col):
        found = inner.mapInArrow(against(model), f"{kinds}, item_id bigint, span_start bigint, span_end bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without a hit of an item of ``least`` characters or
    more, all columns; rows pass through, nothing is shuffled."""
    benchmark = benchmark.filter(F.length(F.col(item_text_col).cast("string")) >= least)
    place = docs.columns.index(text_col)

    def against(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[row[0] for row in _batch_hits(batch.column(place).to_pylist(), model.value)]] = False
                yield batch.filter(pa.array(clean))

        return run

    for model in _index_blocks(spark, benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(against(model), docs.schema)
    return docs
