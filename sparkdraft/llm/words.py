"""Vectorised word hashes over Arrow string buffers.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``; its
hash is a polynomial over random per-byte values in 64-bit arithmetic, mixed
at the end. Two different words share a hash with odds of about 2**-62, which
is how the operators here identify words; window hashes use two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sparkdraft.llm.store import worker_cache

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i below n, kept by the worker."""
    cache = worker_cache()
    got = cache.get(("powers", base))
    if got is None or len(got[0]) < n:
        size = max(n, _CHUNK + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        got = cache[("powers", base)] = tuple(out)
    return got


def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    white = np.zeros(256, dtype=bool)
    white[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    values[white] = 0
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values, white


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    n = len(col)
    offsets_buf, data_buf = col.buffers()[1:3]
    if n == 0 or offsets_buf is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offsets_buf, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_span(data: np.ndarray, cuts: np.ndarray, values: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in ``data``; ``cuts`` are offsets at which words end."""
    word = ~white[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = word[cuts]
    starts = np.flatnonzero(begins)
    ends_at = word.copy()
    ends_at[:-1] &= ~word[1:]
    inner = cuts[cuts > 0] - 1
    ends_at[inner] = word[inner]
    ends = np.flatnonzero(ends_at) + 1
    power, inverse = _powers(_BASE, len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=prefix[1:])
    return _mix((prefix[ends] - prefix[starts]) * inverse[starts]), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (uint64) of all texts, one after another, and each text's first index among them.

    Works through about a megabyte at a time, cut where a word ends, so that
    memory beyond the result does not grow with the text; one word longer
    than that is taken whole.
    """
    values, white = _tables(lower)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        if end < len(data):
            back = end
            while back > at and not white[data[back - 1]]:
                step = data[max(at, back - 4096) : back]
                gaps = np.flatnonzero(white[step])
                back = back - len(step) + (int(gaps[-1]) + 1 if len(gaps) else 0)
                if len(gaps):
                    break
            if back > at:
                end = back
            else:
                while end < len(data) and not white[data[end]]:
                    gaps = np.flatnonzero(white[data[end : end + 4096]])
                    end = end + int(gaps[0]) if len(gaps) else min(end + 4096, len(data))
        lo, hi = np.searchsorted(offsets, [at, end], side="left")
        h, s = _hash_span(data[at:end], offsets[lo:hi] - at, values, white)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    all_starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(all_starts, offsets, side="left")


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of ``h[i:i+width]`` for every i; windows over the end are left out."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, _CHUNK):
        part = h[at : min(at + _CHUNK, n) + width - 1]
        power, inverse = _powers(base | 1, len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=prefix[1:])
        m = len(part) - width + 1
        out[at : at + m] = _mix((prefix[width:] - prefix[:m]) * inverse[:m])
    return out


def text_chunks(offsets: np.ndarray, most: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``most`` bytes each; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
