"""The suffix tree in the memory of one process: the plain form of ``pst.model_table``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdraft.llm.pst import CONTEXT_MIN, DEPTH, DISCOUNT, DIVERGENCE, END, ENTRY_MIN, HashIndex, _chunks, _counted
from sparkdraft.llm.words import _mix, window_hashes

_BASE = 0xD1342543DE82EF95
_PAIR = np.uint64(0x9FB21C651E98DF25)

@dataclass
class Tree:
    """The model in memory. State 0 is the root; ``parent`` is the longest retained suffix."""

    n: int  # training tokens
    v: int  # distinct ones
    words: np.ndarray  # hashes of the words
    counts: np.ndarray
    state_keys: list[np.ndarray] = field(default_factory=list)  # by depth: hashes of contexts
    state_ids: list[np.ndarray] = field(default_factory=list)
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.ones(1))  # of the parent's distribution
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # state and word
    probs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.n + self.v + 1.0)


def _entry_key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix((state.astype(np.uint64) << np.uint64(32)) + word.astype(np.uint64) + _PAIR)


class Lookup:
    """Indexes over a tree, built once by each worker."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.words = HashIndex(tree.words)
        self.states = [HashIndex(k) for k in tree.state_keys]
        self.entries = HashIndex(tree.entries)

    def log10(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of P(word | state); for a word that is not frequent (-1) only
        the weights down to the root."""
        t = self.tree
        out = np.zeros(len(state))
        left, state = np.arange(len(state)), state.copy()
        while len(left):
            s, w = state[left], word[left]
            at_root = s == 0
            done = left[at_root & (w >= 0)]
            out[done] += np.log10(t.root(t.counts[word[done]]))
            left, s, w = left[~at_root], s[~at_root], w[~at_root]
            if not len(left):
                break
            at = np.where(w >= 0, self.entries.find(_entry_key(s, w)), -1)
            out[left] += np.log10(np.where(at >= 0, t.probs[at] if len(t.probs) else 1.0, t.weight[s]))
            left = left[at < 0]
            state[left] = t.parent[state[left]]
        return out

    def state_of(self, h: np.ndarray, word: np.ndarray, first: np.ndarray) -> np.ndarray:
        """State before each token: the longest retained suffix of the text so far."""
        state = np.zeros(len(h), dtype=np.int32)
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        known = word >= 0
        run = np.ones(len(h), dtype=bool)
        for d, index in enumerate(self.states, 1):
            if len(h) <= d:
                break
            run[d:] &= known[: len(h) - d]  # d frequent words stand before
            run[:d] = False
            at = np.flatnonzero(run & (place >= d))
            found = index.find(window_hashes(h, d, _BASE)[at - d])
            state[at[found >= 0]] = self.tree.state_ids[d - 1][found[found >= 0]]
        return state


def _next_counts(spark: SparkSession, texts: DataFrame, words: np.ndarray, contexts: np.ndarray, depth: int) -> DataFrame:
    """(key, n) for candidate contexts and frequent next tokens: context number << 32 | word number."""
    model = spark.sparkContext.broadcast((words, contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, by_context = HashIndex(model.value[0]), HashIndex(model.value[1])
        for batch in batches:
            parts = []
            for _, _, h, first in _chunks(batch):
                if len(h) <= depth:
                    continue
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
                at = np.flatnonzero(place >= depth)
                context = by_context.find(window_hashes(h, depth, _BASE)[at - depth])
                at, context = at[context >= 0], context[context >= 0]
                word = by_word.find(h[at])
                parts.append((context[word >= 0].astype(np.int64) << 32) | word[word >= 0])
            yield _counted(parts)

    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def learn(spark: SparkSession, counts: DataFrame, texts: DataFrame, depth: int = DEPTH) -> Tree:
    """The tree of the training ``texts`` (one string column) with their word counts,
    in the driver's memory: the plain form of ``model_table``, for small corpora."""
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy("key").toArrow()
    tree = Tree(n, v, head.column("key").to_numpy().view(np.uint64).copy(), head.column("n").to_numpy().copy())
    end = int(np.flatnonzero(tree.words == END)[0]) if (tree.words == END).any() else -1
    own = np.flatnonzero((tree.counts >= CONTEXT_MIN) & (np.arange(len(tree.words)) != end))
    members, totals = own[:, None], tree.counts[own]
    for d in range(1, depth + 1):
        if not len(members):
            break
        keys = _context_keys(tree.words, members)
        table = _next_counts(spark, texts, tree.words, keys, d).filter(F.col("n") >= ENTRY_MIN).toArrow()
        packed, seen = table.column("key").to_numpy(), table.column("n").to_numpy()
        context, word = packed >> 32, packed & 0xFFFFFFFF
        _grow(tree, members, keys, totals, context, word, seen)
        longer = (seen >= CONTEXT_MIN) & (word != end)
        members, totals = np.concatenate([members[context[longer]], word[longer, None]], axis=1), seen[longer]
    return tree


def _context_keys(words: np.ndarray, members: np.ndarray) -> np.ndarray:
    """The hash that ``window_hashes`` gives for each row of word numbers."""
    total, power = np.zeros(len(members), dtype=np.uint64), 1
    for j in range(members.shape[1]):
        total += words[members[:, j]] * np.uint64(power)
        power = power * (_BASE | 1) & 0xFFFFFFFFFFFFFFFF
    return _mix(total)


def _grow(tree: Tree, members: np.ndarray, keys: np.ndarray, totals: np.ndarray, context: np.ndarray, word: np.ndarray, seen: np.ndarray) -> None:
    """Adds the contexts of one depth that differ enough from their suffix."""
    look, m = Lookup(tree), len(members)
    suffix = np.zeros(m, dtype=np.int32)
    for d in range(1, members.shape[1]):
        found = look.states[d - 1].find(_context_keys(tree.words, members[:, -d:]))
        suffix[found >= 0] = tree.state_ids[d - 1][found[found >= 0]]
    q = 10.0 ** look.log10(suffix[context], word)
    p = seen / totals[context]
    rest_p = np.maximum(1.0 - np.bincount(context, p, m), 0.0)
    rest_q = np.maximum(1.0 - np.bincount(context, q, m), 1e-12)
    divergence = np.bincount(context, p * np.log(p / q), m) + np.where(rest_p > 0, rest_p * np.log(np.maximum(rest_p, 1e-300) / rest_q), 0.0)
    kept = np.flatnonzero((divergence >= DIVERGENCE) & (np.bincount(context, minlength=m) > 0))
    ids = np.full(m, -1, dtype=np.int32)
    ids[kept] = len(tree.parent) + np.arange(len(kept))
    weight = (totals - np.bincount(context, seen - DISCOUNT, m)) / totals
    of_kept = ids[context] >= 0
    context, word, seen, q = context[of_kept], word[of_kept], seen[of_kept], q[of_kept]
    tree.state_keys.append(keys[kept])
    tree.state_ids.append(ids[kept])
    tree.parent = np.concatenate([tree.parent, suffix[kept]])
    tree.weight = np.concatenate([tree.weight, weight[kept]])
    tree.entries = np.concatenate([tree.entries, _entry_key(ids[context], word)])
    tree.probs = np.concatenate([tree.probs, (seen - DISCOUNT) / totals[context] + weight[context] * q])
