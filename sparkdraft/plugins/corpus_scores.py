"""Scores over a whole table of generations, written by a user.

A corpus score is not a mean over rows (pooled n-gram precision, a rank
correlation over bins, a type count by sketch). It is written as an aggregate
in two phases: ``start`` makes a state, ``update`` takes a block of rows into
it, ``merge`` joins two states, ``finish`` makes the number. Every partition
runs through once for all scores and gives one state each. States are merged in
a tree (``FANS``): 4096 groups of partitions, 64 groups of those, then all, so
that of 260 000 partitions no task takes more than 64 states. A state is bounded:
one that pickles to more than ``MOST_BYTES`` fails its score. ``start`` has to be
neutral in ``merge``, and the order in which states are merged is not fixed.

A score that raises anywhere, or ends in no finite number, has no value but
the reason; the others go on.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
FANS = (4096, 64)
_REASON = 200


@dataclass(frozen=True)
class CorpusScore:
    """``inputs`` are the columns a block of rows has, as a pandas DataFrame."""

    inputs: tuple[str, ...]
    start: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float]


def _shared(generation: str, target: str, n: int) -> tuple[int, int]:
    """How many n-grams of the generation the target has, too (each as often as there), and how many there are."""
    grams = [Counter(zip(*[words[i:] for i in range(n)])) for words in (generation.split(" "), target.split(" "))]
    return sum((grams[0] & grams[1]).values()), sum(grams[0].values())


def pooled_overlap(n: int) -> CorpusScore:
    """Share of all generations' n-grams (words between single spaces) found in
    their targets, pooled over the table: long rows weigh more. A null text is
    empty, which is one empty word; 0 without n-grams."""

    def update(state: tuple[int, int], rows: pd.DataFrame) -> tuple[int, int]:
        for one, other in zip(rows["generation"].fillna(""), rows["target_generation"].fillna("")):
            hit, all_ = _shared(one, other, n)
            state = state[0] + hit, state[1] + all_
        return state

    return CorpusScore(
        ("generation", "target_generation"), lambda: (0, 0), update,
        lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else 0.0,
    )


def _builtin() -> dict[str, CorpusScore]:
    return {"pooled_unigram_overlap": pooled_overlap(1), "pooled_bigram_overlap": pooled_overlap(2)}


_STATE = "name string, state binary, problem string"


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:_REASON]


def _kept(name: str, state: Any) -> tuple[str, bytes | None, str | None]:
    data = cloudpickle.dumps(state)
    if len(data) > MOST_BYTES:
        return name, None, f"state of {len(data)} bytes, at most {MOST_BYTES}"
    return name, data, None


@dataclass
class CorpusScores:
    """The corpus scores a job knows. ``extra`` adds to the built-in ones."""

    extra: Mapping[str, CorpusScore] = field(default_factory=dict)

    def known(self) -> dict[str, CorpusScore]:
        return _builtin() | dict(self.extra)

    def scores(self, generations: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """(name, score, problem), a row for each wanted name: the score, or null
        and why there is none (not declared, a column is lacking, it failed)."""
        known, wanted = self.known(), list(dict.fromkeys(wanted))
        refused = {}
        for name in wanted:
            if name not in known:
                refused[name] = "not declared"
            elif lacking := [c for c in known[name].inputs if c not in generations.columns]:
                refused[name] = f"lacks {', '.join(lacking)}"
        used = {n: known[n] for n in wanted if n not in refused}
        spark = generations.sparkSession
        out = spark.createDataFrame([(n, None, p) for n, p in refused.items()], "name string, score double, problem string")
        return out.unionByName(_scored(generations, used)) if used else out


def _tried(name: str, work: Callable[[], tuple[str, bytes | None, str | None]]) -> tuple[str, bytes | None, str | None]:
    try:
        return work()
    except Exception as e:  # a user's score must not stop the others
        return name, None, _reason(e)


def _merged(used: dict[str, CorpusScore], rows: pd.DataFrame) -> tuple[str, bytes | None, str | None]:
    """One row (name, state, problem) of several of one score; of problems the least text stays."""
    name, failed = rows["name"].iloc[0], rows["problem"].dropna()
    if len(failed):
        return name, None, min(failed)

    def work() -> tuple[str, bytes | None, str | None]:
        state = pickle.loads(rows["state"].iloc[0])
        for other in rows["state"].iloc[1:]:
            state = used[name].merge(state, pickle.loads(other))
        return _kept(name, state)

    return _tried(name, work)


def _ended(score: CorpusScore, state: bytes) -> tuple[float | None, str | None]:
    try:
        value = float(score.finish(pickle.loads(state)))
    except Exception as e:
        return None, _reason(e)
    return (value, None) if math.isfinite(value) else (None, f"ends in {value}")


def _scored(generations: DataFrame, used: dict[str, CorpusScore]) -> DataFrame:
    columns = list(dict.fromkeys(c for s in used.values() for c in s.inputs))

    def taken(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states, problems = {}, {}
        for rows in blocks:
            for name in [n for n in used if n not in problems]:
                try:
                    state = states[name] if name in states else used[name].start()
                    states[name] = used[name].update(state, rows[list(used[name].inputs)])
                except Exception as e:
                    problems[name] = (name, None, _reason(e))
        found = [problems.get(n) or _tried(n, lambda n=n: _kept(n, states[n])) for n in used if n in problems or n in states]
        yield pd.DataFrame(found, columns=["name", "state", "problem"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_merged(used, rows)], columns=["name", "state", "problem"])

    def ended(rows: pd.DataFrame) -> pd.DataFrame:
        name, state, problem = _merged(used, rows)
        value, problem = (None, problem) if problem else _ended(used[name], state)
        return pd.DataFrame({"name": [name], "score": pd.Series([value], dtype="float64"), "problem": [problem]})

    # A state of no rows for each score, so that an empty table has scores, too.
    starts = generations.sparkSession.createDataFrame([_tried(n, lambda n=n, s=s: _kept(n, s.start())) for n, s in used.items()], _STATE)
    states = generations.select(*[F.col(f"`{c}`") for c in columns]).mapInPandas(taken, _STATE).withColumn("place", F.spark_partition_id())
    states = states.unionByName(starts.withColumn("place", F.lit(0)))
    for groups in FANS:
        dealt = states.withColumn("place", F.pmod("place", F.lit(groups)))
        states = dealt.groupBy("name", "place").applyInPandas(lambda key, rows: merged(rows).assign(place=key[1]), _STATE + ", place int")
    return states.groupBy("name").applyInPandas(ended, "name string, score double, problem string")
