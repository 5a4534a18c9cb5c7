"""Named quality scores over generation tables.

A score is declared, not run: a column that is 1 for a perfect row and 0 for
a bad one (or null where it does not apply), over named input columns. The
table averages every declared column in one aggregate, so any number of
scores takes one pass, and a score that fails on a row counts as null there
instead of stopping the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.text import clean


@dataclass(frozen=True)
class Score:
    """``value`` is a SQL expression text or a column over ``inputs``."""

    inputs: tuple[str, ...]
    value: Column | str

    def column(self) -> Column:
        return (F.expr(self.value) if isinstance(self.value, str) else self.value).try_cast("double")


def _builtin() -> dict[str, Score]:
    same = clean("generation") == clean("target_generation")
    return {"exact_match_vs_target": Score(("generation", "target_generation"), same)}


@dataclass
class ScoreTable:
    """The scores a job knows. ``extra`` adds to the built-in ones."""

    extra: Mapping[str, Score] = field(default_factory=dict)

    def known(self) -> dict[str, Score]:
        return _builtin() | dict(self.extra)

    def split(self, generations: DataFrame, wanted: Iterable[str]) -> tuple[dict[str, Column], dict[str, str]]:
        """Usable score columns, and for the others why they are not."""
        known, usable, refused = self.known(), {}, {}
        for name in dict.fromkeys(wanted):
            if name not in known:
                refused[name] = "not declared"
            elif lacking := [c for c in known[name].inputs if c not in generations.columns]:
                refused[name] = f"lacks {', '.join(lacking)}"
            else:
                try:
                    generations.select(known[name].column()).schema
                    usable[name] = known[name].column()
                except AnalysisException as e:
                    refused[name] = str(e).splitlines()[0]
        return usable, refused

    def scores(self, generations: DataFrame, wanted: Iterable[str]) -> DataFrame:
        """(name, score): the mean of each usable score, 0 without rows;
        refused names give no row (see ``split`` for the reasons)."""
        usable, _ = self.split(generations, wanted)
        if not usable:
            return generations.sparkSession.createDataFrame([], "name string, score double")
        means = generations.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(usable.values())])
        rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{i}").alias("score")) for i, n in enumerate(usable)])
        return means.select(F.explode(rows).alias("r")).select("r.*")
