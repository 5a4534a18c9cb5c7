"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdraft.functions.text import col_


def round_half_even_int(c: str | Column) -> Column:
    """Round half to even, as an integer (``rint(2.5) = 2``)."""
    return F.rint(col_(c)).cast("long")


def usable_denominator(c: str | Column) -> Column:
    """X14 guard: non-null, not NaN and > 0 (NaN > 0 is true in Spark)."""
    x = col_(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (x > 0)


def guarded_ratio(num: str | Column, den: str | Column, otherwise=None) -> Column:
    """Num / den when the denominator is usable, else ``otherwise``."""
    out = F.when(usable_denominator(den), col_(num).cast("double") / col_(den).cast("double"))
    return out.otherwise(F.lit(otherwise)) if otherwise is not None else out


def is_finite(c: str | Column) -> Column:
    """Not null, not NaN, not infinite."""
    x = col_(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def relative_gain_pct(new: str | Column, base: str | Column) -> Column:
    """100 * (new - base) / base (null for a zero base)."""
    return F.when(col_(base) != 0, F.lit(100.0) * (col_(new) - col_(base)) / col_(base))


def display_round(c: str | Column, places: int) -> Column:
    """Presentation rounding (final projection only)."""
    return F.round(col_(c), places)


def sort_keys(*keys: tuple[str, bool]) -> list[Column]:
    """Multi-key sort specification [(column, ascending), ...] for
    ``orderBy`` (a range-partitioned distributed sort)."""
    return [F.col(k).asc_nulls_last() if asc else F.col(k).desc_nulls_last() for k, asc in keys]
