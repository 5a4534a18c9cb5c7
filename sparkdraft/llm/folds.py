"""Held-out folds by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def held_out_of(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
