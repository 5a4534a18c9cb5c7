"""Content-addressed keys of tables, from mergeable digests.

A row is written out so that no two different rows read alike: every value
with its length before it, a null as a mark of its own. Its sha256 is cut into
four numbers, and a table's digest is their sums modulo 2**60 with the number of
rows. Sums don't depend on order or partitions, combine map-side, and the digest
of two parts together follows from the digests of the parts: appended data never
has the old data read again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = [f"lane{i}" for i in range(4)]
#: Hexadecimal digits of a hash in each lane, and what the sums are taken modulo.
DIGITS = 15
MODULUS = 1 << 4 * DIGITS
_SUM = "decimal(38,0)"


def _written(df: DataFrame, name: str) -> Column:
    """A value as text. Nested values are JSON with all null fields; so are
    their inner texts quoted and escaped."""
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def row_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """An injective text of a row's ``cols``: ``-`` for a null, else ``<length>:<value>``."""

    def one(name: str) -> Column:
        text = _written(df, name)
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(F.lit(""), *[one(c) for c in cols])


def content_parts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_rows, lane0..lane3): the digest of each part of the table, one row without ``by``."""
    h = df.select(*by, F.sha2(row_text(df, cols), 256).alias("_h"))
    lanes = [F.conv(F.substring("_h", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)").alias(c) for i, c in enumerate(LANES)]
    return _summed(h.select(*by, F.lit(1).cast("long").alias("n_rows"), *lanes), by)


def merge_parts(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The digests of parts put together, by the columns ``by`` (all as one without)."""
    return _summed(parts, by)


def _summed(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    zero = F.lit(0).cast(_SUM)
    sums = [F.pmod(F.coalesce(F.sum(F.col(c).cast(_SUM)), zero), F.lit(MODULUS).cast(_SUM)).cast("decimal(20,0)").alias(c) for c in LANES]
    return parts.groupBy(*by).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *sums)


def digest_text() -> Column:
    """The lanes as one text."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in LANES])


def settings_text(df: DataFrame, cols: Sequence[str], **settings) -> str:
    """Names and types of the columns, and the settings, as one text: null and "" differ."""
    kinds = [[c, df.schema[c].dataType.simpleString()] for c in cols]
    return json.dumps({"columns": kinds, **settings}, sort_keys=True, ensure_ascii=False)


def dataset_fingerprint(df: DataFrame, cols: list[str], *, tokenizer_name: str, template: str | None, max_seq_len: int, add_eos: bool = True) -> DataFrame:
    """One row (n_rows, digest, fingerprint): 16 hexadecimal digits over the
    content, the columns' names and types, tokenizer, template, length and policy."""
    settings = settings_text(df, cols, tokenizer=tokenizer_name, template=template, max_seq_len=int(max_seq_len), add_eos=bool(add_eos), mask="response_only_v1")
    d = content_parts(df, cols).select("n_rows", digest_text().alias("digest"))
    key = F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("digest"), F.lit(settings)), 256)
    return d.select("n_rows", "digest", F.substring(key, 1, 16).alias("fingerprint"))
