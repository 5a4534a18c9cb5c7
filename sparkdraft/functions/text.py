"""String column expressions shared by the normalization operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's ``str.strip()`` removes
# (``str.isspace``), written as one regex class that Java and RE2 read alike.
WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
STRIP_PATTERN = rf"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same characters as a plain string, for trim(BOTH chars FROM s).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def clean(c: str | Column) -> Column:
    """Null -> "", otherwise the text with Unicode whitespace stripped
    at both ends. ``trim`` with an explicit character set only touches the
    ends of the string (a regex would scan whole documents); plain
    ``F.trim`` would strip spaces only."""
    return F.trim(F.coalesce(col_(c).cast("string"), F.lit("")), F.lit(WHITESPACE_CHARS))


def truthy_str(c: str | Column) -> Column:
    """The value if it is a non-empty string, else null (Python ``x or ...``)."""
    return F.nullif(col_(c).cast("string"), F.lit(""))


def first_truthy(*cols: str | Column) -> Column:
    """``a or b or c`` over string columns; all falsy gives null.

    Python would return the last operand when all are falsy; after P04
    cleaning both "" and null become "", so null is equivalent here.
    """
    return F.coalesce(*[truthy_str(c) for c in cols])


def truthy_id(c: str | Column, dtype: T.DataType) -> Column:
    """String form of an id that Python would treat as truthy.

    Numeric 0 and "" are falsy; other values are rendered with ``str()``.
    """
    x = col_(c)
    if isinstance(dtype, T.StringType):
        return F.nullif(x, F.lit(""))
    if isinstance(dtype, T.BooleanType):
        return F.when(x, F.lit("True"))
    if isinstance(dtype, T.NumericType):
        return F.when(x != F.lit(0), x.cast("string"))
    return x.cast("string")


def slug(c: str | Column, fallback: str = "model") -> Column:
    """P17 slug: runs outside ``[A-Za-z0-9._-]`` become "-", "-" stripped at
    both ends, lower-cased; empty gives ``fallback``."""
    s = F.regexp_replace(col_(c).cast("string"), r"[^A-Za-z0-9._-]+", "-")
    s = F.lower(F.regexp_replace(s, r"^-+|-+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def entity_key(c: str | Column) -> Column:
    """``<slug>-<first 10 hex of sha256(value)>``."""
    x = col_(c).cast("string")
    return F.concat(slug(x), F.lit("-"), F.substring(F.sha2(x, 256), 1, 10))


def is_null_draft(c: str | Column) -> Column:
    """A draft spec that means "no draft model"."""
    x = col_(c)
    return x.isNull() | F.lower(clean(x)).isin("", "none", "null", "vanilla")


def str_to_bool(c: str | Column) -> Column:
    """{1,true,yes,y,on} (trimmed, case-insensitive); null is false."""
    return F.lower(clean(c)).isin("1", "true", "yes", "y", "on")


def preview(c: str | Column, n: int = 100) -> Column:
    """P13 preview: first ``n`` characters with "\\n" replaced by a space."""
    return F.translate(F.substring(F.coalesce(col_(c), F.lit("")), 1, n), "\n", " ")
