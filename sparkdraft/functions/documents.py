"""Typed access to JSON documents (X10, used by P24 and P25).

A text is parsed once into a VARIANT, which keeps the type every value was
written with: a quoted number stays a text, a nested object an object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkdraft.functions.text import col_

FIELDS = "map<string,variant>"
#: Types that ``schema_of_variant`` names a number by.
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def document(text: str | Column) -> Column:
    """The one JSON value a text consists of; bare NaN and Infinity are numbers.

    Null for a null text and for one that is empty, cut off, followed by
    anything else, or has an object that repeats a name.
    """
    # Inside a list, a text of two values gives two items and other trailing text fails.
    listed = F.from_json(F.concat(F.lit("["), col_(text), F.lit("]")), "variant", {"allowNonNumericNumbers": "true"})
    items = F.try_variant_get(listed, "$", "array<variant>")
    return F.when(F.size(items) == 1, F.try_element_at(items, F.lit(1)))


def is_number(value: Column) -> Column:
    """Whether a VARIANT holds a number (texts, booleans and nulls are none)."""
    return F.coalesce(F.schema_of_variant(value).rlike(_NUMBER), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def number(value: Column) -> Column:
    """The number a VARIANT holds, as a double; null for anything else."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def fields(value: Column, path: str = "$") -> Column:
    """name -> VARIANT of the object at ``path``; null where there is none."""
    return F.try_variant_get(value, path, FIELDS)


#: What a value has to be written as, to be read as a type.
_WRITTEN = {"double": _NUMBER, "bigint": "^BIGINT", "int": "^BIGINT", "string": "^STRING", "boolean": "^BOOLEAN"}


def nested_get(value: Column, path: str, kind: str, default) -> Column:
    """What stands at ``path`` if it is written as ``kind``, else ``default``
    (also where a step of the path is missing, null or no object)."""
    if kind not in _WRITTEN:
        raise ValueError(f"kind must be one of {', '.join(_WRITTEN)}, got {kind!r}")
    found = F.try_variant_get(value, path, "variant")
    fits = F.schema_of_variant(found).rlike(_WRITTEN[kind])
    return F.coalesce(F.when(fits, F.try_variant_get(value, path, kind)), F.lit(default).cast(kind))
