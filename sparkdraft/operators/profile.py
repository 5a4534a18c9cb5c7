"""Per-conversation profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.functions.text import preview


def first_turn_text(role_col: str, text_col: str, turn_col: str, role: str) -> Column:
    """P12 as an aggregate: text of the first message with exactly ``role``
    ("" if none). A struct minimum, so it combines map-side."""
    first = F.min(F.when(F.col(role_col) == role, F.struct(F.col(turn_col).alias("t"), F.col(text_col).alias("x"))))
    return F.coalesce(first["x"], F.lit(""))


def first_turn_in_array(messages: Column, role: str) -> Column:
    """P12 on an array of {role, content} structs."""
    hit = F.filter(messages, lambda m: m["role"] == role)
    return F.coalesce(F.get(hit, 0)["content"].cast("string"), F.lit(""))


def profile_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Char lengths of the first user / assistant message, the turn
    count and 100-character previews, one row per conversation."""
    agg = turns.groupBy(conv_col).agg(
        first_turn_text(role_col, text_col, turn_col, "user").alias("_p"),
        first_turn_text(role_col, text_col, turn_col, "assistant").alias("_r"),
        F.count(F.lit(1)).alias("turns"),
    )
    return agg.select(
        conv_col,
        F.length("_p").alias("prompt_chars"),
        F.length("_r").alias("response_chars"),
        F.col("turns").cast("long").alias("turns"),
        preview("_p").alias("prompt_preview"),
        preview("_r").alias("response_preview"),
    )
