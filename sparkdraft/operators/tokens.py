"""Tokenized training examples as array columns (X07-X09, P09, P10, F03,
W04, W05, A32).

Token id arrays are ``ARRAY<INT>``; every transformation is a higher-order
array function evaluated inside the JVM, per row, with no shuffle. Only
padding to a batch maximum needs a (bounded) window per batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdraft.functions.text import col_

IGNORE_INDEX = -100
# The tiny test tokenizer (template, special tokens).
TEST_TEMPLATE = "<user>{text}<assistant>"
TEST_EOS_TEXT = "<eos>"
TEST_EOS_ID = 1
TEST_PAD_ID = 0


def char_token_ids(text: str | Column, mode: str = "mod101") -> Column:
    """One id per code point; ``mod101`` -> ``2 + cp % 101``,
    ``identity`` -> the code point itself. "" gives []."""
    s = col_(text)
    chars = F.split(s, "")
    if mode == "mod101":
        ids = F.transform(chars, lambda c: (F.lit(2) + F.ascii(c) % 101).cast("int"))
    elif mode == "identity":
        ids = F.transform(chars, lambda c: F.ascii(c).cast("int"))
    else:
        raise ValueError(f"unknown char tokenizer mode {mode!r}")
    return F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(ids)


def apply_template(prompt: str | Column, template: str | None) -> Column:
    """Wrap the user text in a chat template containing ``{text}``
    (identity when there is no template)."""
    p = col_(prompt)
    if not template:
        return p
    if "{text}" not in template:
        raise ValueError("template must contain {text}")
    before, after = template.split("{text}", 1)
    return F.concat(F.lit(before), p, F.lit(after))


def append_eos(response: str | Column, eos_text: str | None) -> Column:
    """P10: append the tokenizer's EOS text when it has one."""
    r = col_(response)
    return F.concat(r, F.lit(eos_text)) if eos_text else r


def tokenize_records(
    records: DataFrame,
    *,
    max_seq_len: int | None,
    template: str | None = TEST_TEMPLATE,
    eos_text: str | None = TEST_EOS_TEXT,
    tokenizer: str = "mod101",
    add_eos: bool = True,
    drop_empty: bool = True,
) -> DataFrame:
    """Records (id, prompt_text, response_text) -> tokenized examples.

    P09 template, P10 EOS, X07 char ids, X08 masks, then F03 drops rows
    whose response was truncated away entirely. ``max_seq_len=None`` cuts
    nothing. The work is staged in
    three projections (token ids, the truncated sequence, the derived
    arrays): each stage is referenced several times by the next, so the
    optimizer keeps it separate and every array is built once per row
    instead of once per derived field.
    """
    keep = [c for c in records.columns if c not in ("prompt_text", "response_text")]
    r_text = append_eos("response_text", eos_text if add_eos else None)
    x = records.select(
        *keep,
        char_token_ids(apply_template("prompt_text", template), tokenizer).alias("_p_ids"),
        char_token_ids(r_text, tokenizer).alias("_r_ids"),
    )
    x = x.select(
        *keep,
        (F.concat("_p_ids", "_r_ids") if max_seq_len is None else F.slice(F.concat("_p_ids", "_r_ids"), 1, int(max_seq_len))).alias("input_ids"),
        F.size("_p_ids").alias("_np"),
    )
    n = F.size("input_ids")
    x = x.select(*keep, "input_ids", F.least(F.col("_np"), n).cast("int").alias("prompt_len"), n.cast("int").alias("_n"))
    rlen = F.greatest(F.col("_n") - F.col("prompt_len"), F.lit(0))
    out = x.select(
        *keep,
        "input_ids",
        F.array_repeat(F.lit(1), F.col("_n")).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.col("prompt_len")),
                 F.slice("input_ids", F.col("prompt_len") + 1, rlen)).alias("labels"),
        F.concat(F.array_repeat(F.lit(False), F.col("prompt_len")), F.array_repeat(F.lit(True), rlen)).alias("response_mask"),
        "prompt_len",
        rlen.cast("int").alias("response_len"),
    )
    return has_response_tokens(out) if drop_empty else out


def has_response_tokens(df: DataFrame) -> DataFrame:
    """keep examples with at least one supervised position."""
    if "response_len" in df.columns:
        return df.filter(F.col("response_len") > 0)
    return df.filter(F.exists("response_mask", lambda m: m))


def left_truncate(ids: str | Column, max_tokens: int | Column) -> Column:
    """struct(ids, truncated, tokens_original, tokens_used) keeping the
    last ``max_tokens`` ids. The slice start is computed as a positive
    index (a negative start returns [] for short arrays)."""
    a = col_(ids)
    n = F.lit(max_tokens) if isinstance(max_tokens, int) else max_tokens
    size = F.size(a)
    start = F.greatest(size - n, F.lit(0)) + 1
    kept = F.slice(a, start, n)
    return F.struct(
        kept.alias("ids"),
        (size > n).alias("truncated"),
        size.cast("int").alias("tokens_original"),
        F.size(kept).cast("int").alias("tokens_used"),
    )


def prompt_budget(model_len: int, max_new_tokens: int, max_prompt_tokens: int | None = None) -> int:
    """Default prompt budget of X09: ``max(1, model_len - max_new_tokens)``."""
    if max_prompt_tokens is not None and int(max_prompt_tokens) > 0:
        return int(max_prompt_tokens)
    return max(1, int(model_len) - int(max_new_tokens))


def batch_id(index: str | Column, batch_size: int) -> Column:
    """Position div batch size (size at least 1)."""
    return F.floor(col_(index) / F.lit(max(1, int(batch_size)))).cast("long")


def pad_to_batch_max(df: DataFrame, batch_col: str, pad_id: int | None = TEST_PAD_ID,
                     eos_id: int | None = TEST_EOS_ID) -> DataFrame:
    """Right-pad every array of a batch to the batch's longest example.

    Pad id falls back pad -> eos -> 0; attention 0, labels -100, response
    mask false. The window is per batch, so its size is the batch size.
    """
    pad = pad_id if pad_id is not None else (eos_id if eos_id is not None else 0)
    w = Window.partitionBy(batch_col)
    gap = F.max(F.size("input_ids")).over(w) - F.size("input_ids")

    def padded(c: str, v) -> Column:
        return F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_sd_gap")))

    return df.withColumn("_sd_gap", gap).select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "labels", "response_mask")],
        padded("input_ids", pad).alias("input_ids"),
        padded("attention_mask", 0).alias("attention_mask"),
        padded("labels", IGNORE_INDEX).alias("labels"),
        padded("response_mask", False).alias("response_mask"),
        F.col("_sd_gap").alias("n_pad"),
    )


def truncation_count(df: DataFrame, flag_col: str = "metadata.target_prompt_truncated") -> DataFrame:
    """How many prompts were left-truncated."""
    return df.agg(F.count_if(F.coalesce(F.col(flag_col), F.lit(False))).alias("n_truncated"))
