"""User tokenizers, batch generation and collators.

The user callable is built once per Python worker and name, and fed Arrow
batches. Whole records travel with their prompts, so outputs are never joined
or zipped back to their inputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.functions.text import clean
from sparkdraft.operators.ordering import index_by_key
from sparkdraft.operators.tokens import batch_id

Generator = Callable[[list[str], dict], list[str]]


def _factory_name(factory: Callable[[], object]) -> str:
    """A digest of the pickled factory: equal for equal code and settings."""
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _built(name: str, factory: Callable[[], object]) -> object:
    """What the factory builds, once per worker process and name.

    Functions of this package are shipped by value, so a module global would be
    empty in every task; the cache hangs on a module that workers import.
    """
    import pyspark

    cache = pyspark.__dict__.setdefault("_sparkdraft_built", {})
    if name not in cache:
        cache[name] = factory()
    return cache[name]


def tokenizer_udf(factory: Callable[[], Callable[[list[str]], list[list[int]]]], name: str | None = None) -> Callable[[Column], Column]:
    """Wrap a callable from a list of texts to a list of id lists (built
    once per worker) as an Arrow-batched pandas UDF returning ``ARRAY<INT>``.
    Null texts are not passed on and stay null."""
    key = name or _factory_name(factory)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        ids = iter(_built(key, factory)(texts[there].tolist()))
        return pd.Series([[int(i) for i in next(ids)] if ok else None for ok in there], dtype="object")

    return encode


def echo_generator() -> Generator:
    """Default deterministic stub: generation i of a batch is
    ``generated-<i>`` (position within the request batch)."""

    def gen(prompts: list[str], params: dict) -> list[str]:
        return [f"generated-{i}" for i in range(len(prompts))]

    return gen


def prompt_echo_generator() -> Generator:
    """Deterministic stub that answers with the prompt itself (a stand-in
    model whose output depends only on its input, not on batching)."""

    def gen(prompts: list[str], params: dict) -> list[str]:
        return list(prompts)

    return gen


def generate_responses(
    df: DataFrame,
    factory: Callable[[], Generator],
    params: dict,
    *,
    prompt_col: str = "prompt_input",
    request_batch_size: int = 64,
    name: str | None = None,
) -> DataFrame:
    """The rows of ``df`` with a ``generation`` column, via ``mapInPandas``.

    Each Arrow batch is cut into request batches of ``request_batch_size``
    (W04) and handed to the generator; the whole row stays with its prompt, so
    records with equal ids keep their own answers and nothing is shuffled.
    """
    bs = max(1, int(request_batch_size))
    key = name or _factory_name(factory)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = _built(key, factory)
        for pdf in it:
            outs: list[str] = []
            prompts = pdf["_sd_prompt"].tolist()
            for i in range(0, len(prompts), bs):
                outs.extend(gen(prompts[i:i + bs], params))
            if len(outs) != len(prompts):
                raise ValueError("generator returned a different number of outputs")
            yield pd.DataFrame({"row": pdf["row"], "generation": outs})

    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(prompt_col).alias("_sd_prompt"))
    schema = T.StructType([packed.schema["row"], T.StructField("generation", T.StringType())])
    out = packed.mapInPandas(run, schema)
    return out.select("row.*", "generation")


def rewrite_response(generated: DataFrame, generated_at: str, key_col: str = "id") -> DataFrame:
    """Keep the old response in metadata, stamp the (per-job) time,
    replace the response by the stripped ``generation``, set source 'target'."""
    mtype = generated.schema["metadata"].dataType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in mtype.fields])
    meta = (
        F.coalesce(F.col("metadata"), empty)
        .withField("original_response_text", F.col("response_text"))
        .withField("response_generated_at", F.lit(generated_at))
    )
    own = (key_col, "prompt_text", "response_text", "source", "metadata", "generation")
    return generated.select(
        key_col,
        "prompt_text",
        clean("generation").alias("response_text"),
        F.lit("target").alias("source"),
        meta.alias("metadata"),
        *[c for c in generated.columns if c not in own],
    )


def length_batches(df: DataFrame, length: str | Column, id_col: str, batch_size: int) -> DataFrame:
    """W04 by length: ``batch_id`` of neighbours in the order of (length, id), so
    that a batch needs little padding. Only length and id are sorted and
    checkpointed; ids have to be unique."""
    asked = df.withColumn("_sd_length", F.col(length) if isinstance(length, str) else length)
    placed = index_by_key(asked, ["_sd_length", id_col], [id_col], "_sd_place")
    return placed.withColumn("batch_id", batch_id("_sd_place", batch_size)).drop("_sd_length", "_sd_place")


def apply_collator(df: DataFrame, batch_col: str, collate: Callable[[pd.DataFrame], pd.DataFrame],
                   schema: T.StructType | str, most: int | None = None) -> DataFrame:
    """A user collator as a grouped map over batches. A batch of more than
    ``most`` rows fails the query before the collator sees it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if most is not None and len(rows) > most:
            raise ValueError(f"batch {rows[batch_col].iloc[0]} has {len(rows)} rows, at most {most}")
        return collate(rows)

    return df.groupBy(batch_col).applyInPandas(run, schema)


def pad_collator(pad_id: int, ignore_index: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A collator as a user writes it: the arrays of a batch, padded on the right to its longest."""

    def collate(rows: pd.DataFrame) -> pd.DataFrame:
        longest = max(map(len, rows["input_ids"]))
        gap = [longest - len(ids) for ids in rows["input_ids"]]
        fill = {"input_ids": pad_id, "attention_mask": 0, "labels": ignore_index, "response_mask": False}
        padded = {c: [[*values, *[v] * n] for values, n in zip(rows[c], gap)] for c, v in fill.items()}
        return rows.assign(**padded, n_pad=gap)

    return collate
