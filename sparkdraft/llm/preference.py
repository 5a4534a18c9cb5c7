"""Preference pairs from chosen and rejected conversations.

The longest common prefix of turns (same role and text) of both sides is
rendered once as the prompt; what follows on each side is its completion, with
the character spans that are trained on: the text and end mark of the
assistant's turns. The prompt and other roles' turns are masked.

A conversation is one training example; its turns are gathered by pair, as the
rendered example is one string. A pair of more than ``MOST_CHARS`` characters is
no example and can't be gathered in a task: sizes are added up first (combined
before the shuffle), and the first such pair fails the call by name. Turns stand in
the order of turn, role and text.

Defined results: rows without a pair id or a turn, or with another side, belong to no
conversation and are left out; a null role is ``unknown``, a null text empty;
turns repeated under one number are all kept; a pair with one side only has
the empty completion on the other and is not usable, as is a pair of equal
sides, whose turns are all prompt; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"
#: Characters of both sides of a pair.
MOST_CHARS = 1 << 28
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _loss_spans(turns: Column) -> Column:
    """(start, end) of what is trained on, in characters of the rendered turns."""

    def step(state: Column, turn: Column) -> Column:
        end = state["at"] + F.length(_rendered(turn))
        span = F.array(F.struct((state["at"] + F.length(_head(turn))).cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"))
    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per pair: the id, n_prompt_turns, prompt, chosen, rejected,
    chosen_loss and rejected_loss (spans) and usable (both sides go on, and not alike)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = turns.filter(F.col(pair_col).isNotNull() & F.col(turn_col).isNotNull() & F.col(side_col).isin("chosen", "rejected"))
    size = F.length(_rendered(turn)).cast("bigint")
    large = own.groupBy(F.col(pair_col).alias("pair")).agg(F.sum(size).alias("n")).filter(F.col("n") > MOST_CHARS).first()
    if large:
        raise ValueError(f"pair {large['pair']} has {large['n']} characters, at most {MOST_CHARS}")
    sides = (
        own.groupBy(F.col(pair_col))
        .agg(*[F.array_sort(F.collect_list(F.when(F.col(side_col) == side, turn))).alias(side) for side in ("chosen", "rejected")])
        .select(pair_col, *[F.transform(side, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(side) for side in ("chosen", "rejected")])
    )
    # zip_with fills the shorter side with nulls, which equal no turn.
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), False)
    split = sides.withColumn("n", F.when(differs > 0, differs - 1).otherwise(F.size("chosen")).cast("int"))
    rest = {side: F.slice(side, F.col("n") + 1, F.size(side)) for side in ("chosen", "rejected")}
    parts = split.select(pair_col, "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), *[rest[s].alias(s) for s in rest])
    return parts.select(
        pair_col,
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        _text(F.col("prompt")).alias("prompt"),
        *[_text(F.col(s)).alias(s) for s in rest],
        *[_loss_spans(F.col(s)).alias(f"{s}_loss") for s in rest],
        ((F.size("chosen") > 0) & (F.size("rejected") > 0)).alias("usable"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Stand-in input: every conversation as the chosen side, and as the rejected
    side with the assistant's texts of an even length reversed."""
    common = [F.col("conv_id").alias("pair_id"), "turn", "role"]
    worse = F.when((F.col("role") == ASSISTANT) & (F.length("text") % 2 == 0), F.reverse("text")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), worse.alias("text"))))
    return conversations.select(*common, sides.alias("s")).select("pair_id", "turn", "role", "s.side", "s.text")


ORACLE_SQL = f"""
WITH t AS (
    SELECT conv_id AS pair_id, turn, role, 'chosen' AS side, text FROM conversations
    UNION ALL
    SELECT conv_id, turn, role, 'rejected', CASE WHEN role = '{ASSISTANT}' AND length(text) % 2 = 0 THEN reverse(text) ELSE text END FROM conversations),
c AS (SELECT pair_id, turn, side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM t WHERE pair_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i FROM c),
a AS (SELECT * FROM o WHERE side = 'chosen'),
b AS (SELECT * FROM o WHERE side = 'rejected'),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS i FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.i = b.i
    WHERE a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text GROUP BY 1),
n AS (SELECT o.pair_id, coalesce(min(d.i) - 1, max(o.i)) AS n FROM o LEFT JOIN d ON o.pair_id = d.pair_id GROUP BY 1),
r AS (SELECT o.*, n, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn_text FROM o JOIN n USING (pair_id)),
s AS (SELECT *, sum(length(turn_text)) OVER (PARTITION BY pair_id, side ORDER BY i) AS ends FROM r WHERE i > n),
e AS (SELECT pair_id, side, string_agg(turn_text, '' ORDER BY i) AS text,
    string_agg(CASE WHEN role = '{ASSISTANT}' THEN (ends - length(turn_text) + length(head)) || '-' || ends END, ',' ORDER BY i) AS loss FROM s GROUP BY 1, 2),
p AS (SELECT pair_id, string_agg(turn_text, '' ORDER BY i) AS prompt FROM r WHERE side = 'chosen' AND i <= n GROUP BY 1)
SELECT n.pair_id, CAST(n.n AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(x.text, '') AS chosen, coalesce(y.text, '') AS rejected,
    coalesce(x.loss, '') AS chosen_loss, coalesce(y.loss, '') AS rejected_loss, x.text IS NOT NULL AND y.text IS NOT NULL AS usable
FROM n LEFT JOIN p USING (pair_id) LEFT JOIN (SELECT * FROM e WHERE side = 'chosen') x ON x.pair_id = n.pair_id
    LEFT JOIN (SELECT * FROM e WHERE side = 'rejected') y ON y.pair_id = n.pair_id"""
