"""Distribution queries: embeddings as student/teacher logits.

Stand-in: ``embeddings.embedding`` x 8 are the logits over a 64-token
vocabulary. Row ``vec_id`` is the teacher at position ``vec_id``; the
student at that position is row ``vec_id + 1``. Positions are grouped
into sequences of 16 consecutive ids; the label at a position is the
row's ``label`` (0 means "ignored", -100), and the first two positions of
each sequence are prompt (response mask false).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.operators.distributions import (
    accept_test,
    acceptance_by_temperature,
    argmax,
    categorical_draw,
    kd_losses,
    loss_states,
    losses_of,
    merge_losses,
    nucleus_mask,
    pair_positions,
    position_losses,
    residual_distribution,
    softmax,
    uniform_from_key,
    with_proposal,
)
from sparkdraft.plans.registry import register, table
from sparkdraft.session import scratch_folder
from sparkdraft.sources.committed import append_runs, read_runs

SEQ_LEN = 16
LOGIT_SCALE = 8.0
PROMPT_POSITIONS = 2
KD_TEMPERATURE, KD_ALPHA = 2.0, 0.5
ACC_TEMPERATURES = [0.5, 1.0, 1.5, 2.0]
TOP_P = 0.9
ROUND = 9


def _keyed(emb: DataFrame, vid) -> DataFrame:
    seq = F.floor(vid / SEQ_LEN).cast("long")
    return emb.select(
        seq.alias("seq"),
        (vid - seq * SEQ_LEN).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double") * F.lit(LOGIT_SCALE)).alias("logits"),
        F.col("label"),
    )


def logit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    emb = table(spark, sf_dir, "embeddings")
    teacher = _keyed(emb, F.col("vec_id"))
    student = _keyed(emb, F.col("vec_id") - 1)
    labels = teacher.select(
        "seq",
        "pos",
        F.when(F.col("label") == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        (F.col("pos") >= PROMPT_POSITIONS).alias("mask"),
    )
    return student.drop("label"), teacher.drop("label"), labels


def pairs_for(spark: SparkSession, sf_dir: str, with_labels: bool = True) -> DataFrame:
    s, t, lab = logit_tables(spark, sf_dir)
    return pair_positions(s, t, lab if with_labels else None)


# --------------------------------------------------------------------------
# DuckDB twins of the array formulas (1-based lambda index)
# --------------------------------------------------------------------------


def _sum(lst: str) -> str:
    return f"list_reduce({lst}, lambda a, b: a + b)"


BASE_SQL = f"""
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * {LOGIT_SCALE}) AS logits FROM embeddings),
t AS (SELECT CAST(floor(vec_id / {SEQ_LEN}) AS BIGINT) AS seq, CAST(vec_id - floor(vec_id / {SEQ_LEN}) * {SEQ_LEN} AS INTEGER) AS pos,
             logits AS teacher, CASE WHEN label = 0 THEN -100 ELSE label END AS label,
             (vec_id - floor(vec_id / {SEQ_LEN}) * {SEQ_LEN}) >= {PROMPT_POSITIONS} AS mask FROM e),
s AS (SELECT CAST(floor((vec_id - 1) / {SEQ_LEN}) AS BIGINT) AS seq,
             CAST((vec_id - 1) - floor((vec_id - 1) / {SEQ_LEN}) * {SEQ_LEN} AS INTEGER) AS pos, logits AS student FROM e),
nx AS (SELECT seq, pos - 1 AS pos, label AS next_label, mask AS next_mask FROM t),
pairs AS (SELECT s.seq, s.pos, s.student, t.teacher, nx.next_label, nx.next_mask
          FROM s JOIN t ON s.seq = t.seq AND s.pos = t.pos LEFT JOIN nx ON s.seq = nx.seq AND s.pos = nx.pos)
"""


def _lsm_cols(src: str, col: str, temp: str, out: str) -> str:
    """CTE body adding log-softmax ``out`` of ``col`` / ``temp`` (the max
    and the log-sum-exp are computed once per row in inner selects)."""
    x = f"list_transform({col}, lambda w: w / {temp})"
    return f"""
SELECT * EXCLUDE ({out}_m, {out}_l), list_transform({x}, lambda v: v - {out}_l) AS {out}
FROM (SELECT *, {out}_m + ln({_sum(f"list_transform({x}, lambda w: exp(w - {out}_m))")}) AS {out}_l
      FROM (SELECT *, list_max({x}) AS {out}_m FROM {src}))"""


def _div_sql(kind: str, ls: str, lt: str) -> str:
    if kind == "fkl":
        return _sum(f"list_transform({lt}, lambda tv, i: exp(tv) * (tv - {ls}[i]))")
    if kind == "rkl":
        return _sum(f"list_transform({ls}, lambda sv, i: exp(sv) * (sv - {lt}[i]))")
    term_t = f"list_transform({lt}, lambda a, i: exp(a) * (a - ln(greatest(0.5 * (exp(a) + exp({ls}[i])), 1.1754943508222875e-38))))"
    term_s = f"list_transform({ls}, lambda a, i: exp(a) * (a - ln(greatest(0.5 * (exp(a) + exp({lt}[i])), 1.1754943508222875e-38))))"
    return f"0.5 * ({_sum(term_t)} + {_sum(term_s)})"


POSITION_LOSS_BODY = f"""
WITH {BASE_SQL},
a AS ({_lsm_cols('pairs', 'student', '1.0', 'ls1')}),
b AS ({_lsm_cols('a', 'student', 'CAST({T} AS DOUBLE)', 'ls')}),
c AS ({_lsm_cols('b', 'teacher', 'CAST({T} AS DOUBLE)', 'lt')}),
pl AS (SELECT seq, pos,
         next_label IS NOT NULL AND next_label <> -100 AS ce_valid,
         next_label IS NOT NULL AND next_label <> -100 AND coalesce(next_mask, true) AS kd_valid,
         CASE WHEN next_label IS NOT NULL AND next_label <> -100 THEN -ls1[next_label + 1] END AS ce,
         {_div_sql('fkl', 'ls', 'lt')} AS fkl_all, {_div_sql('rkl', 'ls', 'lt')} AS rkl_all, {_div_sql('jsd', 'ls', 'lt')} AS jsd_all
       FROM c)
"""


POSITION_LOSSES_SQL = POSITION_LOSS_BODY.replace("{T}", "1.0") + f"""
SELECT seq, pos, round(ce, {ROUND}) AS ce,
       round(CASE WHEN kd_valid THEN fkl_all END, {ROUND}) AS fkl,
       round(CASE WHEN kd_valid THEN rkl_all END, {ROUND}) AS rkl,
       round(CASE WHEN kd_valid THEN jsd_all END, {ROUND}) AS jsd
FROM pl WHERE ce_valid OR kd_valid
"""


@register("position_losses", POSITION_LOSSES_SQL)
def q_position_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 + F05 + X01 + X02 + A21 per position: CE against the next label,
    FKL/RKL/JSD where the next position is a supervised response token."""
    pl = position_losses(pairs_for(spark, sf_dir), temperature=1.0)
    return pl.filter(F.col("ce_valid") | F.col("kd_valid")).select(
        "seq", "pos", *[F.round(k, ROUND).alias(k) for k in ("ce", "fkl", "rkl", "jsd")]
    )


KD_LOSSES_SQL = POSITION_LOSS_BODY.replace("{T}", str(KD_TEMPERATURE)) + f"""
, ag AS (SELECT coalesce(avg(ce), 0.0) AS ce, count(*) FILTER (WHERE ce_valid) AS n_ce,
               count(*) FILTER (WHERE kd_valid) AS n_kd,
               coalesce(avg(fkl_all) FILTER (WHERE kd_valid), 0.0) * {KD_TEMPERATURE ** 2} AS fkl,
               coalesce(avg(rkl_all) FILTER (WHERE kd_valid), 0.0) * {KD_TEMPERATURE ** 2} AS rkl,
               coalesce(avg(jsd_all) FILTER (WHERE kd_valid), 0.0) * {KD_TEMPERATURE ** 2} AS jsd FROM pl),
r AS (SELECT 'fkl' AS kind, fkl AS kd, ce, n_kd AS n FROM ag UNION ALL
      SELECT 'rkl', rkl, ce, n_kd FROM ag UNION ALL SELECT 'jsd', jsd, ce, n_kd FROM ag UNION ALL
      SELECT 'ce', 0.0, ce, n_ce FROM ag)
SELECT kind, round(kd, 8) AS kd, round(ce, 8) AS ce,
       round(CASE WHEN kind = 'ce' THEN ce ELSE {KD_ALPHA} * kd + {1 - KD_ALPHA} * ce END, 8) AS loss,
       CAST(n AS BIGINT) AS n_positions
FROM r
"""


@register("kd_losses", KD_LOSSES_SQL)
def q_kd_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked CE, FKL/RKL/JSD at T=2 (x T^2) and the alpha mix."""
    out = kd_losses(pairs_for(spark, sf_dir), temperature=KD_TEMPERATURE, alpha=KD_ALPHA)
    return out.select("kind", *[F.round(c, 8).alias(c) for c in ("kd", "ce", "loss")], "n_positions")


@register("incremental_losses", KD_LOSSES_SQL)
def q_incremental_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same losses from chunks of sequences that come one after another.
    Each chunk's sums are stored once, also if it is sent again; the losses
    come from the stored sums alone."""
    store = scratch_folder(spark, "loss-states")
    pairs = pairs_for(spark, sf_dir).withColumn("chunk", (F.col("seq") % 4).cast("string"))
    for chunk in (0, 1, 1, 2, 3, 0):
        # A chunk that is in already is not computed again.
        states = loss_states(pairs.filter(F.col("chunk") == str(chunk)), temperature=KD_TEMPERATURE, by=["chunk"])
        append_runs(spark, states, store, f"chunk-{chunk}", key="chunk")
    out = losses_of(merge_losses(read_runs(spark, store)), temperature=KD_TEMPERATURE, alpha=KD_ALPHA)
    return out.select("kind", *[F.round(c, 8).alias(c) for c in ("kd", "ce", "loss")], "n_positions")


ACC_SQL = f"""
WITH {BASE_SQL},
g AS (SELECT student, teacher, unnest([{', '.join(str(t) for t in ACC_TEMPERATURES)}]::DOUBLE[]) AS temperature FROM pairs),
a AS ({_lsm_cols('g', 'teacher', 'temperature', 'lp')}),
b AS ({_lsm_cols('a', 'student', 'temperature', 'lq')}),
pq AS (SELECT temperature, list_transform(lp, lambda v: exp(v)) AS p, list_transform(lq, lambda v: exp(v)) AS q FROM b),
per AS (SELECT temperature,
          {_sum('list_transform(p, lambda v, i: least(v, q[i]))')} AS acc,
          -{_sum('list_transform(p, lambda v: v * ln(greatest(v, 1e-12)))')} AS h_target,
          -{_sum('list_transform(q, lambda v: v * ln(greatest(v, 1e-12)))')} AS h_draft FROM pq)
SELECT temperature, round(avg(acc), {ROUND}) AS mean_acceptance, round(avg(h_target), {ROUND}) AS mean_entropy_target,
       round(avg(h_draft), {ROUND}) AS mean_entropy_draft, count(*) AS n_positions
FROM per GROUP BY temperature
"""


@register("expected_acceptance", ACC_SQL)
def q_expected_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25 + A26: mean sum-min(p, q) and entropies per temperature."""
    out = acceptance_by_temperature(pairs_for(spark, sf_dir, with_labels=False), ACC_TEMPERATURES)
    return out.select(
        "temperature",
        *[F.round(c, ROUND).alias(c) for c in ("mean_acceptance", "mean_entropy_target", "mean_entropy_draft")],
        "n_positions",
    )


def _nucleus_sql(src: str, pcol: str) -> str:
    """Adds ``keep`` (list of booleans) for top-p over probabilities ``pcol``."""
    return f"""
SELECT *, list_transform({pcol}, lambda v, i: v > kth.p OR (v = kth.p AND i - 1 <= kth.tok)) AS keep
FROM (SELECT *, srt[greatest(
          len(list_filter(list_transform(srt, lambda e, j: {_sum('list_transform(srt[1:j], lambda z: z.p)')}), lambda c: c <= {TOP_P})), 1)] AS kth
      FROM (SELECT *, list_sort(list_transform({pcol}, lambda v, i: {{'neg': -v, 'tok': i - 1, 'p': v}})) AS srt FROM {src}))
"""


NUCLEUS_SQL = f"""
WITH {BASE_SQL},
a AS ({_lsm_cols('pairs', 'student', '1.0', 'lq')}),
pq AS (SELECT seq, pos, list_transform(lq, lambda v: exp(v)) AS q FROM a),
k AS ({_nucleus_sql('pq', 'q')})
SELECT seq, pos, CAST(len(list_filter(keep, lambda x: x)) AS INTEGER) AS n_kept,
       round({_sum("list_transform(q, lambda v, i: CASE WHEN keep[i] THEN v ELSE 0.0 END)")}, {ROUND}) AS kept_mass,
       CAST(kth.tok AS INTEGER) AS last_kept_token
FROM k
"""


@register("nucleus_filter", NUCLEUS_SQL)
def q_nucleus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-p (0.9) filter of the draft distribution per position."""
    pairs = pairs_for(spark, sf_dir, with_labels=False)
    q = softmax("student", 1.0)
    x = pairs.select("seq", "pos", q.alias("q")).withColumn("keep", nucleus_mask(F.col("q"), TOP_P))
    kept = F.zip_with("q", "keep", lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    ranked_last = F.array_max(
        F.filter(
            F.transform("q", lambda v, i: F.when(F.col("keep")[i], F.struct((-v).alias("neg"), i.alias("tok")))),
            lambda e: e.isNotNull(),
        )
    )
    return x.select(
        "seq",
        "pos",
        F.size(F.filter("keep", lambda m: m)).alias("n_kept"),
        F.round(F.aggregate(kept, F.lit(0.0), lambda a, b: a + b), ROUND).alias("kept_mass"),
        ranked_last["tok"].cast("int").alias("last_kept_token"),
    )


GREEDY_SQL = f"""
WITH {BASE_SQL}
SELECT seq, pos, CAST(list_position(student, list_max(student)) - 1 AS INTEGER) AS draft_token,
       CAST(list_position(teacher, list_max(teacher)) - 1 AS INTEGER) AS target_token,
       list_position(student, list_max(student)) = list_position(teacher, list_max(teacher)) AS agree
FROM pairs
"""


@register("greedy_tokens", GREEDY_SQL)
def q_greedy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy (argmax, lowest id on ties) draft and target tokens."""
    pairs = pairs_for(spark, sf_dir, with_labels=False)
    return pairs.select(
        "seq",
        "pos",
        argmax("student").alias("draft_token"),
        argmax("teacher").alias("target_token"),
        (argmax("student") == argmax("teacher")).alias("agree"),
    )


def _u_sql(salt: str) -> str:
    return (
        f"CAST(('0x' || substr(sha256(concat_ws(':', '{salt}', CAST(seq AS VARCHAR), CAST(pos AS VARCHAR))), 1, 13))::BIGINT AS DOUBLE)"
        f" / {float(1 << 52)}"
    )


def _draw_sql(p: str, u: str) -> str:
    cums = f"list_transform({p}, lambda v, i: {_sum(f'{p}[1:i]')})"
    return f"coalesce(list_position(list_transform({cums}, lambda c: c > {u}), true) - 1, len({p}) - 1)"


VERIFY_SQL = f"""
WITH {BASE_SQL},
a AS ({_lsm_cols('pairs', 'student', '1.0', 'lq')}),
b AS ({_lsm_cols('a', 'teacher', '1.0', 'lp')}),
raw AS (SELECT seq, pos, list_transform(lq, lambda v: exp(v)) AS q0, list_transform(lp, lambda v: exp(v)) AS p0 FROM b),
kq AS ({_nucleus_sql('raw', 'q0')}),
kq2 AS (SELECT seq, pos, p0, list_transform(q0, lambda v, i: CASE WHEN keep[i] THEN v ELSE 0.0 END) AS qk FROM kq),
kp AS ({_nucleus_sql('(SELECT seq, pos, p0, list_transform(qk, lambda v: v / ' + _sum('qk') + ') AS q FROM kq2)', 'p0')}),
d AS (SELECT seq, pos, q, list_transform(p0, lambda v, i: CASE WHEN keep[i] THEN v ELSE 0.0 END) AS pk FROM kp),
dd AS (SELECT seq, pos, q, list_transform(pk, lambda v: v / {_sum('pk')}) AS p FROM d),
x AS (SELECT *, {_draw_sql('q', _u_sql('draft'))} AS tok FROM dd),
acc AS (SELECT *, {_u_sql('accept')} * greatest(q[tok + 1], 1e-12) <= p[tok + 1] AS accepted,
               list_transform(p, lambda v, i: greatest(v - q[i], 0.0)) AS diff FROM x),
res AS (SELECT *, CASE WHEN {_sum('diff')} > 0 THEN list_transform(diff, lambda v: v / {_sum('diff')})
                  ELSE list_transform(p, lambda v, i: CASE WHEN i = list_position(p, list_max(p)) THEN 1.0 ELSE 0.0 END) END AS r FROM acc)
SELECT seq, pos, CAST(tok AS INTEGER) AS draft_token, accepted,
       CAST(CASE WHEN NOT accepted THEN {_draw_sql('r', _u_sql('resample'))} END AS INTEGER) AS resample_token,
       round(p[tok + 1], {ROUND}) AS p_x, round(q[tok + 1], {ROUND}) AS q_x
FROM res
"""


@register("speculative_verify", VERIFY_SQL)
def q_speculative_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per position, draw a draft token from the top-p draft
    distribution, run the accept test against the top-p target
    distribution, and on rejection resample from the residual (p - q)+.
    Uniforms are sha256-derived from (seq, pos), so reruns agree."""
    pairs = pairs_for(spark, sf_dir, with_labels=False)
    x = with_proposal(pairs, "student", "q", "sampling", 1.0, TOP_P)
    x = with_proposal(x, "teacher", "p", "sampling", 1.0, TOP_P).select("seq", "pos", "q", "p")
    x = x.withColumn("tok", categorical_draw(F.col("q"), uniform_from_key("seq", "pos", salt="draft")))
    q_x = F.element_at("q", F.col("tok") + 1)
    p_x = F.element_at("p", F.col("tok") + 1)
    x = x.withColumn("accepted", accept_test(uniform_from_key("seq", "pos", salt="accept"), q_x, p_x))
    resample = categorical_draw(residual_distribution(F.col("p"), F.col("q")), uniform_from_key("seq", "pos", salt="resample"))
    return x.select(
        "seq",
        "pos",
        F.col("tok").alias("draft_token"),
        "accepted",
        F.when(~F.col("accepted"), resample).alias("resample_token"),
        F.round(p_x, ROUND).alias("p_x"),
        F.round(q_x, ROUND).alias("q_x"),
    )


NUCLEUS_LONG_SQL = f"""
WITH {BASE_SQL},
a AS ({_lsm_cols('pairs', 'student', '1.0', 'lq')}),
x AS (SELECT seq, pos, unnest(list_transform(lq, lambda v: exp(v))) AS p, unnest(generate_series(0, len(lq) - 1)) AS tok FROM a),
w AS (SELECT *, row_number() OVER (PARTITION BY seq, pos ORDER BY p DESC, tok) AS rk,
             sum(p) OVER (PARTITION BY seq, pos ORDER BY p DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM x)
SELECT seq, pos, CAST(tok AS INTEGER) AS tok, CAST(rk AS INTEGER) AS rank, (rk = 1 OR cum <= {TOP_P}) AS keep FROM w
"""


@register("nucleus_long_form", NUCLEUS_LONG_SQL)
def q_nucleus_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06 in the long layout (one row per position and token, window per
    position bounded by the vocabulary): probability rank and keep flag."""
    from pyspark.sql import Window

    from sparkdraft.operators.distributions import nucleus_long

    pairs = pairs_for(spark, sf_dir, with_labels=False)
    nl = nucleus_long(pairs, "student", 1.0, TOP_P)
    rank = F.row_number().over(Window.partitionBy("seq", "pos").orderBy(F.col("p").desc(), F.col("tok")))
    return nl.select("seq", "pos", F.col("tok").cast("int").alias("tok"), rank.cast("int").alias("rank"), "keep")
