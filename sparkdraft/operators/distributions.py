"""Token distributions and divergences.

Layout: one row per (seq, pos) with logits as ``ARRAY<DOUBLE>`` (the
"array layout"; every per-position quantity is a higher-order function
over the vocabulary, evaluated in the JVM). For very large vocabularies
``nucleus_long`` shows the long layout: one row per (seq, pos, token),
windowed per position (a window bounded by the vocabulary size).

Position t is scored against the label at t+1 (hazard H18): the label
side is re-keyed to ``pos - 1`` and joined on (seq, pos), the same key as
the student/teacher join, so all sides share one hash partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdraft.functions.text import col_

# Clamps used by the divergence and acceptance formulas.
FLOAT32_TINY = 1.1754943508222875e-38
PROB_FLOOR = 1e-12
GREEDY_EPS = 1e-9
IGNORE_INDEX = -100

KD_KINDS = ("fkl", "rkl", "jsd", "ce")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def _with_row_scalar(arr: Column, scalar: Column, fn) -> Column:
    """``transform(arr, v -> fn(v, scalar))`` with ``scalar`` evaluated
    once per row. Referencing a row-level expression inside a lambda would
    re-evaluate it for every element (O(V^2) for a max or a sum)."""
    return F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), fn)


def _with_index_scalar(arr: Column, scalar: Column, fn) -> Column:
    """Like ``_with_row_scalar`` with the 0-based element index: fn(v, i, s)."""
    paired = F.zip_with(arr, F.array_repeat(scalar, F.size(arr)), lambda v, s_: F.struct(v.alias("v"), s_.alias("s")))
    return F.transform(paired, lambda e, i: fn(e["v"], i, e["s"]))


def scaled(logits: str | Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.transform(col_(logits), lambda x: x.cast("double") / t)


def log_softmax(logits: str | Column, temperature: float | Column = 1.0) -> Column:
    """Log-softmax of logits / T, max-shifted for stability."""
    x = scaled(logits, temperature)
    shifted = _with_row_scalar(x, F.array_max(x), lambda v, m: v - m)
    lse = F.log(_sum(F.transform(shifted, lambda v: F.exp(v))))
    return _with_row_scalar(shifted, lse, lambda v, s_: v - s_)


def softmax(logits: str | Column, temperature: float | Column = 1.0) -> Column:
    """Softmax of logits / T."""
    return F.transform(log_softmax(logits, temperature), lambda v: F.exp(v))


def forward_kl(student_logp: Column, teacher_logp: Column) -> Column:
    """KL(teacher || student) = sum p_t (log p_t - log p_s)."""
    return _sum(F.zip_with(teacher_logp, student_logp, lambda t, s: F.exp(t) * (t - s)))


def reverse_kl(student_logp: Column, teacher_logp: Column) -> Column:
    """KL(student || teacher)."""
    return _sum(F.zip_with(student_logp, teacher_logp, lambda s, t: F.exp(s) * (s - t)))


def js_divergence(student_logp: Column, teacher_logp: Column) -> Column:
    """JSD with the mixture clamped to the smallest normal float32."""
    def term(a: Column, b: Column) -> Column:
        lm = F.log(F.greatest(F.lit(0.5) * (F.exp(a) + F.exp(b)), F.lit(FLOAT32_TINY)))
        return F.exp(a) * (a - lm)

    return F.lit(0.5) * (
        _sum(F.zip_with(teacher_logp, student_logp, lambda t, s: term(t, s)))
        + _sum(F.zip_with(student_logp, teacher_logp, lambda s, t: term(s, t)))
    )


def divergence(kind: str, student_logp: Column, teacher_logp: Column) -> Column:
    k = kind.lower()
    if k == "fkl":
        return forward_kl(student_logp, teacher_logp)
    if k == "rkl":
        return reverse_kl(student_logp, teacher_logp)
    if k == "jsd":
        return js_divergence(student_logp, teacher_logp)
    raise ValueError(f"{kind!r} is none of fkl, rkl and jsd")


def argmax(arr: str | Column) -> Column:
    """0-based index of the maximum; the lowest index wins ties."""
    a = col_(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def expected_acceptance(p: Column, q: Column) -> Column:
    """sum_i min(p_i, q_i) = 1 - total variation."""
    return _sum(F.zip_with(p, q, lambda a, b: F.least(a, b)))


def entropy(p: Column) -> Column:
    """-sum p log(max(p, 1e-12))."""
    return -_sum(F.transform(p, lambda v: v * F.log(F.greatest(v, F.lit(PROB_FLOOR)))))


def nucleus_mask(probs: Column, top_p: float) -> Column:
    """W06 (array form): keep-mask over the vocabulary.

    Tokens sorted by probability (desc, lower id first on ties); keep
    those whose inclusive cumulative mass is <= top_p, always the first.
    Active only for 0 < top_p < 1 (all kept otherwise). Since the sorted
    cumulative mass only grows, the kept set is a prefix of length k: k is
    counted with one ``aggregate`` pass, and token i is kept when it sorts
    at or before the k-th element - O(V log V) per position.
    """
    if not 0.0 < top_p < 1.0:
        return F.transform(probs, lambda v: F.lit(True))
    ranked = F.array_sort(
        F.transform(probs, lambda v, i: F.struct((-v).alias("neg"), i.alias("tok"), v.alias("p")))
    )
    init = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("n"))

    def step(acc: Column, e: Column) -> Column:
        cum = acc["cum"] + e["p"]
        return F.struct(cum.alias("cum"), (acc["n"] + F.when(cum <= F.lit(float(top_p)), 1).otherwise(0)).alias("n"))

    k = F.greatest(F.aggregate(ranked, init, step)["n"], F.lit(1))
    kth = F.element_at(ranked, k)
    return _with_index_scalar(
        probs, kth, lambda v, i, t: (v > t["p"]) | ((v == t["p"]) & (i <= t["tok"]))
    )


def nucleus_probs(logits: str | Column, temperature: float, top_p: float) -> Column:
    """W06 + X01: renormalized distribution after the top-p filter."""
    p = softmax(logits, temperature)
    mask = nucleus_mask(p, top_p)
    kept = F.zip_with(p, mask, lambda v, m: F.when(m, v).otherwise(F.lit(0.0)))
    return _with_row_scalar(kept, _sum(kept), lambda v, t: v / t)


def with_proposal(df: DataFrame, logits_col: str, out: str, mode: str, temperature: float, top_p: float) -> DataFrame:
    """X03 staged as columns: probabilities, keep-mask, renormalized
    result. Each stage is its own projection, referenced more than once by
    the next, so the optimizer keeps them separate and every array is
    computed once per row (nested higher-order functions would otherwise
    repeat the inner ones)."""
    if mode == "greedy" or temperature <= 0 or not 0.0 < top_p < 1.0:
        return df.withColumn(out, proposal_distribution(logits_col, mode, temperature, top_p))
    if mode != "sampling":
        raise ValueError(f"unknown sampling mode {mode!r}")
    p, m = f"_{out}_p", f"_{out}_m"
    x = df.withColumn(p, softmax(logits_col, temperature))
    x = x.withColumn(m, nucleus_mask(F.col(p), top_p))
    x = x.withColumn(p, F.zip_with(p, m, lambda v, k: F.when(k, v).otherwise(F.lit(0.0)))).drop(m)
    return x.withColumn(out, _with_row_scalar(F.col(p), _sum(F.col(p)), lambda v, t: v / t)).drop(p)


def proposal_distribution(logits: str | Column, mode: str, temperature: float, top_p: float) -> Column:
    """What a draft sampled from. Greedy (or T <= 0): one-hot at the
    argmax with 1e-9 elsewhere, normalized; sampling: temperature + top-p."""
    a = col_(logits)
    if mode == "greedy" or temperature <= 0:
        raw = _with_index_scalar(a, argmax(a), lambda v, i, top: F.when(i == top, F.lit(1.0)).otherwise(F.lit(GREEDY_EPS)))
        return _with_row_scalar(raw, _sum(raw), lambda v, t: v / t)
    if mode != "sampling":
        raise ValueError(f"unknown sampling mode {mode!r}")
    return nucleus_probs(a, temperature, top_p)


def residual_distribution(p: Column, q: Column) -> Column:
    """(p - q)+ normalized; when it has no mass, one-hot at argmax p."""
    diff = F.zip_with(p, q, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    s = _sum(diff)
    onehot = _with_index_scalar(p, argmax(p), lambda v, i, top: F.when(i == top, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(s > 0, _with_row_scalar(diff, s, lambda v, t: v / t)).otherwise(onehot)


def uniform_from_key(*parts: Column | str, salt: str = "u") -> Column:
    """Reproducible U[0,1) from a key: 52 bits of sha256(salt:parts)."""
    key = F.concat_ws(":", F.lit(salt), *[col_(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def categorical_draw(p: Column, u: Column) -> Column:
    """Inverse-CDF draw: first index whose cumulative mass exceeds u
    (the last index if rounding leaves u above the total)."""
    # u rides in the fold state so it is computed once per row.
    init = F.struct(F.lit(0.0).alias("cum"), F.lit(-1).alias("tok"), F.lit(0).alias("i"), u.alias("u"))

    def step(acc: Column, v: Column) -> Column:
        cum = acc["cum"] + v
        hit = (acc["tok"] < 0) & (cum > acc["u"])
        return F.struct(
            cum.alias("cum"),
            F.when(hit, acc["i"]).otherwise(acc["tok"]).alias("tok"),
            (acc["i"] + 1).alias("i"),
            acc["u"].alias("u"),
        )

    r = F.aggregate(p, init, step)
    return F.when(r["tok"] >= 0, r["tok"]).otherwise(F.size(p) - 1).cast("int")


def accept_test(u: Column, q_x: Column, p_x: Column) -> Column:
    """Accept a drafted token when u * max(q_x, 1e-12) <= p_x."""
    return (u * F.greatest(q_x, F.lit(PROB_FLOOR))) <= p_x


# ---------------------------------------------------------------------------
# Table-level operators
# ---------------------------------------------------------------------------


def pair_positions(student: DataFrame, teacher: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """J13 + F05 input: (seq, pos, student, teacher, next_label, next_mask).

    ``student``/``teacher``: (seq, pos, logits); ``labels``: (seq, pos,
    label, mask). The label side is re-keyed to pos - 1 so all three join
    on (seq, pos); shape mismatches fail the query.
    """
    s = student.select("seq", "pos", F.col("logits").alias("student"))
    t = teacher.select("seq", "pos", F.col("logits").alias("teacher"))
    j = s.join(t, ["seq", "pos"], "inner")
    j = j.withColumn(
        "student",
        F.when(F.size("student") == F.size("teacher"), F.col("student")).otherwise(
            F.raise_error(F.lit("a position has distributions of different lengths"))
        ),
    )
    if labels is None:
        return j
    nxt = labels.select(
        "seq",
        (F.col("pos") - 1).alias("pos"),
        F.col("label").alias("next_label"),
        F.col("mask").alias("next_mask") if "mask" in labels.columns else F.lit(None).cast("boolean").alias("next_mask"),
    )
    return j.join(nxt, ["seq", "pos"], "left")


def valid_position(use_mask: bool = True) -> Column:
    """label[t+1] != -100 and (mask[t+1] when a mask is used)."""
    ok = F.col("next_label").isNotNull() & (F.col("next_label") != IGNORE_INDEX)
    if use_mask:
        ok = ok & F.coalesce(F.col("next_mask"), F.lit(True))
    return ok


def position_losses(pairs: DataFrame, temperature: float = 1.0, keep: Sequence[str] = ()) -> DataFrame:
    """Per valid position: ce (T=1, against next_label) and fkl/rkl/jsd at T; ``keep`` columns pass through.

    CE ignores the response mask (it only skips -100); divergences use it.
    """
    if temperature <= 0:
        raise ValueError(f"divergences need a positive temperature, got {temperature}")
    ls1 = log_softmax("student", 1.0)
    ls = log_softmax("student", temperature)
    lt = log_softmax("teacher", temperature)
    ce = -F.element_at(ls1, F.col("next_label") + 1)
    base = pairs.select(
        *keep,
        "seq",
        "pos",
        valid_position(False).alias("ce_valid"),
        valid_position(True).alias("kd_valid"),
        F.when(valid_position(False), ce).alias("ce"),
        ls.alias("_ls"),
        lt.alias("_lt"),
    )
    return base.select(
        *keep,
        "seq",
        "pos",
        "ce_valid",
        "kd_valid",
        "ce",
        *[F.when(F.col("kd_valid"), divergence(k, F.col("_ls"), F.col("_lt"))).alias(k) for k in ("fkl", "rkl", "jsd")],
    )


LOSS_KINDS = ("fkl", "rkl", "jsd")
#: Partial state of the losses: sums and numbers of positions, at T = 1 for ce and at T for the divergences.
LOSS_STATE = ["n_ce", "n_kd", "ce", *LOSS_KINDS]


def loss_states(pairs: DataFrame, *, temperature: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_ce, n_kd, ce, fkl, rkl, jsd), sums over the positions of
    each part: all that later positions need of earlier ones."""
    losses = position_losses(pairs, temperature, keep=by)
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("ce", *LOSS_KINDS)]
    return losses.groupBy(*by).agg(F.count_if("ce_valid").alias("n_ce"), F.count_if("kd_valid").alias("n_kd"), *sums)


def merge_losses(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The states of parts put together, by the columns ``by`` (all as one without)."""
    zero = {"n_ce": F.lit(0), "n_kd": F.lit(0)}
    return states.groupBy(*by).agg(*[F.coalesce(F.sum(c), zero.get(c, F.lit(0.0))).alias(c) for c in LOSS_STATE])


def losses_of(states: DataFrame, *, temperature: float = 1.0, alpha: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """A21-A23 from states: per row of them one row per kind with (kd, ce, loss, n_positions).

    kd = mean divergence over valid positions x T^2 (0 when none), ce =
    mean NLL over non-ignored positions (0 when none), loss = alpha*kd +
    (1-alpha)*ce; kind 'ce' has kd 0 and loss = ce.
    """
    mean = lambda total, n: F.coalesce(F.try_divide(F.col(total), F.col(n)), F.lit(0.0))
    means = states.select(*by, "n_ce", "n_kd", mean("ce", "n_ce").alias("ce"), *[(mean(k, "n_kd") * F.lit(float(temperature) ** 2)).alias(k) for k in LOSS_KINDS])
    rows = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("kd"), F.col("n_kd").alias("n_positions")) for k in LOSS_KINDS]
    rows.append(F.struct(F.lit("ce").alias("kind"), F.lit(0.0).alias("kd"), F.col("n_ce").alias("n_positions")))
    out = means.select(*by, "ce", F.explode(F.array(*rows)).alias("r")).select(*by, "r.*", "ce")
    loss = F.when(F.col("kind") == "ce", F.col("ce")).otherwise(
        F.lit(float(alpha)) * F.col("kd") + F.lit(1.0 - float(alpha)) * F.col("ce")
    )
    return out.select(*by, "kind", "kd", "ce", loss.alias("loss"), F.col("n_positions").cast("long"))


def kd_losses(pairs: DataFrame, *, temperature: float = 1.0, alpha: float = 0.5) -> DataFrame:
    """A21 + A22 + A23 over all positions: one row per kind (see ``losses_of``).
    The sums are partial aggregates, so chunking the positions cannot change
    them but for the rounding of their order (A24)."""
    return losses_of(loss_states(pairs, temperature=temperature), temperature=temperature, alpha=alpha)


def acceptance_by_temperature(pairs: DataFrame, temperatures: list[float]) -> DataFrame:
    """A25 + A26 per temperature: mean sum-min(p, q) and mean entropies.

    The temperature grid is exploded per row (a literal array, no join).
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature")
    x = pairs.select("student", "teacher", grid)
    p = softmax("teacher", F.col("temperature"))
    q = softmax("student", F.col("temperature"))
    per = x.select(
        "temperature",
        expected_acceptance(p, q).alias("acc"),
        entropy(p).alias("h_target"),
        entropy(q).alias("h_draft"),
    )
    return per.groupBy("temperature").agg(
        F.avg("acc").alias("mean_acceptance"),
        F.avg("h_target").alias("mean_entropy_target"),
        F.avg("h_draft").alias("mean_entropy_draft"),
        F.count(F.lit(1)).alias("n_positions"),
    )


def nucleus_long(dist: DataFrame, logits_col: str, temperature: float, top_p: float) -> DataFrame:
    """W06 in the long layout: one row per (seq, pos, tok) with the
    softmax probability, a per-position window for the cumulative mass
    (sorted by probability desc, token asc) and the keep flag."""
    probs = dist.select("seq", "pos", F.posexplode(softmax(logits_col, temperature)).alias("tok", "p"))
    w = Window.partitionBy("seq", "pos").orderBy(F.col("p").desc(), F.col("tok")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rank = F.row_number().over(Window.partitionBy("seq", "pos").orderBy(F.col("p").desc(), F.col("tok")))
    cum = F.sum("p").over(w)
    active = 0.0 < top_p < 1.0
    keep = (rank == 1) | (cum <= F.lit(float(top_p))) if active else F.lit(True)
    return probs.select("seq", "pos", "tok", "p", cum.alias("cum"), keep.alias("keep"))
