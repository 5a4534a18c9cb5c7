"""Training-curve and run-planning queries.

Stand-ins:
* loss curves: ``events`` rows are logged losses, run = ``event_type``,
  step = ``event_id``, loss = ``value``.
* planned runs: every order is a checkpoint to evaluate; its lineitems are
  the checkpoint's files (line number 1 config.yaml, 2 meta.json,
  3 model/config.json, 4 model/model.safetensors, 5 a shard of other weights,
  6-7 logs); an order with a returned item ('R') already has a summary;
  order status F/O is a finished/failed process (rc 0 / 1), P not run.
* checkpoint metadata: ``customer`` rows (segment, name) are the meta.json
  side of each order's config.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdraft.functions.numeric import display_round, guarded_ratio, round_half_even_int, sort_keys
from sparkdraft.functions.text import entity_key, slug
from sparkdraft.operators.discovery import CONFIG_FILE, MODEL_CONFIG_FILE, WEIGHT_FILES, checkpoint_inventory, checkpoint_records, sweep_table
from sparkdraft.operators.ordering import with_global_index
from sparkdraft.operators.summaries import SUMMARY_SCHEMA, SWEEP_CSV_COLUMNS, flatten_summary
from sparkdraft.operators.sweeps import (
    best_checkpoint,
    convergence_status,
    ema,
    eval_run_name,
    logging_buckets,
    run_status,
    snapshot_rows,
    sweep_rollup,
)
from sparkdraft.plans.registry import register, table

ROUND = 6
BETA = 0.9
SNAPSHOT_EVERY = 1000
LOG_EVERY = 100


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss")
    )


CURVE_SQL = "c AS (SELECT event_type AS run, event_id AS step, value AS loss FROM events)"


EMA_BLOCK = 512
EMA_BODY = f"""{CURVE_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k FROM c),
b AS (SELECT *, (k - 1) // {EMA_BLOCK} AS blk, (k - 1) % {EMA_BLOCK} AS j,
             CASE WHEN k = 1 THEN 1.0 ELSE 1 - {BETA}::DOUBLE END * loss AS wx FROM r),
l AS (SELECT *, power({BETA}::DOUBLE, j) * sum(power({BETA}::DOUBLE, -j) * wx)
                  OVER (PARTITION BY run, blk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS loc FROM b),
e AS (SELECT run, blk, min(k) AS start_k, max(k) AS end_k, arg_max(loc, k) AS lend FROM l GROUP BY run, blk),
inb AS (SELECT e1.run, e1.blk, coalesce(sum(power({BETA}::DOUBLE, (e1.start_k - 1) - e0.end_k) * e0.lend), 0.0) AS ein
        FROM e e1 LEFT JOIN e e0 ON e0.run = e1.run AND e0.blk < e1.blk GROUP BY e1.run, e1.blk),
em AS (SELECT l.run, l.step, power({BETA}::DOUBLE, l.j + 1) * inb.ein + l.loc AS ema
       FROM l JOIN inb ON l.run = inb.run AND l.blk = inb.blk)"""
EMA_SQL = f"WITH {EMA_BODY} SELECT run, step, round(ema, {ROUND}) AS ema FROM em"


@register("loss_convergence", f"""WITH {EMA_BODY}
SELECT c.run, arg_min(c.loss, c.step) AS first, round(any_value(x.last), {ROUND}) AS last, count(*) AS n_points,
       CASE WHEN bool_or(NOT isfinite(c.loss)) THEN 'DIVERGED' WHEN any_value(x.last) < arg_min(c.loss, c.step) THEN 'OK'
            ELSE 'STALLED' END AS status
FROM c JOIN (SELECT run, arg_max(ema, step) AS last FROM em GROUP BY run) x ON c.run = x.run GROUP BY c.run""")
def q_loss_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07 + W08: DIVERGED / OK / STALLED per run, judged on the last EMA
    value against the first loss."""
    cur = curves(spark, sf_dir)
    st = convergence_status(cur, ["run"], "step", "loss", smoothed=ema(cur, ["run"], "step", "loss", BETA))
    return st.withColumn("last", F.round("last", ROUND))


@register("loss_snapshots", f"""WITH {CURVE_SQL}, m AS (SELECT run, max(step) AS last FROM c GROUP BY run)
SELECT c.run, c.step, c.loss FROM c JOIN m ON c.run = m.run
WHERE c.step = 1 OR c.step % {SNAPSHOT_EVERY} = 0 OR c.step = m.last""")
def q_loss_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step 1, every 1000th step and the last step of each run."""
    return snapshot_rows(curves(spark, sf_dir), ["run"], "step", SNAPSHOT_EVERY)


@register("loss_buckets", f"""WITH {CURVE_SQL}
SELECT run, CAST(floor((step - 1) / {LOG_EVERY}) AS BIGINT) AS bucket, round(avg(loss), 9) AS loss_mean, max(step) AS flush_step
FROM c GROUP BY 1, 2""")
def q_loss_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss per logging bucket of 100 steps."""
    b = logging_buckets(curves(spark, sf_dir), ["run"], "step", LOG_EVERY, ["loss"])
    return b.withColumn("loss_mean", F.round("loss_mean", 9))


@register("best_checkpoint", f"""WITH {CURVE_SQL}
SELECT run, arg_min(step, (loss, step)) AS best_step, min(loss) AS best_value FROM c WHERE isfinite(loss) GROUP BY run""")
def q_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step with the lowest loss per run (earliest on ties)."""
    return best_checkpoint(curves(spark, sf_dir), ["run"], "step", "loss")


@register("loss_ema", EMA_SQL)
def q_loss_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beta=0.9 EMA of each run's loss curve, seeded with the first
    point (distributed scan; the oracle uses a blocked closed form)."""
    e = ema(curves(spark, sf_dir), ["run"], "step", "loss", BETA)
    return e.select("run", "step", F.round("ema", ROUND).alias("ema"))


# ---------------------------------------------------------------------------
# Run planning over orders / lineitem / customer
# ---------------------------------------------------------------------------

FILE_BY_LINE = ["config.yaml", "meta.json", "model/config.json", "model/model.safetensors",
                "model/pytorch_model-00001-of-00002.bin", "logs/train.log", "logs/train.log"]


def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"),
        F.element_at(F.array(*[F.lit(x) for x in FILE_BY_LINE]), F.col("l_linenumber")).alias("file"),
        F.col("l_returnflag"),
    )


INVENTORY_SQL = f"""
f AS (SELECT l_orderkey AS run_id, {FILE_BY_LINE!r}[l_linenumber] AS file, l_returnflag FROM lineitem),
inv AS (SELECT run_id, bool_or(file = '{CONFIG_FILE}') AS hc, bool_or(file = '{MODEL_CONFIG_FILE}') AS hm,
               bool_or(regexp_matches(file, '{WEIGHT_FILES}')) AS hw FROM f GROUP BY run_id),
ck AS (SELECT run_id, hc AND hm AND hw AS complete,
              CASE WHEN NOT (hc AND hm AND hw) THEN concat_ws('; ',
                   CASE WHEN NOT hc THEN 'missing {CONFIG_FILE}' END, CASE WHEN NOT hm THEN 'missing {MODEL_CONFIG_FILE}' END,
                   CASE WHEN NOT hw THEN 'missing model weights' END) END AS reason FROM inv)
"""


@register("checkpoint_inventory", f"WITH {INVENTORY_SQL} SELECT * FROM ck")
def q_checkpoint_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04 + F06: complete / incomplete checkpoints with reasons."""
    return checkpoint_inventory(artifact_files(spark, sf_dir))


@register("runs_to_execute", f"""WITH {INVENTORY_SQL},
done AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'R')
SELECT ck.run_id, 'ckpt-' || ck.run_id || '_eval_g4_max256' AS run FROM ck
WHERE ck.complete AND NOT EXISTS (SELECT 1 FROM done WHERE done.run_id = ck.run_id)""")
def q_runs_to_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete checkpoints that have no summary yet (left anti join
    on the run id; both sides are shuffled on it, no broadcast assumed)."""
    files = artifact_files(spark, sf_dir)
    ck = checkpoint_inventory(files).filter("complete")
    done = files.filter(F.col("l_returnflag") == "R").select("run_id").distinct()
    todo = ck.join(done, "run_id", "left_anti")
    return todo.select("run_id", eval_run_name(F.concat(F.lit("ckpt-"), F.col("run_id")), F.lit(4), F.lit(256)).alias("run"))


STATUS_SQL = f"""WITH {INVENTORY_SQL},
done AS (SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_returnflag = 'R'),
st AS (SELECT o.o_orderkey AS run_id,
              CASE WHEN NOT coalesce(ck.complete, false) THEN 'missing_checkpoint'
                   WHEN o.o_orderstatus NOT IN ('F', 'O') THEN 'not_run'
                   WHEN o.o_orderstatus = 'F' AND done.run_id IS NOT NULL THEN 'ok'
                   WHEN o.o_orderstatus = 'F' THEN 'missing' ELSE 'failed' END AS status
       FROM orders o LEFT JOIN ck ON o.o_orderkey = ck.run_id LEFT JOIN done ON o.o_orderkey = done.run_id)
"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = artifact_files(spark, sf_dir)
    ck = checkpoint_inventory(files)
    done = files.filter(F.col("l_returnflag") == "R").select("run_id").distinct().withColumn("has_summary", F.lit(True))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus")
    rc = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    j = o.join(ck, "run_id", "left").join(done, "run_id", "left")
    return j.select(
        "run_id",
        run_status(rc, F.coalesce("has_summary", F.lit(False)), F.lit(False), F.coalesce("complete", F.lit(False))).alias("status"),
    )


@register("run_statuses", STATUS_SQL + " SELECT * FROM st")
def q_run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01 + J02 + A33: every planned run joined (left) to its checkpoint,
    process result and summary; status per run."""
    return _statuses(spark, sf_dir)


@register("sweep_rollup", STATUS_SQL + """
SELECT count(*) AS n_runs, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'failed') AS n_failed,
       count(*) FILTER (WHERE status = 'cached') AS n_cached, count(*) FILTER (WHERE status = 'missing_checkpoint') AS n_missing_checkpoint,
       count(*) FILTER (WHERE status = 'missing') AS n_missing, count(*) FILTER (WHERE status = 'not_run') AS n_not_run,
       coalesce(bool_or(status = 'failed'), false) AS any_failed,
       CASE WHEN coalesce(bool_or(status = 'failed'), false) THEN 'failure' ELSE 'success' END AS outcome
FROM st""")
def q_sweep_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per status, any failure => failure."""
    return sweep_rollup(_statuses(spark, sf_dir))


@register("run_entities", r"""
WITH s AS (SELECT c_custkey, c_name,
                  lower(regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS sl FROM customer)
SELECT c_custkey, coalesce(nullif(sl, ''), 'model') AS slug,
       coalesce(nullif(sl, ''), 'model') || '-' || substr(sha256(c_name), 1, 10) AS entity_key FROM s""")
def q_run_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker entity slug and hashed key per model name."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", slug("c_name").alias("slug"), entity_key("c_name").alias("entity_key"))


@register("config_resolution", """
SELECT o.o_orderkey AS run_id,
       coalesce(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'urgent_set' END, lower(c.c_mktsegment), 'unknown') AS data_id,
       coalesce(CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderstatus END, CASE WHEN c.c_acctbal > 0 THEN 'meta' END, 'inferred') AS response_source
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def q_config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run config left-joined to checkpoint metadata with a
    per-field precedence (config, then metadata, then inferred)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.select(
        F.col("o_orderkey").alias("run_id"),
        F.coalesce(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent_set")), F.lower("c_mktsegment"),
                   F.lit("unknown")).alias("data_id"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
                   F.when(F.col("c_acctbal") > 0, F.lit("meta")), F.lit("inferred")).alias("response_source"),
    )


EXPERIMENT_SQL = """
WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'pretrained' WHEN '2-HIGH' THEN 'ce' WHEN '3-MEDIUM' THEN 'fkl'
                  WHEN '4-NOT SPECIFIED' THEN 'rkl' ELSE 'jsd' END AS kind,
                  CASE WHEN o_orderstatus = 'O' THEN 'target_generated' ELSE 'original' END AS source,
                  CAST(c_nationkey AS BIGINT) * 1000 AS n_samples, o_custkey AS seed
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey AS run_id,
       concat_ws('_', kind, replace(source, '_generated', 'gen'), CAST(n_samples AS VARCHAR), 'seed' || CAST(seed AS VARCHAR),
                 substr(sha256(to_json({'kind': kind, 'n_samples': n_samples, 'seed': seed, 'source': source})), 1, 8)) AS run_name
FROM o
"""


@register("experiment_keys", EXPERIMENT_SQL)
def q_experiment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable, hash-suffixed run names from each planned run's
    identity (loss kind, response source, sample count, seed)."""
    from sparkdraft.operators.summaries import experiment_key

    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "pretrained").when(F.col("o_orderpriority") == "2-HIGH", "ce").when(
        F.col("o_orderpriority") == "3-MEDIUM", "fkl").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "rkl").otherwise("jsd")
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        "o_orderkey",
        kind.alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "target_generated").otherwise("original").alias("source"),
        (F.col("c_nationkey").cast("long") * 1000).alias("n_samples"),
        F.col("o_custkey").alias("seed"),
    )
    return j.select(
        F.col("o_orderkey").alias("run_id"),
        experiment_key(["kind", "source", "n_samples", "seed"], "kind", "source", "n_samples", "seed").alias("run_name"),
    )


LOG_SQL = r"""
WITH t AS (SELECT event_id,
                  'step ' || CAST(event_id AS VARCHAR) || chr(13) || '{''loss'': ' || json_extract_string(props, '$.k')
                  || ', ''eval_loss'': ' || printf('%.2f', value) || '}' || chr(10) || '{''eval_loss'': '
                  || json_extract_string(props, '$.k') || '.5} {''eval_loss'': 0.25}' AS value FROM events),
l AS (SELECT event_id, unnest(regexp_split_to_array(value, '[\r\n]+')) AS line,
             unnest(generate_series(0, len(regexp_split_to_array(value, '[\r\n]+')) - 1)) AS line_no FROM t),
m AS (SELECT event_id, line_no, unnest(regexp_extract_all(line, '''eval_loss'': ([0-9.]+)', 1)) AS v,
             unnest(generate_series(0, len(regexp_extract_all(line, '''eval_loss'': ([0-9.]+)', 1)) - 1)) AS match_no FROM l)
SELECT event_id, CAST(line_no AS INTEGER) AS line_no, CAST(match_no AS INTEGER) AS match_no, CAST(v AS DOUBLE) AS eval_loss FROM m
"""


@register("log_eval_losses", LOG_SQL)
def q_log_eval_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eval-loss extraction from trainer log text. Stand-in: each
    event renders its own two-line log snippet (a progress line ending in
    a carriage return, then dict fragments); the parser splits lines in
    order and extracts every ``'eval_loss': x``."""
    from sparkdraft.sources.files import eval_losses_from_text

    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit("step "), F.col("event_id").cast("string"), F.lit("\r{'loss': "), k,
        F.lit(", 'eval_loss': "), F.format_string("%.2f", "value"), F.lit("}\n{'eval_loss': "), k,
        F.lit(".5} {'eval_loss': 0.25}"),
    )
    return eval_losses_from_text(ev.select("event_id", text.alias("value")), ["event_id"])


SAMPLING_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'greedy' ELSE 'sampling' END AS mode,
                  (o_custkey % 5) * 0.5 AS t, 0.9 AS p, o_orderkey AS seed, 128 * (1 + o_custkey % 3) AS n,
                  CASE o_orderstatus WHEN 'F' THEN ' None ' WHEN 'O' THEN 'ckpt-' || CAST(o_custkey AS VARCHAR) END AS draft
           FROM orders)
SELECT o_orderkey AS run_id, CAST(n AS INTEGER) AS max_tokens,
       CAST(CASE WHEN mode = 'greedy' THEN 0.0 ELSE t END AS DOUBLE) AS temperature,
       CAST(CASE WHEN mode = 'greedy' THEN 1.0 ELSE p END AS DOUBLE) AS top_p,
       CASE WHEN mode = 'sampling' THEN seed END AS seed,
       (draft IS NULL OR lower(trim(draft)) IN ('', 'none', 'null', 'vanilla')) AS null_draft
FROM o
"""


@register("sampling_configs", SAMPLING_SQL)
def q_sampling_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 + P16: generation parameters per planned run (greedy forces
    temperature 0, top_p 1 and no seed) and whether its draft spec means
    "no draft". Stand-in: priority 1/2 -> greedy, temperature from the
    customer key, draft spec from the order status."""
    from sparkdraft.functions.text import is_null_draft
    from sparkdraft.operators.decode import sampling_params

    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "greedy").otherwise("sampling").alias("mode"),
        ((F.col("o_custkey") % 5) * 0.5).alias("t"),
        F.lit(0.9).alias("p"),
        F.col("o_orderkey").alias("seed"),
        (F.lit(128) * (F.col("o_custkey") % 3 + 1)).alias("n"),
        F.when(F.col("o_orderstatus") == "F", " None ").when(
            F.col("o_orderstatus") == "O", F.concat(F.lit("ckpt-"), F.col("o_custkey").cast("string"))
        ).alias("draft"),
    )
    s = sampling_params("mode", "t", "p", "seed", "n")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        s["max_tokens"].alias("max_tokens"),
        s["temperature"].alias("temperature"),
        s["top_p"].alias("top_p"),
        s["seed"].alias("seed"),
        is_null_draft("draft").alias("null_draft"),
    )


LOOKUP_SQL = """
WITH runs AS (SELECT o_orderkey, '/runs/' || CAST(o_custkey AS VARCHAR) AS parent,
                     '/runs/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS dir FROM orders),
meta AS (SELECT '/runs/' || CAST(c_custkey AS VARCHAR) AS path, c_mktsegment AS dataset_id FROM customer WHERE c_acctbal > 0
         UNION ALL
         SELECT '/runs/' || CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders
         WHERE o_orderstatus = 'F')
SELECT r.o_orderkey AS run_id, CASE WHEN a.path IS NOT NULL THEN a.path WHEN b.path IS NOT NULL THEN b.path END AS meta_path,
       CASE WHEN a.path IS NOT NULL THEN a.dataset_id WHEN b.path IS NOT NULL THEN b.dataset_id END AS dataset_id
FROM runs r LEFT JOIN meta a ON r.parent = a.path LEFT JOIN meta b ON r.dir = b.path
"""


@register("checkpoint_meta_lookup", LOOKUP_SQL)
def q_checkpoint_meta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint metadata by candidate paths, first hit wins (the
    parent directory, then the run directory). Stand-in: customers with a
    positive balance have a parent-level meta file, finished orders a
    run-level one."""
    from sparkdraft.operators.summaries import first_hit_lookup

    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    runs = o.select(
        "o_orderkey",
        F.concat(F.lit("/runs/"), F.col("o_custkey").cast("string")).alias("parent"),
        F.concat(F.lit("/runs/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("dir"),
    )
    meta = c.filter(F.col("c_acctbal") > 0).select(
        F.concat(F.lit("/runs/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("dataset_id")
    ).unionByName(
        o.filter(F.col("o_orderstatus") == "F").select(
            F.concat(F.lit("/runs/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"),
            F.col("o_orderpriority").alias("dataset_id"),
        )
    )
    out = first_hit_lookup(runs, meta, ["parent", "dir"])
    return out.select(F.col("o_orderkey").alias("run_id"), "meta_path", "dataset_id")


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in configs: an order is a run's configuration, with gaps."""
    o = table(spark, sf_dir, "orders")
    some = lambda n, c: F.when(F.col("o_custkey") % n != 0, c)
    return o.select(
        F.col("o_orderkey").cast("string").alias("dir"),
        some(2, F.concat(F.lit("run-"), F.col("o_orderkey"))).alias("run_name"),
        some(3, F.lower("o_orderpriority")).alias("data_id"),
        some(5, F.lit("original")).alias("response_source"),
        some(7, F.lit("target-32b")).alias("target"),
        some(4, F.lit("small-init")).alias("draft_init"),
        some(6, F.lit("draft-default")).alias("draft_default"),
        some(11, F.lit("jsd")).alias("loss_kind"),
        some(2, F.lit(0.5)).alias("loss_alpha"),
        some(3, F.lit(2.0)).alias("loss_temperature"),
        F.col("o_custkey").alias("seed"),
        some(2, F.lit(1000)).alias("steps"),
        F.concat(F.lit("/prompts/"), F.lower("o_orderstatus"), F.lit(".jsonl")).alias("prompts_jsonl"),
    )


def run_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in metadata of finished trainings: orders of status F and O."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    return o.select(
        F.col("o_orderkey").cast("string").alias("dir"),
        F.when(F.col("o_custkey") % 4 != 0, F.concat(F.lit("meta_ultrachat_50k_target_gen_"), F.col("o_orderkey"))).otherwise(F.lit("")).alias("run_name"),
        F.when(F.col("o_custkey") % 9 == 0, F.lit("meta_set")).alias("dataset_id"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit("trained-init")).otherwise(F.lit("")).alias("draft_init"),
        (F.col("o_custkey") % 100 / 10.0).alias("train_loss_final"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(900)).alias("steps"),
    )


def _data_id_sql(run: str) -> str:
    from sparkdraft.operators.sweeps import DATA_IDS

    return "CASE " + " ".join(f"WHEN contains({run}, '{d}') THEN '{d}'" for d in DATA_IDS) + " ELSE '' END"


RECORDS_SQL = f"""{INVENTORY_SQL},
cf AS (SELECT CAST(o_orderkey AS VARCHAR) AS dir, o_custkey AS k, o_orderkey AS ok, lower(o_orderpriority) AS pr, lower(o_orderstatus) AS st, o_orderstatus <> 'P' AS fin FROM orders),
r0 AS (SELECT cf.*, CASE WHEN k % 2 <> 0 THEN 'run-' || ok WHEN fin AND k % 4 <> 0 THEN 'meta_ultrachat_50k_target_gen_' || ok ELSE dir END AS checkpoint_run
       FROM cf JOIN ck ON CAST(ck.run_id AS VARCHAR) = cf.dir WHERE ck.complete),
r1 AS (SELECT *, CASE WHEN k % 3 <> 0 THEN pr WHEN fin AND k % 9 = 0 THEN 'meta_set' ELSE {_data_id_sql("checkpoint_run")} END AS data_id FROM r0),
rec AS (SELECT checkpoint_run || '_eval_g4_max256' AS run, checkpoint_run, dir AS checkpoint_dir_name,
    CASE WHEN k % 7 <> 0 THEN 'target-32b' ELSE 'target-8b' END AS target_model,
    CASE WHEN fin AND k % 5 = 0 THEN 'trained-init' WHEN k % 4 <> 0 THEN 'small-init' WHEN k % 6 <> 0 THEN 'draft-default' ELSE '' END AS draft_init,
    CASE WHEN k % 11 <> 0 THEN 'jsd' ELSE '' END AS loss_kind, CASE WHEN k % 2 <> 0 THEN 0.5::DOUBLE END AS loss_alpha, CASE WHEN k % 3 <> 0 THEN 2.0::DOUBLE END AS loss_temperature,
    data_id, CASE WHEN k % 5 <> 0 THEN 'original' WHEN ends_with(data_id, '_target_gen') OR contains(checkpoint_run, '_tgen_') THEN 'target_generated' ELSE 'original' END AS response_source,
    k AS seed, CASE WHEN fin THEN k % 100 / 10.0::DOUBLE END AS train_loss_final, CAST(CASE WHEN fin AND k % 3 = 0 THEN 900 WHEN k % 2 <> 0 THEN 1000 END AS INTEGER) AS steps,
    '/ckpt/' || dir AS checkpoint_dir, '/ckpt/' || dir || '/model' AS model_dir, '/ckpt/' || dir || '/config.yaml' AS config_path, '/prompts/' || st || '.jsonl' AS prompts_jsonl,
    '/results/' || checkpoint_run || '_eval_g4_max256/eval_summary.json' AS summary_path FROM r1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint_records(
        checkpoint_inventory(artifact_files(spark, sf_dir)), run_configs(spark, sf_dir), run_metas(spark, sf_dir),
        gamma=4, max_new_tokens=256, default_target="target-8b", checkpoint_root="/ckpt", results_root="/results",
    )


@register("checkpoint_records", f"WITH {RECORDS_SQL} SELECT * FROM rec")
def q_checkpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J04 + J05: inventory to complete checkpoints to run records, with the
    precedence of config, metadata and inference settled field by field."""
    return _records(spark, sf_dir)


EVAL_CONFIG = {"eval_backend": "vllm", "runtime_mode": "greedy", "runtime_temperature": 0.0, "runtime_top_p": 1.0, "gamma": 4, "max_new_tokens": 256, "run_vanilla_baseline": True}
_TABLE_SQL = {
    **{c: f"rec.{c}" for c in ("run", "checkpoint_run", "checkpoint_dir_name", "target_model", "draft_init", "loss_kind", "loss_alpha", "loss_temperature", "data_id", "response_source", "seed", "train_loss_final", "steps", "checkpoint_dir", "model_dir", "config_path", "prompts_jsonl", "summary_path")},
    "status": "coalesce(s.status, 'not_run')", "returncode": "s.rc", "elapsed_s": "s.elapsed",
    "eval_backend": "'vllm'", "runtime_mode": "'greedy'", "runtime_temperature": "0.0::DOUBLE", "runtime_top_p": "1.0::DOUBLE", "gamma": "4", "max_new_tokens": "256", "run_vanilla_baseline": "true",
    "speedup": "m.k % 50 / 10.0::DOUBLE", "acceptance_rate": "m.k % 10 / 10.0::DOUBLE", "avg_accepted_tokens": "CASE WHEN m.k IS NOT NULL AND m.k % 8 <> 0 THEN 1.5::DOUBLE END",
    "tokens_per_second": "CAST(m.k AS DOUBLE)", "sd_time_s": "CASE WHEN m.k IS NOT NULL THEN 2.0::DOUBLE END", "vanilla_time_s": "CAST(NULL AS DOUBLE)",
    "n_prompts": "CASE WHEN m.k IS NOT NULL THEN 32 END", "n_warmup": "CASE WHEN m.k IS NOT NULL THEN 1 END", "n_repeats": "CASE WHEN m.k IS NOT NULL THEN 3 END",
    "vllm_num_drafts": "CAST(m.k AS BIGINT)", "vllm_num_draft_tokens": "CAST(4 * m.k AS BIGINT)", "vllm_num_accepted_tokens": "CAST(2 * m.k AS BIGINT)", "vllm_request_batch_size": "CASE WHEN m.k IS NOT NULL THEN CAST(8 AS BIGINT) END",
}
SWEEP_TABLE_SQL = f"""WITH {RECORDS_SQL},
s AS (SELECT checkpoint_run || '_eval_g4_max256' AS run, CASE WHEN st = 'f' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN st = 'f' THEN 0 ELSE 1 END AS rc, CAST(k AS DOUBLE) AS elapsed FROM r1 WHERE fin),
m AS (SELECT '/results/' || checkpoint_run || '_eval_g4_max256/eval_summary.json' AS summary_path, k FROM r1 WHERE st = 'f')
SELECT {", ".join(f"{e} AS {c}" for c, e in _TABLE_SQL.items())}, CASE WHEN m.k IS NOT NULL THEN 0.25::DOUBLE END AS "quality_score.exact_match_vs_target"
FROM rec LEFT JOIN s ON s.run = rec.run LEFT JOIN m ON m.summary_path = rec.summary_path"""


@register("sweep_table", SWEEP_TABLE_SQL)
def q_sweep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01 + J02 + P23: run records with process status and the flattened
    metrics of their summary documents. Stand-in: finished orders have a
    status, those of status F a summary document."""
    records = _records(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("checkpoint_dir_name"), "o_orderstatus", F.col("o_custkey").alias("k"))
    runs = records.select("run", "summary_path", "checkpoint_dir_name").join(o, "checkpoint_dir_name")
    ok = F.col("o_orderstatus") == "F"
    statuses = runs.filter(F.col("o_orderstatus") != "P").select("run", F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, 0).otherwise(1).alias("returncode"), F.col("k").cast("double").alias("elapsed_s"))
    doc = F.to_json(
        F.struct(
            (F.col("k") % 50 / 10.0).alias("speedup"), (F.col("k") % 10 / 10.0).alias("acceptance_rate"),
            F.when(F.col("k") % 8 != 0, F.lit(1.5)).otherwise(F.lit(float("nan"))).alias("avg_accepted_tokens"),
            F.col("k").cast("double").alias("tokens_per_second"), F.lit(2.0).alias("sd_time_s"), F.lit(float("nan")).alias("vanilla_time_s"),
            F.lit(32).alias("n_prompts"), F.lit(1).alias("n_warmup"), F.lit(3).alias("n_repeats"),
            F.create_map(F.lit("exact_match_vs_target"), F.lit(0.25)).alias("quality_score"),
            F.struct(F.struct(F.col("k").alias("num_drafts"), (4 * F.col("k")).alias("num_draft_tokens"), (2 * F.col("k")).alias("num_accepted_tokens"), F.lit(8).alias("request_batch_size")).alias("vllm")).alias("engines"),
        ),
        {"allowNonNumericNumbers": "true"},
    )
    docs = runs.filter(ok).select("summary_path", F.from_json(doc, SUMMARY_SCHEMA, {"allowNonNumericNumbers": "true"}).alias("s")).select("summary_path", "s.*")
    names = ["exact_match_vs_target"]
    out = sweep_table(records, statuses, flatten_summary(docs, names, keep=("summary_path",)), EVAL_CONFIG, names)
    assert out.columns[: len(SWEEP_CSV_COLUMNS)] == SWEEP_CSV_COLUMNS
    return out


CACHE_STATES_SQL = """
WITH m AS (SELECT s_suppkey AS cache, unnest(['train', 'val']) AS split, s_suppkey AS k FROM supplier),
f AS (SELECT cache, split, k % 4 <> 0 AND NOT (k % 4 = 2 AND split = 'val') AS named, k % 4 = 1 AND split = 'train' AS other, k % 4 <> 0 AND NOT (k % 8 = 6 AND split = 'train') AS filled FROM m),
g AS (SELECT cache, count(*) FILTER (WHERE named OR filled) AS n_present, count(*) FILTER (WHERE other) AS n_mismatch, 2 - count(*) FILTER (WHERE named AND filled) AS n_incomplete FROM f GROUP BY cache)
SELECT cache, CASE WHEN n_present = 0 THEN 'absent' WHEN n_mismatch > 0 THEN 'mismatch' WHEN n_incomplete > 0 THEN 'partial' ELSE 'reuse' END AS state,
       n_present, n_mismatch, CAST(n_incomplete AS BIGINT) AS n_incomplete FROM g
"""


@register("cache_states", CACHE_STATES_SQL)
def q_cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 over many caches. Stand-in: a supplier is a cache with a train and a
    val split; by its key a manifest is missing, names another model, or the
    data of a split is empty."""
    from sparkdraft.operators.sweeps import cache_state

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cache"), F.explode(F.array(F.lit("train"), F.lit("val"))).alias("split"))
    k = F.col("cache") % 4
    manifest = F.when((k != 0) & ~((k == 2) & (F.col("split") == "val")), F.when((k == 1) & (F.col("split") == "train"), "other-model").otherwise("target-8b"))
    rows = F.when((k != 0) & ~((F.col("cache") % 8 == 6) & (F.col("split") == "train")), F.lit(100)).otherwise(F.lit(0))
    return cache_state(s.select("cache", "split", manifest.alias("target_model")), s.select("cache", "split", rows.alias("n_rows")), "target-8b", cache_col="cache")


#: Stand-in for a loss that overflows: every so many steps of the view runs.
OVERFLOW = 2000
DIVERGING_BODY = EMA_BODY.replace(
    CURVE_SQL,
    f"""raw AS (SELECT event_type AS run, event_id AS step, CASE WHEN event_type = 'view' AND event_id % {OVERFLOW} > {OVERFLOW // 2} THEN 'NaN'::DOUBLE ELSE value END AS loss FROM events),
ends AS (SELECT run, min(step) AS stop FROM raw WHERE NOT isfinite(loss) GROUP BY run),
c AS (SELECT raw.* FROM raw LEFT JOIN ends ON raw.run = ends.run WHERE stop IS NULL OR step < stop)""",
)


@register("diverging_curves", f"""WITH {DIVERGING_BODY}
SELECT raw.run, count(*) AS n_points, CAST(any_value(x.n) AS BIGINT) AS n_before, round(any_value(x.last), {ROUND}) AS last,
       CASE WHEN bool_or(NOT isfinite(raw.loss)) THEN 'DIVERGED' WHEN any_value(x.last) < arg_min(raw.loss, raw.step) THEN 'OK' ELSE 'STALLED' END AS status
FROM raw LEFT JOIN (SELECT run, arg_max(ema, step) AS last, count(*) AS n FROM em GROUP BY run) x ON raw.run = x.run GROUP BY raw.run""")
def q_diverging_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W07 + W08 on curves of which some overflow to NaN: the EMA ends before
    the first such step, the run is DIVERGED."""
    bad = (F.col("run") == "view") & (F.col("step") % OVERFLOW > OVERFLOW // 2)
    c = curves(spark, sf_dir).withColumn("loss", F.when(bad, F.lit(float("nan"))).otherwise(F.col("loss")))
    smooth = ema(c, ["run"], "step", "loss", BETA)
    status = convergence_status(c, ["run"], "step", "loss", smooth, "ema")
    before = smooth.groupBy("run").agg(F.count("*").alias("n_before"))
    return status.join(before, "run", "left").select("run", "n_points", "n_before", F.round("last", ROUND).alias("last"), "status")


@register("ranked_runs", """
SELECT row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey, o_orderpriority, CAST(round_even(o_totalprice / 100, 0) AS BIGINT) AS hundreds,
       round(o_totalprice / 1000, 1) AS thousands, round(CASE WHEN o_custkey > 0 THEN CAST(o_totalprice AS DOUBLE) / o_custkey ELSE 0.0 END, 9) AS per_customer FROM orders""")
def q_ranked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L05 + X13 + X14 + X18: runs in the order of several keys, with rounded and
    guarded figures as a report shows them. Stand-in: orders by priority, then price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    placed = with_global_index(o, sort_keys(("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)), "place")
    price = F.col("o_totalprice")
    return placed.select(
        "place", "o_orderkey", "o_orderpriority", round_half_even_int(price / 100).alias("hundreds"), display_round(price / 1000, 1).alias("thousands"), F.round(guarded_ratio("o_totalprice", "o_custkey", 0.0), 9).alias("per_customer")
    )
