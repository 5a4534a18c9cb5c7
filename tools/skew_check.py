"""Skew check: one prompt holds a third of all decode steps.

Usage: python tools/skew_check.py [sf_dir]
Reassigns every third event to prompt 0, runs the decode replay (W10-W12)
and reports (a) the largest share of rows in any partition of the
range-partitioned sort the prefix sums run on, and (b) whether the
per-prompt results equal a plain ``Window.partitionBy(prompt)`` reference
(which puts the hot prompt in a single task).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.1"
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from sparkdraft.operators.decode import per_prompt_stats, replay_steps
    from sparkdraft.operators.ordering import stable_sort
    from sparkdraft.plans import decode_queries as dq
    from sparkdraft.session import build_session

    parts = os.environ.get("SKEW_RANGE_PARTITIONS", "32")
    spark = build_session(
        "local[8]", shuffle_partitions=16, extra_conf={"spark.sparkdraft.rangePartitions": parts},
    )
    steps = dq.step_log(spark, sf_dir).withColumn(
        "prompt", F.when(F.col("step") % 3 == 0, F.lit(0)).otherwise(F.col("prompt"))
    )
    n = steps.count()
    hot = steps.filter(F.col("prompt") == 0).count()

    sorted_steps = stable_sort(steps.select("prompt", "step"), ["prompt", "step"])
    sizes = [r["n"] for r in sorted_steps.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]

    t0 = time.time()
    ran = replay_steps(steps, gamma=dq.GAMMA, max_new_tokens=10**9, eos_id=None)
    got = {r["prompt"]: (r["n_steps"], r["total_new_tokens"]) for r in per_prompt_stats(ran, gamma=dq.GAMMA).collect()}
    t_dist = time.time() - t0

    # Reference: the plain window (the hot prompt is one task).
    t0 = time.time()
    w = Window.partitionBy("prompt").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flags = F.zip_with(F.zip_with("u", "q_x", lambda a, b: F.struct(a.alias("u"), b.alias("q"))), "p_x",
                       lambda uq, p: (uq["u"] * F.greatest(uq["q"], F.lit(1e-12))) <= p)
    first_rej = F.array_position(flags, False)
    nacc = F.when(first_rej == 0, F.lit(dq.GAMMA)).otherwise(first_rej - 1)
    ref = steps.select("prompt", "step", (nacc + 1).alias("seg")).withColumn("cum", F.sum("seg").over(w))
    exp = {r["prompt"]: (r["n"], r["t"]) for r in ref.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.max("cum").alias("t")).collect()}
    t_ref = time.time() - t0

    print(json.dumps({
        "rows": n, "hot_prompt_rows": hot, "hot_share": round(hot / n, 3),
        "sorted_partitions": len(sizes), "max_partition_share": round(max(sizes) / n, 3),
        "results_equal": got == exp, "distributed_s": round(t_dist, 2), "single_window_s": round(t_ref, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
