"""Order-dependent building blocks that stay distributed.

A positional index or a running sum over a global order is, written
naively, a window without ``partitionBy`` (one task for all rows) or a
window partitioned by a group key (one task for a hot group). Both are
expressed here as:

1. a range-partitioned sort on the full order key (Spark samples the key,
   so a hot group is split across many partitions),
2. a reliable ``checkpoint()`` into ``spark.checkpoint.dir`` so partition
   ids and in-partition order are fixed and survive executor loss,
3. a per-partition pass plus a small carry table (one row per partition
   boundary, bounded by the partition count) that is broadcast back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.session import ensure_checkpoint_dir

_PID = "__ord_pid"
_POS = "__ord_pos"
# monotonically_increasing_id packs the partition id above bit 33.
_MID_SHIFT = 1 << 33


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


RANGE_PARTITIONS_CONF = "spark.sparkdraft.rangePartitions"


#: Input bytes per range partition, and what no real input's size reaches
#: (a leaf without statistics reports more).
RANGE_PARTITION_BYTES = 128 << 20
_NO_STATISTICS = 1 << 57


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, by the optimizer's statistics of
    the plan's leaves (those of joins above them are mere products)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < _NO_STATISTICS)


def _range_partitions(df: DataFrame, num_partitions: int | None) -> int | None:
    """Range-partition count: the argument, else the session setting
    ``spark.sparkdraft.rangePartitions``, else the input's bytes over
    RANGE_PARTITION_BYTES if that is more than ``spark.sql.shuffle.partitions``;
    else None (Spark's own number, coalesced at run time). Adaptive execution
    never splits large range partitions, so the count follows the input."""
    spark = df.sparkSession
    asked = num_partitions or spark.conf.get(RANGE_PARTITIONS_CONF, None)
    if asked:
        return int(asked)
    n = -(-_input_bytes(df) // RANGE_PARTITION_BYTES)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def stable_sort(
    df: DataFrame, order_cols: Sequence[str | Column], num_partitions: int | None = None
) -> DataFrame:
    """Globally sort (range partitioning) and checkpoint the result.

    The returned DataFrame has fixed partitions whose concatenation is in
    ``order_cols`` order. Ties in ``order_cols`` have no defined order, so
    callers pass a unique tie-break as the last key.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = _cols(order_cols)
    n = _range_partitions(df, num_partitions)
    if n:
        sorted_df = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    else:
        sorted_df = df.orderBy(*cols)
    return sorted_df.checkpoint(eager=True)


def _partition_offsets(sorted_df: DataFrame) -> DataFrame:
    """(pid, offset) where offset = rows in all earlier partitions.

    One row per partition: the window without partitionBy runs over at
    most ``numPartitions`` rows, and the result is broadcast.
    """
    counts = sorted_df.groupBy(F.spark_partition_id().alias(_PID)).agg(
        F.count(F.lit(1)).alias("__ord_n")
    )
    w = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(_PID, F.coalesce(F.sum("__ord_n").over(w), F.lit(0)).alias("__ord_off"))


def with_global_index(
    df: DataFrame, order_cols: Sequence[str | Column], name: str = "idx"
) -> DataFrame:
    """Add a 0-based dense position ``name`` under ``order_cols``.

    Equivalent to ``row_number() OVER (ORDER BY order_cols) - 1`` but with
    no single-task window: the in-partition position comes from
    ``monotonically_increasing_id`` on the checkpointed sort, the
    partition offset from a broadcast table of partition counts.
    """
    s = stable_sort(df, order_cols)
    s = s.withColumn(_PID, F.spark_partition_id()).withColumn(
        _POS, F.monotonically_increasing_id() - F.col(_PID).cast("long") * F.lit(_MID_SHIFT)
    )
    offsets = _partition_offsets(s.drop(_PID, _POS))
    out = s.join(F.broadcast(offsets), _PID, "left")
    return out.withColumn(name, (F.col("__ord_off") + F.col(_POS)).cast("long")).drop(
        _PID, _POS, "__ord_off"
    )


def one_row_per_key(df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """``df`` if its keys are unique; the query fails on the first key that is
    not (null is a key like any other). One aggregate, for narrow tables."""
    rest = [c for c in df.columns if c not in key_cols]
    found = df.groupBy(*key_cols).agg(*[F.min(c).alias(c) for c in rest], F.count(F.lit(1)).alias("__ord_n"))
    said = F.concat(F.lit("a key stands for several rows: "), F.to_json(F.struct(*key_cols)))
    # A filter stays in the plan whatever columns are selected.
    return found.filter(F.when(F.col("__ord_n") == 1, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("__ord_n")


def join_by_key(df: DataFrame, narrow: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """The rows of ``df`` whose key ``narrow`` has, with its other columns; null keys meet."""
    right = narrow.select(*[F.col(k).alias(f"__ord_{k}") for k in key_cols], *[c for c in narrow.columns if c not in key_cols])
    on = [F.col(k).eqNullSafe(F.col(f"__ord_{k}")) for k in key_cols]
    return df.join(right, on, "inner").drop(*[f"__ord_{k}" for k in key_cols])


def index_by_key(
    df: DataFrame, order_cols: Sequence[str], key_cols: Sequence[str], name: str = "idx"
) -> DataFrame:
    """``with_global_index`` for wide rows with a unique key.

    The sort and checkpoint run on the narrow (order + key) projection;
    the positions are joined back on the key. So wide data (documents,
    token arrays) goes through one shuffle and is written to no
    checkpoint. A key that is not unique fails the query.
    """
    narrow = df.select(*dict.fromkeys([*order_cols, *key_cols]))
    idx = with_global_index(one_row_per_key(narrow, key_cols), order_cols, name).select(*key_cols, name)
    return join_by_key(df, idx, key_cols)


def reindex_in_place(df: DataFrame, name: str = "idx") -> DataFrame:
    """Dense 0-based positions for a frame derived from a ``stable_sort``
    (or ``with_global_index``) result by narrow, order-preserving steps
    only (filters, projections). Its partitions are still the sorted
    ranges, so no new sort or checkpoint is needed: a per-partition count
    (one row per partition, broadcast) gives the offsets."""
    s = df.withColumn(_PID, F.spark_partition_id()).withColumn(
        _POS, F.monotonically_increasing_id() - F.col(_PID).cast("long") * F.lit(_MID_SHIFT)
    )
    # The id is assigned after any upstream filter, so positions are dense
    # among the surviving rows of each partition.
    offsets = _partition_offsets(s.drop(_PID, _POS))
    out = s.join(F.broadcast(offsets), _PID, "left")
    return out.withColumn(name, (F.col("__ord_off") + F.col(_POS)).cast("long")).drop(_PID, _POS, "__ord_off")


def _sum_type(kind: T.DataType) -> T.DataType:
    """Type of a sum: long for integers, double for other numbers."""
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def grouped_prefix_sums(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    *,
    inclusive: bool = False,
    suffix: str = "_before",
) -> DataFrame:
    """Running sums of ``value_cols`` per group in ``order_cols`` order.

    For each value column ``v`` adds ``v + suffix``: the sum over earlier
    rows of the same group (``inclusive=True`` also counts the row). A
    group may span many partitions; its carry into partition ``p`` is the
    sum of its rows in partitions ``< p``. Only the first group of each
    partition can carry, so the carry table has at most two rows per
    partition (a group's segments as last and as first group) and is
    broadcast.
    """
    group_cols = list(group_cols)
    s = stable_sort(df, [*group_cols, *order_cols]).withColumn(_PID, F.spark_partition_id())

    # The partitions are sorted, so one pass over each gives its running sums;
    # nothing is shuffled or sorted again.
    added = T.StructType([T.StructField("_sd_loc_" + v, _sum_type(s.schema[v].dataType)) for v in value_cols])

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(value_cols, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {g: batch.column(batch.schema.get_field_index(g)) for g in [*group_cols, *value_cols]}
            change = np.zeros(batch.num_rows, dtype=bool)
            for g in group_cols:
                codes = columns[g].dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            number = pd.Series(np.cumsum(change))
            if last != tuple(columns[g][0].as_py() for g in group_cols):
                carry = dict.fromkeys(value_cols, 0)
            out = batch.columns
            for v, field in zip(value_cols, added, strict=True):
                total = pd.Series(columns[v].fill_null(0).to_numpy(zero_copy_only=False)).groupby(number).cumsum()
                before = total if inclusive else total.groupby(number).shift(1, fill_value=0)
                before = before.where(number != 0, before + carry[v])
                carry[v] = total.iloc[-1] + (carry[v] if number.iloc[-1] == 0 else 0)
                out = [*out, pa.array(before.to_numpy(), pa.int64() if isinstance(field.dataType, T.LongType) else pa.float64())]
            last = tuple(columns[g][-1].as_py() for g in group_cols)
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *added.fieldNames()])

    local = s.mapInArrow(running, T.StructType([*s.schema.fields, *added.fields]))

    # Per (partition, group) totals. Only a group that starts a partition
    # can carry rows from earlier partitions, so the relevant totals are
    # those of the (at most one per partition) first groups: <= 2 rows per
    # partition, small enough for a window and a broadcast.
    totals = s.groupBy(_PID, *group_cols).agg(*[F.sum(v).alias("_sd_tot_" + v) for v in value_cols])
    if group_cols:
        firsts = s.groupBy(_PID).agg(F.min(F.struct(*group_cols)).alias("_sd_first"))
        first_groups = firsts.select(*[F.col("_sd_first." + g).alias(g) for g in group_cols]).distinct()
        rel = totals.join(
            F.broadcast(first_groups),
            [totals[g].eqNullSafe(first_groups[g]) for g in group_cols],
            "left_semi",
        )
    else:
        rel = totals
    wc = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # Fresh aliases: the carry table derives from the same checkpoint, so
    # reusing the attribute ids would make the join condition ambiguous.
    carry = rel.select(
        F.col(_PID).alias("_sd_cpid"),
        *[F.col(g).alias("_sd_cg_" + g) for g in group_cols],
        *[F.coalesce(F.sum("_sd_tot_" + v).over(wc), F.lit(0)).alias("_sd_carry_" + v) for v in value_cols],
    )
    cond = [F.col(_PID) == F.col("_sd_cpid")] + [
        F.col(g).eqNullSafe(F.col("_sd_cg_" + g)) for g in group_cols
    ]
    out = local.join(F.broadcast(carry), cond, "left").select(
        *[F.col(c) for c in local.columns],
        *[F.coalesce(F.col("_sd_carry_" + v), F.lit(0)).alias("_sd_carry_" + v) for v in value_cols],
    )
    for v in value_cols:
        out = out.withColumn(v + suffix, F.col("_sd_loc_" + v) + F.col("_sd_carry_" + v)).drop(
            "_sd_loc_" + v, "_sd_carry_" + v
        )
    return out.drop(_PID)


def seeded_order_key(seed: int, key: str | Column) -> Column:
    """Deterministic shuffle key (W02): sha256 of ``"<seed>:<key>"``.

    The permutation is a function of the seed and each row's key only, so
    it does not depend on partitioning or input file order.
    """
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{int(seed)}:"), k.cast("string")), 256)
