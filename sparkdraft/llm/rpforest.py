"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

Fit: on a sample of at most ``SAMPLE`` vectors (``SAMPLE_BYTES`` in all), each
tree splits by the median of a random projection at every node, to leaves of
about ``LEAF`` of the table's rows, and no more than ``LEAVES`` a tree. Index: every row is dealt to its leaf in every
tree. Search: one priority queue per query over all trees holds nodes by the
smallest margin on their way; leaves are opened from the best on until they
hold ``share`` times the rows, at every size of the table. Rerank: the exact
cosine in double precision of all rows in the opened leaves.

The share counts a row in every tree it is found in, of ``trees`` in all. The
default suits vectors that spread evenly over the sphere, for which no index can
tell far from near well: work per query then grows with the table. Vectors with
more structure need less.

Rows with equal vectors are searched as one, with the few smallest ids that can
be among the nearest. Leaves and queries beyond ``BLOCK`` rows meet in blocks.

Defined results: a null id takes no part, nor does a vector that is null, zero
or holds null, NaN or infinite numbers, or has another length than most; of
rows with one id the vector of the smallest hash counts; ties go to the smaller
id; extra columns are ignored; a query without candidates and an empty table
give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkdraft.llm.store import stored

TREES = 8
LEAF = 512
#: Leaves of a tree. Leaves grow with the table, so that a query opens no more of them.
LEAVES = 64
SHARE = 1.5
SAMPLE = 100_000
SAMPLE_BYTES = 64 << 20
BLOCK = 20_000


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Forest:
    """Normals and thresholds of the inner nodes, tree by tree, in breadth-first order."""

    def __init__(self, normals: np.ndarray, thresholds: np.ndarray, depth: int):
        self.normals, self.thresholds, self.depth = normals, thresholds, depth

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree: rows x trees."""
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        out = np.zeros((len(x), len(self.normals)), dtype=np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", unit, self.normals[t, node]) > self.thresholds[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, x: np.ndarray, sizes: np.ndarray, budget: float) -> list[tuple[int, int]]:
        """(tree, leaf) from the best on, until they hold ``budget`` rows."""
        unit = x / np.linalg.norm(x)
        margins = (self.normals @ unit - self.thresholds).tolist()
        inner, held, out = 2**self.depth - 1, 0.0, []
        queue = [(-math.inf, t, 0) for t in range(len(margins))]
        while queue and held < budget:
            worst, t, node = heapq.heappop(queue)
            if node >= inner:
                if sizes[t, node - inner]:
                    out.append((t, node - inner))
                    held += sizes[t, node - inner]
            else:
                m = margins[t][node]
                heapq.heappush(queue, (max(worst, m), t, 2 * node + 1))
                heapq.heappush(queue, (max(worst, -m), t, 2 * node + 2))
        return out


def fit(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """A forest whose leaves hold about ``leaf`` of ``rows`` rows, or 16 of the sample at least, and ``LEAVES`` a tree at most."""
    depth = max(0, min(math.ceil(math.log2(max(1, rows / leaf))), int(math.log2(max(1, len(sample) / 16))), int(math.log2(LEAVES))))
    dim = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    normals = np.zeros((trees, max(1, 2**depth - 1), dim))
    thresholds = np.zeros((trees, max(1, 2**depth - 1)))
    random = np.random.RandomState(10)
    for t in range(trees):
        parts = [np.arange(len(unit))]
        for node in range(2**depth - 1):
            own, parts[node] = parts[node], None
            normal = random.standard_normal(dim)
            normal /= np.linalg.norm(normal)
            place = unit[own] @ normal
            cut = float(np.median(place)) if len(own) else 0.0
            normals[t, node], thresholds[t, node] = normal, cut
            parts += [own[place <= cut], own[place > cut]]
    return Forest(normals, thresholds, depth)


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec, k1, k2): one usable vector per id, and their length."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("vec_id is not null and vec is not null")
    rows = rows.filter(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))).filter(F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common[0] if common else 1
    rows = rows.filter(F.size("vec") == dim).withColumn("vec", F.transform("vec", lambda x: x + 0.0))  # -0.0 is 0.0
    keyed = rows.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec")})
    best = keyed.groupBy("vec_id").agg(F.min_by(F.struct("vec", "k1", "k2"), F.struct("k1", "k2")).alias("r"))
    return best.select("vec_id", "r.vec", "r.k1", "r.k2"), dim


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for
    which ``is_query`` (over the column vec_id) holds, among all other rows."""
    rows, dim = _valid(vectors, id_col, vec_col)
    rows = stored(spark, rows, "vectors")
    first = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)  # no more of equal vectors can be among k others
    distinct = stored(spark, few.groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.collect_list("vec_id").alias("ids")), "distinct-vectors")
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    queries = distinct.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "vec")

    n = distinct.count()
    n_queries = asked.count()
    taken = distinct.select(F.xxhash64("k2", "k1").alias("h"), "vec").orderBy("h").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).toArrow()
    forest = fit(_matrix(taken.column("vec"), dim) if len(taken) else np.zeros((0, dim)), n, trees, leaf)
    model = spark.sparkContext.broadcast((forest.normals, forest.thresholds, forest.depth))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_ = Forest(*model.value)
        sizes = np.zeros(trees_.normals.shape[0] << trees_.depth, dtype=np.int64)
        for batch in batches:
            at = trees_.leaves(_matrix(batch.column(0), dim)) + (np.arange(trees_.normals.shape[0]) << trees_.depth)
            sizes += np.bincount(at.ravel(), minlength=len(sizes))
        own = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sizes[own])], names=["at", "n"])

    table = distinct.select("vec").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # trees x leaves
    sizes = np.zeros(trees << forest.depth, dtype=np.int64)
    sizes[table.column("at").to_numpy()] = table.column("n").to_numpy()
    leaf_sizes = spark.sparkContext.broadcast(sizes.reshape(trees, -1))
    budget = share * n
    query_parts = max(1, math.ceil(n_queries / BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row in every tree; a large leaf in parts, for each part of the queries."""
        trees_, held = Forest(*model.value), leaf_sizes.value
        for batch in batches:
            at = trees_.leaves(_matrix(batch.column(2), dim))
            part_of = batch.column(0).to_numpy() & 0x7FFFFFFF
            for t in range(at.shape[1]):
                parts = -(-held[t, at[:, t]] // BLOCK)
                for q in range(query_parts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(((t << trees_.depth) + at[:, t]).astype(np.int64)), pa.array(part_of % parts), pa.array(np.full(len(at), q, dtype=np.int64)), batch.column(2), batch.column(3)],
                        names=["at", "part", "query_part", "vec", "ids"],
                    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees_, held = Forest(*model.value), leaf_sizes.value
        for batch in batches:
            for i, x in enumerate(_matrix(batch.column(2), dim)):
                opened = trees_.search(x, held, budget)
                at = np.array([(t << trees_.depth) + b for t, b in opened], dtype=np.int64)
                parts = np.array([-(-held[t, b] // BLOCK) for t, b in opened], dtype=np.int64)
                of = np.repeat(np.arange(len(at)), parts)
                part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                row = batch.slice(i, 1).take(pa.array(np.zeros(len(of), dtype=np.int64)))
                query_part = np.full(len(of), (batch.column(0)[i].as_py() & 0x7FFFFFFF) % query_parts, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[of]), pa.array(part), pa.array(query_part), *row.columns], names=["at", "part", "query_part", "k1", "k2", "vec"])

    def rerank(index: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        """The k + 1 best ids of a block for each query: candidates by a matrix
        product, then each pair's cosine summed in one fixed order."""
        names = ["k1", "k2", "vec_id", "score"]
        if not len(index) or not len(asked_):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
        x, q = np.stack(index["vec"].to_numpy()), np.stack(asked_["vec"].to_numpy())
        nx, nq = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        rough = (q / nq[:, None]) @ (x / nx[:, None]).T
        keep = min(k + 1, len(x))
        least = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
        i, j = np.nonzero(rough >= least[:, None] - 1e-9)
        score = np.concatenate([(q[i[a : a + 65536]] * x[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)]) / (nq[i] * nx[j])
        ids = index["ids"].to_numpy()
        times = np.array([len(ids[b]) for b in j])
        at = np.repeat(np.arange(len(i)), times)
        vec_id = np.concatenate([ids[b] for b in j]).astype(np.int64)
        order = np.lexsort((vec_id, -score[at], i[at]))
        at, vec_id = at[order], vec_id[order]
        who = i[at]
        starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
        at, vec_id, who = at[rank <= k], vec_id[rank <= k], who[rank <= k]
        return pd.DataFrame({"k1": asked_["k1"].to_numpy()[who], "k2": asked_["k2"].to_numpy()[who], "vec_id": vec_id, "score": score[at]})

    block = ["at", "part", "query_part"]
    dealt = distinct.select("k1", "k2", "vec", "ids").mapInArrow(deal, "at bigint, part bigint, query_part bigint, vec array<double>, ids array<bigint>")
    probes = queries.mapInArrow(probe, "at bigint, part bigint, query_part bigint, k1 bigint, k2 bigint, vec array<double>")
    found = dealt.groupBy(*block).cogroup(probes.groupBy(*block)).applyInPandas(rerank, "k1 bigint, k2 bigint, vec_id bigint, score double").distinct()
    best = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    few = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(few, ["k1", "k2"])
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
