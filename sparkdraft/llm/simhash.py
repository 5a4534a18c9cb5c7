"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits, a bit set if it is set in over half of a text's
shingle hashes. Two texts link if their fingerprints differ in at most
``max_bits`` bits; groups are the connected components of the links.

Search, over distinct fingerprints only (copies never meet each other):

1. Every fingerprint gets its Hamming distances to a set of reference
   fingerprints (the pivots), computed once.
2. The 64 bits are cut into blocks. A pair within ``max_bits`` agrees on all
   but ``max_bits`` of the blocks, so it meets under at least one choice of
   blocks left. With more fingerprints more blocks are taken, so that a random
   bucket stays small; any number of blocks finds every pair.
3. Within a bucket, pairs whose pivot distances differ by more than
   ``max_bits`` for some pivot are discarded (triangle inequality), the others
   verified on the fingerprints. A bucket reports a spanning star for each
   group of linked members, never its pairs. A bucket beyond ``BUCKET``
   members is dealt in chunks, all pairs of which meet.

Defined results: null or empty text has the fingerprint zero, linked like any
other; a null doc_id keeps its row, and a component of null ids only has a
null component_id; repeated rows are documents of their own; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkdraft.llm.components import connected
from sparkdraft.llm.store import stored
from sparkdraft.llm.words import string_buffers

SHINGLE = 4
MAX_BITS = 4
PIVOTS = 24
#: Most members of a bucket that meet in one piece.
BUCKET = 20_000
#: Expected members of a random bucket; beyond it the bits are cut into more blocks.
RANDOM_BUCKET = 256


def _shingle_hashes(words: list[bytes], width: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles, some thousands at a time."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    for at in range(0, n, 1 << 15):
        yield np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    total, counts = 0, np.zeros(64, dtype=np.int64)
    for h in _shingle_hashes(words, width, seed):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        total += len(h)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    inner = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(batch.num_columns - 1))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[a:b], width) for a, b in itertools.pairwise(offsets.tolist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return inner.mapInArrow(run, f"{kinds}, fp bigint")


def _pivots(n: int) -> np.ndarray:
    """The reference fingerprints: n fixed random 64-bit values."""
    return np.frombuffer(np.random.RandomState(64).bytes(8 * n), dtype="<u8")


def _n_blocks(n: int, max_bits: int) -> int:
    """Fewest blocks for which a random bucket has at most RANDOM_BUCKET members."""
    for blocks in range(max_bits + 1, max_bits + 5):
        if n / 2 ** (64 * (blocks - max_bits) / blocks) <= RANDOM_BUCKET:
            break
    return blocks


def bucket_keys(fps: DataFrame, n: int, max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """(key, fp, near): each fingerprint under every choice of blocks, with its pivot distances."""
    blocks = _n_blocks(n, max_bits)
    choices = list(itertools.combinations(range(blocks), blocks - max_bits))
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = _pivots(pivots)
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            near = np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.uint8)
            near = pa.FixedSizeBinaryArray.from_buffers(pa.binary(pivots), len(fp), [None, pa.py_buffer(near.tobytes())]).cast(pa.binary())
            for c, choice in enumerate(choices):
                key, width = np.zeros(len(fp), dtype=np.uint64), 0
                for b in choice:
                    size = cuts[b + 1] - cuts[b]
                    key = (key << np.uint64(size)) | ((fp >> np.uint64(cuts[b])) & np.uint64((1 << size) - 1))
                    width += size
                key |= np.uint64(c << 48)  # at most 70 choices of at most 32 bits
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), near], names=["key", "fp", "near"])

    return fps.select("fp").mapInArrow(run, "key bigint, fp bigint, near binary")


def _stars(fp: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, first member) of the linked groups in a bucket.

    ``near`` is pivots x members. A breadth-first search: each member is held
    against those not yet reached, first by its pivot distances, one pivot after
    another, then by its bits.
    """
    order = np.argsort(near[0], kind="stable")
    fp, near = fp[order], near[:, order].astype(np.int16)
    free = np.arange(len(fp))  # not yet reached, in the order of the first pivot
    head, member = [], []
    while len(free) > 1:
        root, free = free[0], free[1:]
        queue = [root]
        while queue and len(free):
            x = queue.pop()
            lo, hi = np.searchsorted(near[0][free], [near[0, x] - max_bits, near[0, x] + max_bits + 1])
            at = np.arange(lo, hi)
            for row in near[1:]:
                if not len(at):
                    break
                at = at[np.abs(row[free[at]] - row[x]) <= max_bits]
            at = at[np.bitwise_count(fp[free[at]] ^ fp[x]) <= max_bits]
            if len(at):
                found = free[at]
                free = np.delete(free, at)
                queue += found.tolist()
                head += [root] * len(found)
                member += found.tolist()
    return fp[member], fp[head]


def _small_stars(fp: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a few members: all pairs by their pivot distances at once."""
    i, j = np.triu_indices(len(fp), 1)
    for row in near:
        keep = np.abs(row[i].astype(np.int16) - row[j]) <= max_bits
        i, j = i[keep], j[keep]
        if not len(i):
            break
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
    return fp[i[keep]], fp[j[keep]]


def links(keys: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that span every group of linked fingerprints, from the bucketed keys."""
    crowded = keys.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(2 * F.col("count") / bucket).cast("int").alias("parts"))
    dealt = (
        keys.join(crowded, "key", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "near")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held: list[pa.Table] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = np.stack([batch.column(i).to_numpy() for i in range(3)])
                cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
                starts = [0, *cuts.tolist(), batch.num_rows]
                for lo, hi in itertools.pairwise(starts):
                    now = tuple(ids[:, lo].tolist())
                    if now != last and held:
                        yield held
                        held = []
                    held.append(batch.slice(lo, hi - lo))
                    last = now
            if held:
                yield held

        u, v, n = [], [], 0
        for parts in groups():
            size = sum(p.num_rows for p in parts)
            if size < 2:
                continue
            fp = np.concatenate([p.column(3).to_numpy() for p in parts]).view(np.uint64)
            near = np.frombuffer(b"".join(x for p in parts for x in p.column(4).to_pylist()), dtype=np.uint8).reshape(size, pivots).T
            a, b = (_small_stars if size <= 64 else _stars)(fp, near, max_bits)
            u.append(a)
            v.append(b)
            n += len(a)
            if n > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])
                u, v, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    return dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def fingerprint_roots(spark: SparkSession, fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root): every distinct value of ``fp`` and the fingerprint that names its group."""
    distinct = stored(spark, fps.select("fp").distinct(), "fingerprints")
    keys = bucket_keys(distinct, distinct.count(), max_bits)
    roots = connected(spark, links(keys, max_bits))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: the id, fp (signed) and component_id, the smallest id of its group."""
    table = stored(spark, with_fingerprint(docs, [id_col], text_col, width), "simhash")
    roots = stored(spark, fingerprint_roots(spark, table, max_bits), "roots")
    ids = table.groupBy("fp").agg(F.min(id_col).alias("low")).join(roots, "fp")
    lowest = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    names = roots.join(lowest, "root").select("fp", "component_id")
    return table.join(names, "fp").select(id_col, "fp", "component_id")


def one_of_each_group(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one document of each group: the smallest id
    (null last), then the smallest row hash; of identical rows one stays."""
    # The row travels as one struct, so that no column name can clash.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    row = F.to_json("row") if "map<" in packed.schema["row"].dataType.simpleString() else F.col("row")
    keyed = packed.withColumns({"k1": F.xxhash64(row), "k2": F.xxhash64(F.lit(1), row)})
    table = stored(spark, with_fingerprint(keyed, ["id", "k1", "k2"], "text", width), "simhash")
    roots = fingerprint_roots(spark, table, max_bits)
    # The copies of a fingerprint become one row before anything meets by it.
    best = table.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("r"))
    kept = best.join(roots, "fp").groupBy("root").agg(F.min("r").alias("r")).select("r.k1", "r.k2")
    once = Window.partitionBy("k1", "k2").orderBy("k1")
    return keyed.join(kept, ["k1", "k2"], "left_semi").withColumn("n", F.row_number().over(once)).filter("n = 1").select("row.*")
