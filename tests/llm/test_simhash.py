"""SimHash groups against a brute-force search over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from sparkdraft.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, most=4):
    """Component of each row: smallest id, by trying all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, fps[i], least.get(top(i))) for i, (d, _) in enumerate(rows)]


def documents(n=60, seed=1):
    random = np.random.RandomState(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = [vocabulary[k] for k in random.randint(0, 400, 150)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(random.randint(0, 3)):
            other = list(words)
            other[random.randint(0, 150)] = "changed"
            rows.append((len(rows), "  \n".join(other) if random.rand() < 0.5 else " ".join(other)))
    return rows


def found(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return sorted(((r[0], r[1] % 2**64, r[2]) for r in simhash.simhash_components(spark, df).collect()), key=repr)


def test_groups_match_all_pairs(spark):
    rows = documents()
    want = plain_groups(rows)
    assert len({w[2] for w in want}) < len(rows)
    assert found(spark, rows) == sorted(want, key=repr)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, " \t\n"), (6, "É é"), (None, "alone here now"), (7, "x " * 50_000), (8, "X " * 50_000)]
    assert found(spark, rows) == sorted(plain_groups(rows), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(spark, df).count() == 0
    assert simhash.one_of_each_group(spark, df).count() == 0


def test_one_of_each_group_keeps_columns_and_one_row(spark):
    rows = [(3, "p q r s t", "x", 1), (3, "p q r s t", "x", 1), (2, "p q r s t", "y", 2), (None, "p q r s t", "z", 3), (9, None, None, None), (8, "", "e", 0), (7, "other words stand in here", "o", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long")
    kept = simhash.one_of_each_group(spark, df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(2, "p q r s t", "y", 2), (8, "", "e", 0), (7, "other words stand in here", "o", 5)], key=repr)


def test_identical_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b c d")] * 3, "doc_id long, text string")
    assert simhash.one_of_each_group(spark, df).count() == 1


@pytest.mark.parametrize("blocks_for", [10, 3_000_000, 10**10])
def test_any_number_of_blocks_finds_every_link(spark, blocks_for):
    random = np.random.RandomState(5)
    base = [int(x) for x in random.randint(0, 2**62, 20)]
    fps = sorted({b ^ sum(1 << int(k) for k in random.choice(64, e, replace=False)) for b in base for e in range(6)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    keys = simhash.bucket_keys(df, blocks_for)
    edges = {tuple(sorted((r[0] % 2**64, r[1] % 2**64))) for r in simhash.links(keys, bucket=8).collect()}
    group = {f: f for f in fps}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a, b in edges:
        group[top(a)] = top(b)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                assert top(a) == top(b)


def test_star_and_pair_search_agree():
    random = np.random.RandomState(2)
    fp = np.unique(np.concatenate([x ^ (np.uint64(1) << random.randint(0, 64, 12).astype(np.uint64)) for x in random.randint(0, 2**62, 40).astype(np.uint64)]))
    near = np.bitwise_count(fp[:, None] ^ simhash._pivots(24)[None, :]).astype(np.uint8).T

    def groups(edges):
        group = {int(f): int(f) for f in fp}

        def top(f):
            while group[f] != f:
                f = group[f]
            return f

        for a, b in zip(*edges):
            group[top(int(a))] = top(int(b))
        return {frozenset(f for f in group if top(f) == top(g)) for g in group}

    assert groups(simhash._stars(fp, near, 4)) == groups(simhash._small_stars(fp, near, 4))
