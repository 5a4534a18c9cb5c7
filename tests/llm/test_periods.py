"""Periodic runs against trying every period at every place."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from sparkdraft.llm import periods
from sparkdraft.llm.wavelet import WaveletTree


def plain(words, least=24, repeats=3):
    """(start, length, period) of all runs, by start, then period."""
    n, seen = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                seen.setdefault((i, j + q), q)  # the smallest period comes first
            i = j
    return sorted((b, e - b, q) for (b, e), q in seen.items())


def collapsed(words, runs):
    gone = {i for b, n, q in runs for i in range(b + q, b + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = periods.periodic_runs(df, ["doc_id"], **options).collect()
    return sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=repr)


def expected(rows, **options):
    out = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain(words, **options)
        out.append((d, len(words), runs, " ".join(collapsed(words, runs))))
    return sorted(out, key=repr)


def texts(seed, n):
    """Words of small alphabets with powers, nested powers and broken powers in them."""
    random = np.random.RandomState(seed)
    for _ in range(n):
        k = random.randint(1, 5)
        some = lambda m: [f"w{i}" for i in random.randint(0, k, m)]
        words = []
        for _ in range(random.randint(1, 5)):
            unit = some(random.randint(1, 40))
            if random.rand() < 0.5:
                unit = unit[: random.randint(1, 6)] * random.randint(1, 9) + some(random.randint(0, 4))
            power = unit * random.randint(1, 9)
            words += some(random.randint(0, 30)) + power[: random.randint(1, len(power) + 1)]
            if random.rand() < 0.3:
                words[random.randint(0, len(words))] = "x"
        yield words


def hashes(words):
    names = {w: i for i, w in enumerate(sorted(set(words)))}
    return np.random.RandomState(3).randint(0, 2**62, len(names) or 1).astype(np.uint64)[[names[w] for w in words]]


def stretches(all_words, **options):
    first = np.cumsum([0, *map(len, all_words)])
    b, e, q = periods.periodic_stretches(hashes([w for ws in all_words for w in ws]), first, **options)
    out = [[] for _ in all_words]
    for x, y, p in zip(b, e, q):
        t = int(np.searchsorted(first, x, side="right")) - 1
        out[t].append((int(x - first[t]), int(y - x), int(p)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_all_runs_of_small_alphabets(seed):
    some = list(texts(seed, 60))
    assert stretches(some) == [plain(w) for w in some]


def test_all_short_binary_periods_in_one_text():
    """Every unit of up to 9 letters of two, repeated; blocks with progressions inside included."""
    some = [[format(i, f"0{n}b")[j % n] for j in range(3 * n + 24)] for n in range(1, 10) for i in range(2**n)]
    assert stretches(some) == [plain(w) for w in some]


def test_longer_least_and_more_repeats():
    some = list(texts(77, 60))
    assert stretches(some, least=30, repeats=4) == [plain(w, 30, 4) for w in some]
    with pytest.raises(ValueError):
        stretches(some, least=5)


def test_wavelet_tree_queries():
    random = np.random.RandomState(5)
    for n in (1, 2, 63, 64, 65, 300):
        values = random.permutation(n)
        tree = WaveletTree(values)
        lo = random.randint(0, n + 1, 200)
        hi = np.minimum(lo + random.randint(0, n + 1, 200), n)
        x = random.randint(0, n + 1, 200)
        want = [min((v for v in values[a:b] if v >= c), default=-1) for a, b, c in zip(lo, hi, x)]
        assert tree.successor(lo, hi, x).tolist() == want
        assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]


def test_texts_through_spark(spark):
    rows = [(i, " \n\t".join(w)) for i, w in enumerate(texts(31, 40))]
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    loop = " ".join(f"É{i % 9}" for i in range(70))
    rows = [(1, None), (2, ""), (3, " \n "), (None, loop), (4, loop), (4, loop), (5, "a " * 23), (6, "a " * 24), (7, "a b " * 30), (8, "Z" * 200_000)]
    assert found(spark, rows) == expected(rows)


def test_one_very_long_text(spark):
    unit = [f"t{i}" for i in range(50_000)]
    rows = [(1, " ".join(unit * 4 + ["end"] * 100_000))]
    (_, n, runs, left) = found(spark, rows)[0]
    assert (n, runs) == (300_000, [(0, 200_000, 50_000), (200_000, 100_000, 1)])
    assert left == " ".join([*unit, "end"])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(df, ["doc_id"]).count() == 0
    df = spark.createDataFrame([(1, "a " * 30, 7, "x", 9)], "doc_id long, text string, row long, `te.xt` string, runs int")
    got = periods.periodic_runs(df, ["doc_id", "row", "text", "te.xt", "runs"]).first()
    assert (got["row"], got["te.xt"], got["collapsed"], len(got["runs"])) == (7, "x", "a", 1)


def test_query(spark):
    from sparkdraft.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want = {}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d] = (len(runs), *facts, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(collapsed(words, runs))))
    got = QUERIES["op11_periodic_run_detection"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 10
