"""The pipeline, stage by stage, against the plain versions of the operators."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkdraft.llm import decontam
from tests.conftest import SF_SMALL
from tests.llm import test_linetree, test_packing, test_simhash


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_on_the_small_tables(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    columns = docs.columns
    inputs = {}
    for name, stage in pipeline.STAGES:
        inputs[name] = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
    outputs = dict(zip(list(inputs), [*list(inputs.values())[1:], None]))
    text = columns.index("text")

    first = inputs["language_id"]
    assert sorted(outputs["language_id"], key=repr) == sorted((r for r in first if r[text] and any(c.isalpha() for c in r[text])), key=repr)

    want = test_linetree.plain([(r[0], r[text]) for r in inputs["line_dedup"]], 10)
    assert sorted(((r[0], r[text]) for r in outputs["line_dedup"]), key=repr) == [w[:2] for w in want]
    assert all(r[columns.index("n_chars")] == len(r[text]) for r in outputs["line_dedup"])

    groups = test_simhash.plain_groups([(r[0], r[text]) for r in inputs["simhash_near_dedup"]])
    assert sorted(r[0] for r in outputs["simhash_near_dedup"]) == sorted({g[2] for g in groups})

    items = [decontam.characters(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    pieces = [bytes(c[s : s + m]) for c in items for s, m in decontam._windows(len(c)) if len(c) >= decontam.LEAST]
    leaks = {r[0] for r in inputs["benchmark_decontamination"] if any(p in bytes(decontam.characters(r[text])) for p in pieces)}
    assert {r[0] for r in inputs["benchmark_decontamination"]} - {r[0] for r in outputs["benchmark_decontamination"]} == leaks

    test_packing.check([(r[0], r[text]) for r in inputs["best_fit_packing"]], docs.collect())


def test_odd_rows_pass_through_every_stage(spark):
    given = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "plain words stand here", "en", "s", 22), (4, "12 34 !!", "en", "s", 8), (5, "plain words stand here", "en", None, 22), (5, "plain words stand here", "en", None, 22), (6, "w " * 60_000, None, "s", 120_000)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0, name
        out = stage(spark, docs, SF_SMALL)
        assert out.count() > 0, name
        if name == "language_id":
            # 6 is near no language.
            assert sorted((r[0] for r in out.collect()), key=repr) == sorted([None, 5, 5], key=repr)


CLASHING = ["lang_pred", "score", "row", "id", "_k1", "_k2", "k1", "k2", "n", "n_lines", "n_dropped", "dropped", "fp", "root", "leaf", "h", "pos", "line", "_text", "_pid", "_shard", "_bin", "piece", "start", "length", "item_id", "edits"]


def test_clashing_columns_pass_through_every_stage(spark):
    text = "plain words stand here and there in a row\nAll rights reserved."
    rows = [(i, f"{text} number {'abcdefghijklmnop'[i] * 3}\nAll rights reserved.", "en", "s", 9, *[str(i)] * len(CLASHING)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
            assert all(str(r["doc_id"]) == r[c] for r in out.collect() for c in CLASHING), name
        else:
            assert out.count() == 12


def test_language_rule(spark):
    prose = "these are plain words of one language that stand in a row and say little"
    given = [(1, prose, "en"), (2, prose + " again", "en"), (3, "лорем ипсум долор сит амет консектетур", None), (4, "жжж", None), (5, "A.", None), (6, "12", "en")]
    docs = spark.createDataFrame([(*r, "s", 0) for r in given], "doc_id long, text string, lang string, source string, n_chars long")
    stage = pipeline.language_id
    assert sorted(r[0] for r in stage(spark, docs, SF_SMALL).collect()) == [1, 2, 4, 5]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, unlabelled, SF_SMALL).count() == 6


def test_registry():
    import __spark_entry__ as entry

    queries = entry.queries()
    names = [n for n in queries if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert queries["pipeline"] is pipeline.run
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {"op3_line_dedup", "op5_license_scans", "op9_preference_formatting", "op13_importance_resampling"}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
