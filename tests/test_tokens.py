"""Tokenizer fixtures (A1, A2)."""

from pyspark.sql import functions as F

from sparkdraft.operators.fingerprints import LANES, content_parts, dataset_fingerprint, merge_parts, row_text
from sparkdraft.operators.tokens import (
    apply_template,
    batch_id,
    char_token_ids,
    left_truncate,
    pad_to_batch_max,
    prompt_budget,
    tokenize_records,
)


def recs(spark, rows):
    return spark.createDataFrame(rows, "id string, prompt_text string, response_text string")


def test_response_only_mask(spark):
    ex = tokenize_records(recs(spark, [("a", "abc", "xy")]), max_seq_len=128).collect()[0]
    assert len(ex["input_ids"]) == 27
    assert ex["labels"][:20] == [-100] * 20
    assert ex["labels"][20:] == ex["input_ids"][20:]
    assert ex["response_mask"] == [False] * 20 + [True] * 7
    assert ex["input_ids"][0] == 2 + ord("<") % 101


def test_truncation_drops_fully_truncated(spark):
    df = recs(spark, [("a", "abc", "xy"), ("b", "x" * 200, "y")])
    got = [r["id"] for r in tokenize_records(df, max_seq_len=30).collect()]
    assert got == ["a"]
    kept = tokenize_records(df, max_seq_len=30, drop_empty=False).collect()
    assert {r["id"]: len(r["input_ids"]) for r in kept} == {"a": 27, "b": 30}


def test_fingerprint_changes_with_max_len(spark):
    df = recs(spark, [("a", "abc", "xy")])
    kw = dict(tokenizer_name="tiny", template="<user>{text}<assistant>")
    f64 = dataset_fingerprint(df, ["id", "prompt_text", "response_text"], max_seq_len=64, **kw).collect()[0]
    f96 = dataset_fingerprint(df, ["id", "prompt_text", "response_text"], max_seq_len=96, **kw).collect()[0]
    assert f64["fingerprint"] != f96["fingerprint"] and len(f64["fingerprint"]) == 16
    assert f64["n_rows"] == 1
    # partition- and order-insensitive
    df2 = recs(spark, [("b", "q", "r"), ("a", "abc", "xy")])
    d1 = dataset_fingerprint(df2, ["id", "prompt_text"], max_seq_len=8, **kw).collect()[0]["fingerprint"]
    d2 = dataset_fingerprint(df2.repartition(5).orderBy(F.desc("id")), ["id", "prompt_text"], max_seq_len=8, **kw).collect()[0]["fingerprint"]
    assert d1 == d2


def test_collate_pads_to_batch_max(spark):
    ex = tokenize_records(recs(spark, [("1", "a", "b"), ("2", "aaaa", "bb")]), max_seq_len=128)
    lens = {r["id"]: len(r["input_ids"]) for r in ex.collect()}
    assert lens == {"1": 24, "2": 28}
    padded = pad_to_batch_max(ex.withColumn("batch_id", batch_id(F.lit(0), 8)), "batch_id")
    rows = {r["id"]: r for r in padded.collect()}
    assert len(rows["1"]["input_ids"]) == 28 and rows["1"]["input_ids"][-1] == 0
    assert rows["1"]["labels"][-1] == -100 and rows["1"]["attention_mask"][-4:] == [0] * 4
    assert rows["1"]["response_mask"][-1] is False and rows["1"]["n_pad"] == 4
    assert rows["2"]["n_pad"] == 0


def test_left_truncation_keeps_suffix(spark):
    df = spark.createDataFrame([("p", "abcdefghijklmnopqrstuvwxyz")], "id string, prompt_text string")
    ids = char_token_ids(apply_template("prompt_text", "<user>{text}<assistant>"), "identity")
    r = df.select(left_truncate(ids, 11).alias("t")).select("t.*").collect()[0]
    assert (r["tokens_original"], r["tokens_used"], r["truncated"], "".join(map(chr, r["ids"]))) == (43, 11, True, "<assistant>")
    short = df.select(left_truncate(F.array(F.lit(1), F.lit(2)), 11).alias("t")).collect()[0]["t"]
    assert short["ids"] == [1, 2] and short["truncated"] is False
    assert prompt_budget(256, 64) == 192 and prompt_budget(10, 64) == 1 and prompt_budget(256, 64, 11) == 11


def test_empty_text_has_no_ids(spark):
    r = spark.createDataFrame([("",)], "s string").select(char_token_ids("s").alias("ids")).collect()[0]
    assert r["ids"] == []


def test_rows_read_alike_only_if_equal(spark):
    values = [None, "", "-", "a", "a\x1fb", "b", "1:a", "2", "é", "\n"]
    rows = [(x, y) for x in values for y in values]
    df = spark.createDataFrame(rows, "x string, y string")
    texts = [r[0] for r in df.select(row_text(df, ["x", "y"])).collect()]
    assert len(set(texts)) == len(rows)
    nested = spark.createDataFrame(
        [(["a, b"], None, b"a"), (["a", "b"], None, b"a"), (["a", "b", None], None, b"a"), (["a", "b"], {"k": None}, b"a"), (["a", "b"], {}, b"a"), (None, None, b"a"), (None, None, None), (["null"], None, b"61"), ([None], None, b"61")],
        "x array<string>, y map<string,string>, z binary",
    )
    texts = [r[0] for r in nested.select(row_text(nested, ["x", "y", "z"])).collect()]
    assert len(set(texts)) == 9


def test_digests_of_parts_make_up_the_whole(spark):
    rows = [(str(i % 7), None if i % 5 == 0 else "t" * (i % 11), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, text string, part int")
    values = lambda d: tuple(d.select("n_rows", *LANES).first())
    whole = values(content_parts(df, ["id", "text"]))
    parts = content_parts(df.repartition(5), ["id", "text"], by=["part"])
    assert parts.count() == 3 and values(merge_parts(parts)) == whole
    # Appended rows: old digest and new digest, the old rows are not needed.
    more = spark.createDataFrame([("x", None, 9)] * 2, "id string, text string, part int")
    grown = merge_parts(content_parts(df, ["id", "text"]).unionByName(content_parts(more, ["id", "text"])))
    assert values(grown) == values(content_parts(df.unionByName(more), ["id", "text"])) != whole
    assert values(content_parts(df.limit(0), ["id", "text"])) == (0, 0, 0, 0, 0)
    # A row twice is not a row once, and moving values between rows shows.
    one = lambda *r: values(content_parts(spark.createDataFrame(r, "id string, text string"), ["id", "text"]))
    assert len({one(("a", "b")), one(("a", "b"), ("a", "b")), one(("a", "b"), ("c", "d")), one(("a", "d"), ("c", "b")), one(("a", None)), one(("a", ""))}) == 6


def test_fingerprint_follows_settings_and_types(spark):
    df = spark.createDataFrame([("1", "a")], "id string, text string")
    key = lambda d=df, **kw: dataset_fingerprint(d, ["id", "text"], **({"tokenizer_name": "t", "template": None, "max_seq_len": 8} | kw)).first()["fingerprint"]
    assert len({key(), key(template=""), key(tokenizer_name="t|"), key(add_eos=False), key(df.withColumn("id", F.col("id").cast("int")))}) == 5
