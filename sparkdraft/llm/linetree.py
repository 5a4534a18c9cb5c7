"""Line deduplication with a log-template tree, in DataFrame functions only.

A line is read as tokens (runs without white space); a token with a digit is a
variable field. The tree has a fixed depth: a line goes to the leaf of its
token count and its first ``DEPTH`` tokens. Within a leaf, a token is constant at
its place if it stands there in lines of ``min_docs`` texts, and a variable field
if not; the constant tokens make up the template of a line, provided they are at
least ``SHARE`` of its tokens (else a line is its own template, if that holds
for its tokens without digits; a line with more fields than that is told by its
own tokens, digits and all). A template of ``min_docs`` different texts or
more is recurring: its lines are dropped, but for the first (smallest document
id, then place), so that no text is lost altogether. Documents with the same text
count as one text: whole copies are not lines in common.

Defined results: null text stays null, and empty text and blank lines stay as
they are; null ids come last in order; repeated rows are treated alike; extra
columns are carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkdraft.llm.store import stored

DEPTH = 3
MIN_DOCS = 10
SHARE = 0.5
FIELD = "<*>"
_WHITE = r"[\x20\x09-\x0D]"
_DIGITS = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _tokens(line: Column) -> Column:
    """Tokens of a line; one empty token if it is blank."""
    bare = _bare(line)
    return F.split(F.when(bare.rlike("[0-9]"), F.regexp_replace(bare, _DIGITS, FIELD)).otherwise(bare), f"{_WHITE}+")


def _constant(tokens: Column) -> Column:
    """Whether enough of the tokens are no fields."""
    return F.size(F.array_remove(tokens, FIELD)) >= SHARE * F.size(tokens)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (the other columns, so that no name can clash), id, text, _k1
    (the text) and _k2 (the text and the id)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return packed.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "id", "text")})


def _lines(keyed: DataFrame) -> DataFrame:
    """One narrow row per line that is not blank: leaf and hash, whether it can be a template,
    the hash of the tokens as they are if not, where it stands."""
    at = keyed.select("id", "_k1", "_k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = at.select("id", "_k1", "_k2", "pos", "line", _tokens(F.col("line")).alias("tokens")).filter(F.col("tokens")[0] != "")
    exact = F.when(~_constant(F.col("tokens")), F.xxhash64(F.lit(2), F.split(_bare(F.col("line")), f"{_WHITE}+")))
    return tokens.select("id", "_k1", "_k2", "pos", F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)).alias("leaf"), F.xxhash64("tokens").alias("h"), _constant(F.col("tokens")).alias("constant"), exact.alias("exact"))


def _templates(spark: SparkSession, keyed: DataFrame, texts: DataFrame, min_docs: int) -> DataFrame:
    """(leaf, h, template) for lines in leaves where several lines can share one."""
    # One row per kind of line, combined before the shuffle: a line that stands
    # in a third of all texts is one row from here on.
    counted = texts.groupBy("leaf", "h").agg(F.count("*").alias("n"), F.min("first").alias("one"))
    busy = counted.groupBy("leaf").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.min("n").alias("least")).filter((F.col("all") >= min_docs) & (F.col("kinds") > 1) & (F.col("least") < min_docs)).select("leaf")
    # One line of each kind is fetched from its text.
    shown = counted.join(busy, "leaf", "left_semi")
    wanted = shown.groupBy("one._k1", "one._k2").agg(F.collect_list(F.struct("one.pos", "leaf", "h", "n")).alias("wanted"))
    one_each = keyed.select("_k1", "_k2", "text").join(wanted, ["_k1", "_k2"])
    split = one_each.select(F.split("text", "\n").alias("all"), "wanted").select("all", F.explode("wanted").alias("w"))
    kinds = stored(spark, split.select("w.leaf", "w.h", "w.n", _tokens(F.get("all", F.col("w.pos"))).alias("tokens")).dropDuplicates(["leaf", "h"]), "line-kinds")
    placed = kinds.select("leaf", "h", "n", F.posexplode("tokens").alias("place", "token"))
    fixed = placed.filter(F.col("token") != FIELD).groupBy("leaf", "place", "token").agg(F.sum("n").alias("in")).filter(F.col("in") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("fixed"))
    named = (
        placed.join(fixed, ["leaf", "place", "token"], "left")
        .groupBy("leaf", "h")
        .agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD)).alias("token")))).alias("t"))
        .select("leaf", "h", F.transform("t", lambda x: x["token"]).alias("t"))
    )
    return named.filter(_constant(F.col("t"))).select("leaf", "h", F.xxhash64("t").alias("template"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, counts: bool = True) -> DataFrame:
    """The columns of ``docs``, the text without the dropped lines, and with
    ``counts`` n_lines and n_dropped."""
    keyed = _keyed(docs, id_col, text_col)
    lines = stored(spark, _lines(keyed), "lines")
    first = F.struct(F.col("id").isNull().alias("no"), "id", "pos", "_k1", "_k2")
    texts = stored(spark, lines.groupBy("leaf", "h", "_k1").agg(F.min(first).alias("first"), F.first("constant").alias("constant")), "line-texts")
    templates = stored(spark, _templates(spark, keyed, texts, min_docs), "templates")
    named = lambda d, *other: d.join(templates, ["leaf", "h"], "left").withColumn("template", F.coalesce("template", F.when(F.col("constant"), F.col("h")), *other)).filter("template is not null")
    # Lines of one kind and text can differ in their digits, so these are counted apart.
    exact = lines.filter("exact is not null").groupBy("leaf", F.col("exact").alias("template"), "_k1").agg(F.min(first).alias("first"))
    counted = named(texts).select("leaf", "template", "_k1", "first").unionByName(exact)
    recurring = stored(spark, counted.groupBy("leaf", "template").agg(F.countDistinct("_k1").alias("n"), F.min("first").alias("kept")).filter(F.col("n") >= min_docs).select("leaf", "template", "kept"), "recurring")
    dropped = named(lines, F.col("exact")).join(recurring, ["leaf", "template"]).filter((F.col("kept._k2") != F.col("_k2")) | (F.col("kept.pos") != F.col("pos")))
    by_row = dropped.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("dropped"))
    joined = keyed.join(by_row, ["_k1", "_k2"], "left")
    whole = F.split("text", "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter(whole, lambda x, i: ~F.array_contains(F.col("dropped"), i)), "\n"))
    own = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    added = [
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(whole)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    ]
    return joined.select(*own, *(added if counts else []))


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    """The query's rows in DuckDB SQL, on whole tokens instead of hashes."""
    white = "[\\x20\\x09-\\x0D]"
    return f"""
    WITH a AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM a WHERE text IS NOT NULL),
    k AS (SELECT *, string_split_regex(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '{FIELD}', 'g'), '{white}+') AS tokens,
        string_split_regex(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{white}+') AS raw FROM l),
    t AS (SELECT r, doc_id, text, pos, tokens, raw, (len(tokens), tokens[1:{DEPTH}]) AS leaf, len(list_filter(tokens, lambda x: x <> '{FIELD}')) >= {SHARE} * len(tokens) AS constant FROM k WHERE tokens[1] <> ''),
    c AS (SELECT leaf, tokens, count(DISTINCT text) AS n FROM t GROUP BY ALL),
    busy AS (SELECT leaf FROM c GROUP BY leaf HAVING sum(n) >= {min_docs} AND count(*) > 1 AND min(n) < {min_docs}),
    p AS (SELECT leaf, tokens, n, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM c WHERE leaf IN (SELECT leaf FROM busy)),
    fixed AS (SELECT leaf, place, token FROM p WHERE token <> '{FIELD}' GROUP BY ALL HAVING sum(n) >= {min_docs}),
    named AS (SELECT p.leaf, p.tokens, list(CASE WHEN fixed.token IS NULL THEN '{FIELD}' ELSE p.token END ORDER BY p.place) AS template
        FROM p LEFT JOIN fixed USING (leaf, place, token) GROUP BY p.leaf, p.tokens),
    m AS (SELECT t.*, CASE WHEN named.template IS NOT NULL THEN named.template WHEN constant THEN t.tokens ELSE list_prepend('exact', t.raw) END AS template
        FROM t LEFT JOIN (SELECT * FROM named WHERE len(list_filter(template, lambda x: x <> '{FIELD}')) >= {SHARE} * len(template)) named ON t.leaf = named.leaf AND t.tokens = named.tokens),
    rec AS (SELECT leaf, template, min((doc_id IS NULL, doc_id, pos)) AS kept FROM m WHERE template IS NOT NULL GROUP BY ALL HAVING count(DISTINCT text) >= {min_docs}),
    gone AS (SELECT DISTINCT m.r, m.pos FROM m JOIN rec ON m.leaf = rec.leaf AND m.template = rec.template WHERE (doc_id IS NULL, doc_id, pos) <> kept),
    s AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
    left_ AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone ON l.r = gone.r AND l.pos = gone.pos WHERE gone.r IS NULL GROUP BY l.r)
    SELECT a.doc_id, CASE WHEN a.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text,
        CAST(coalesce(len(string_split(a.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_dropped
    FROM a LEFT JOIN s ON a.r = s.r LEFT JOIN left_ ON a.r = left_.r"""
