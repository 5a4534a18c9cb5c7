"""Tables that grow by commits (S08, ST2): files written by Spark, and which of
them count.

A folder has ``data/<commit>/`` and ``commits/<commit>.json``. Rows of a commit
count once its small file is there, which comes last and in one rename, so a
job that dies half-way leaves nothing that is read, and its retry overwrites
the same folder. A commit that is there already is not made again. One writer
at a time; any number of readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdraft.sources.files import csv_ready


class Commits:
    """The small files of a table, through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._folder = self._path(f"{self.root}/commits")
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def names(self) -> list[str]:
        if not self._fs.exists(self._folder):
            return []
        files = [str(s.getPath().getName()) for s in self._fs.listStatus(self._folder)]
        return sorted(f.removesuffix(".json") for f in files if f.endswith(".json") and not f.startswith((".", "_")))

    def body(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{name}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, name: str, body: dict) -> None:
        final = self._path(f"{self.root}/commits/{name}.json")
        if self._fs.exists(final):
            raise FileExistsError(f"{name} is committed already: another writer?")
        draft = self._path(f"{self.root}/commits/.{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"could not commit {name}")

    def data(self, name: str) -> str:
        return f"{self.root}/data/{name}"

    def drop(self, name: str) -> None:
        """Forget a commit, then delete its rows."""
        self._fs.delete(self._path(f"{self.root}/commits/{name}.json"), False)
        self._fs.delete(self._path(self.data(name)), True)


def _least_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, the least in column order."""
    return df.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row")).select("_row.*")


def _counting(commits: Commits) -> dict[str, dict]:
    """The commits whose rows count: those that no later one has replaced."""
    bodies = {n: commits.body(n) for n in commits.names()}
    gone = {n for b in bodies.values() for n in b.get("replaces", [])}
    return {n: b for n, b in bodies.items() if n not in gone}


def append_runs(spark: SparkSession, rows: DataFrame, root: str, commit: str, key: str = "run") -> bool:
    """Append finished runs as CSV, each run once however often it is sent.

    False if ``commit`` is there already; nothing is read or written then. Rows
    of runs that earlier commits hold are left out, as are further rows of one
    run in ``rows`` (the least in column order stays) and rows without a run.
    The first commit's columns are the table's: later rows may lack some, and
    fail if they bring others. Nested values are JSON text.
    """
    commits = Commits(spark, root)
    if commit in commits.names():
        return False
    rows = csv_ready(rows.filter(F.col(key).isNotNull()))
    before = _counting(commits)
    if before:
        schema = T.StructType.fromDDL(next(iter(before.values()))["columns"])
        if extra := [c for c in rows.columns if c not in schema.names]:
            raise ValueError(f"columns that the table does not have: {', '.join(extra)}")
        rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        rows = rows.join(read_runs(spark, root).select(key), key, "left_anti").select(*[F.col(f"`{c}`") for c in schema.names])
    else:
        schema = rows.schema
    _write(_least_per_key(rows, key), commits.data(commit))
    commits.add(commit, {"columns": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)})
    return True


def _write(rows: DataFrame, path: str) -> None:
    # An escaped quote is doubled, so that any text comes back as it was.
    rows.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue='""', nullValue="", quoteAll=True).csv(path)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs of all commits, one row each. Only committed folders are read."""
    commits = Commits(spark, root)
    counting = _counting(commits)
    if not counting:
        raise FileNotFoundError(f"no commits below {root}")
    options = dict(header=True, quote='"', escape='"', emptyValue="", nullValue=None, multiLine=True, mode="FAILFAST")
    schema = T.StructType.fromDDL(next(iter(counting.values()))["columns"])
    return spark.read.schema(schema).options(**{k: v for k, v in options.items() if v is not None}).csv([commits.data(n) for n in counting])


def compact_runs(spark: SparkSession, root: str) -> str | None:
    """Put all commits together as one and delete them; returns its name, None
    if there is one at most. What was sent under a name before stays known."""
    commits = Commits(spark, root)
    counting = _counting(commits)
    if len(counting) < 2:
        return None
    name = f"compact-{uuid.uuid4().hex}"
    _write(read_runs(spark, root), commits.data(name))
    commits.add(name, {"columns": next(iter(counting.values()))["columns"], "replaces": sorted(counting)})
    for old in counting:
        commits._fs.delete(commits._path(commits.data(old)), True)
    return name


BUCKETS = 64


def _bucket(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert_newest(spark: SparkSession, rows: DataFrame, root: str, source: str, batch: int, *, key: str, newest: Sequence[str], buckets: int = BUCKETS) -> bool:
    """ST2: put rows into a table of one row per ``key``, the newest of those
    that ever came (largest ``newest``, then the largest in column order).

    The table lies in buckets by a hash of the key. A batch reads and rewrites
    only the buckets it touches; a commit names the folder of every bucket, so
    reading needs no regrouping and the state is one row per key and one name a
    bucket, however many batches came. ``source`` and ``batch`` tell a batch:
    False if that or a later one of the source is in already. Folders that the
    last two commits don't name are deleted.
    """
    commits = Commits(spark, root)
    names = commits.names()
    state = commits.body(names[-1]) if names else {"places": {}, "sources": {}, "buckets": buckets, "columns": rows.schema.json()}
    if state["sources"].get(source, -1) >= batch:
        return False
    rows = rows.filter(F.col(key).isNotNull()).withColumn("_bucket", _bucket(key, state["buckets"]))
    touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
    old = [state["places"][str(b)] for b in touched if str(b) in state["places"]]
    schema = T.StructType.fromJson(json.loads(state["columns"]))
    if old:
        kept = spark.read.schema(schema).parquet(*[f"{commits.root}/{p}" for p in old])
        rows = kept.withColumn("_bucket", _bucket(key, state["buckets"])).unionByName(rows)
    row = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    best = rows.groupBy("_bucket", key).agg(F.max_by(row, F.struct(*[F.col(c) for c in newest], row)).alias("_row"))
    number = f"{int(names[-1]) + 1 if names else 0:012d}"
    best.select("_bucket", "_row.*").write.mode("overwrite").partitionBy("_bucket").parquet(commits.data(number))
    places = state["places"] | {str(b): f"data/{number}/_bucket={b}" for b in touched}
    commits.add(number, state | {"places": places, "sources": state["sources"] | {source: batch}})
    _forget(commits, [*names, number])
    return True


def _forget(commits: Commits, names: list[str]) -> None:
    """Delete what only commits before the last two name."""
    named = {p for n in names[-2:] for p in commits.body(n)["places"].values()}
    for n in names[:-2]:
        for place in commits.body(n)["places"].values():
            if place not in named:
                commits._fs.delete(commits._path(f"{commits.root}/{place}"), True)
        commits._fs.delete(commits._path(f"{commits.root}/commits/{n}.json"), False)


def read_newest(spark: SparkSession, root: str) -> DataFrame:
    """ST2: the table as of the last commit, one row per key."""
    commits = Commits(spark, root)
    names = commits.names()
    if not names:
        raise FileNotFoundError(f"no commits below {root}")
    state = commits.body(names[-1])
    schema = T.StructType.fromJson(json.loads(state["columns"]))
    if not state["places"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{commits.root}/{p}" for p in state["places"].values()])
