"""A data source that lists run directories in parallel.

The driver lists one level, the run directories below the root, and deals them
out; each task lists its directories with everything below them. A filter on
``run`` (equal, or one of some) reaches the listing where
``spark.sql.python.filterPushdown.enabled`` is on: other directories are not
listed. Names that begin with ``.`` or ``_`` are skipped, as Spark's file
sources do. The file system is found from the root's URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Run directories a task lists.
PER_TASK = 256


@dataclass
class Runs(InputPartition):
    names: list[str]
    #: Files that lie directly below the root, which is no run.
    loose: bool = False


def _hidden(path: str) -> bool:
    return any(part.startswith((".", "_")) for part in path.split("/"))


class RunInventory(DataSource):
    """Options: ``root``, a path or URI; ``runs``, a JSON list of directory names."""

    @classmethod
    def name(cls) -> str:
        return "run_inventory"

    def schema(self) -> T.StructType:
        text = T.StringType()
        return T.StructType([T.StructField("path", text), T.StructField("length", T.LongType()), T.StructField("run", text), T.StructField("file", text)])

    def reader(self, schema: T.StructType) -> RunInventoryReader:
        return RunInventoryReader(dict(self.options))


class RunInventoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("root"):
            raise ValueError("run_inventory needs a root")
        root = options["root"].rstrip("/")
        self.root = root if "://" in root or not root.startswith("file:") else "file://" + root.removeprefix("file:")
        self.runs = json.loads(options["runs"]) if options.get("runs") else None

    def _system(self) -> tuple[arrow_fs.FileSystem, str]:
        return arrow_fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[Runs]:
        system, top = self._system()
        if self.runs is None:
            entries = system.get_file_info(arrow_fs.FileSelector(top))
            names = sorted(e.base_name for e in entries if e.type == arrow_fs.FileType.Directory and not _hidden(e.base_name))
            loose = any(e.type == arrow_fs.FileType.File and not _hidden(e.base_name) for e in entries)
        else:
            names, loose = [n for n in self.runs if n and "/" not in n and not _hidden(n)], False
        dealt = [Runs(names[i : i + PER_TASK]) for i in range(0, len(names), PER_TASK)]
        return dealt + [Runs([], loose=True)] * loose or [Runs([])]

    def read(self, partition: Runs) -> Iterator[tuple]:
        system, top = self._system()
        base = self.root if "://" in self.root else "file:" + self.root
        selectors = [arrow_fs.FileSelector(posixpath.join(top, n), recursive=True, allow_not_found=True) for n in partition.names]
        if partition.loose:
            selectors.append(arrow_fs.FileSelector(top))
        for selector in selectors:
            for e in system.get_file_info(selector):
                relative = posixpath.relpath(e.path, top)
                if e.type != arrow_fs.FileType.File or _hidden(relative):
                    continue
                run, _, file = relative.partition("/")
                yield f"{base}/{relative}", int(e.size), (run if file else None), file or run


class FilteredRunInventory(RunInventory):
    """The same where Spark hands filters to Python sources; elsewhere it refuses a reader that takes them."""

    @classmethod
    def name(cls) -> str:
        return "run_inventory_filtered"

    def reader(self, schema: T.StructType) -> RunInventoryReader:
        return FilteredReader(dict(self.options))


class FilteredReader(RunInventoryReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("run",):
                self._restrict([f.value])
            elif isinstance(f, In) and f.attribute == ("run",):
                self._restrict(f.value)
            else:
                yield f

    def _restrict(self, names: Iterable) -> None:
        wanted = {n for n in names if n is not None}
        self.runs = sorted(wanted if self.runs is None else wanted & set(self.runs))
