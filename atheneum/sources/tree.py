"""A data source over folder trees: `spark.read.format("tree").load(root)` gives a row for each file, without opening any.

The driver lists the first two levels; what is below is listed by tasks, a folder each. Filters on path and folder that
name a beginning or a value are taken over: folders that cannot match are never listed. The tree has to be mounted on
all machines.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from atheneum.functions.filters import SKIPPED_NAMES, SKIPPED_SUFFIXES


def _skipped(name: str) -> bool:
    return name in SKIPPED_NAMES or name.endswith(tuple(SKIPPED_SUFFIXES))


@dataclass
class Folder(InputPartition):
    path: str  # below the root, "" for it
    deep: bool  # with all below it, or its own files alone


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, folder string, name string, size_bytes long, modified_at timestamp"

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(self.options["path"].removeprefix("file://").rstrip("/"))


class TreeReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root
        self.prefixes: list[list[str]] = []  # of each filter, the beginnings of which a path has to have one

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802, Spark's name
        for f in filters:
            column = getattr(f, "attribute", None)
            if column in (("path",), ("folder",)) and isinstance(f, EqualTo | StringStartsWith):
                self.prefixes.append([f.value])
            elif column in (("path",), ("folder",)) and isinstance(f, In):
                self.prefixes.append(list(f.value))
            yield f  # a beginning is weaker than the filter, which Spark applies as well

    def _may_hold(self, folder: str) -> bool:
        """Whether a path below the folder can have the beginnings."""
        return not folder or all(any(p is not None and (p.startswith(folder + "/") or folder.startswith(p) or p == folder) for p in some) for some in self.prefixes)

    def _children(self, folder: str) -> list[str]:
        with os.scandir(os.path.join(self.root, folder) if folder else self.root) as found:
            names = sorted(e.name for e in found if e.is_dir(follow_symlinks=False) and not _skipped(e.name))
        return [f for f in (f"{folder}/{n}" if folder else n for n in names) if self._may_hold(f)]

    def partitions(self) -> list[InputPartition]:
        top = self._children("")
        return [Folder("", False), *(Folder(t, False) for t in top), *(Folder(c, True) for t in top for c in self._children(t))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path]
        while todo:
            folder = todo.pop()
            try:
                found = sorted(os.scandir(os.path.join(self.root, folder) if folder else self.root), key=lambda e: e.name)
            except OSError:
                continue  # gone since it was listed, or not to be read
            for e in found:
                if _skipped(e.name):
                    continue
                path = f"{folder}/{e.name}" if folder else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        if partition.deep and self._may_hold(path):
                            todo.append(path)
                    elif e.is_file():
                        s = e.stat()
                        yield path, folder or ".", e.name, s.st_size, datetime.fromtimestamp(s.st_mtime, tz=timezone.utc)
                except OSError:
                    continue


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The files below root: path, folder (`.` for the root), name, size_bytes, modified_at."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree").load(root)


def content_hashes(files: DataFrame, root: str) -> DataFrame:
    """(path, content_hash) of the files whose size another file has; no other is opened. A file that cannot be read has null."""
    sizes = files.where("size_bytes > 0").groupBy("size_bytes").agg(F.count("*").alias("_n")).where("_n > 1").select("size_bytes")
    base = root.removeprefix("file://").rstrip("/")

    def run(batches):  # noqa: ANN001, ANN202
        import hashlib

        import pyarrow as pa

        for b in batches:
            digests = []
            for path in b.column(0).to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        digests.append(hashlib.file_digest(f, "sha256").hexdigest())
                except OSError:
                    digests.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.string())], names=["path", "content_hash"])

    return files.join(sizes, "size_bytes", "left_semi").select("path").mapInArrow(run, "path string, content_hash string")
