"""A watched source tree as a stream of new and changed files: a Spark data source.

An offset is a point in time.  A batch holds the files that were last modified after the
offset before it and up to its own, so what a checkpoint keeps doesn't grow with the tree, and
listing is the tasks' work: each lists one directory below the root with all that is in it.
Removed files leave no row.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from ..sources.tree_sink import file_system
from ..sources.tree_source import wanted

_SCHEMA = "repo string, path string, size bigint, content string"


class TreeWatch(DataSource):
    """`format('repoloom_watch')` with options `folder` and `settle`, seconds that a file must have rested."""

    @classmethod
    def name(cls) -> str:
        return "repoloom_watch"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return WatchReader(self.options["folder"], float(self.options.get("settle", "1")))


class Below(InputPartition):
    """A directory to list, with all below it or its own files only, and the time between two offsets."""

    def __init__(self, path: str, whole: bool, after: int, until: int) -> None:
        self.path, self.whole, self.after, self.until = path, whole, after, until


class WatchReader(DataSourceStreamReader):
    def __init__(self, folder: str, settle: float) -> None:
        self.folder, self.settle = folder.rstrip("/"), settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = file_system(self.folder)
        times = start["until"], end["until"]
        found = [Below(inner, False, *times)]
        for e in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if e.type == fs.FileType.Directory and wanted(e.base_name):
                found.append(Below(e.path, True, *times))
        return found

    def read(self, partition: Below) -> Iterator[tuple]:
        from pyarrow import fs

        system, inner = file_system(self.folder)
        repo = inner.rsplit("/", 1)[-1]
        todo = [partition.path]
        while todo:
            try:
                entries = system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True))
            except PermissionError:
                continue
            for e in entries:
                if not wanted(e.base_name):
                    continue
                if e.type == fs.FileType.Directory:
                    if partition.whole:
                        todo.append(e.path)
                elif e.type == fs.FileType.File and partition.after < e.mtime_ns <= partition.until:
                    try:
                        with system.open_input_stream(e.path, compression=None) as file:
                            body = file.read()
                    except FileNotFoundError:  # gone since
                        continue
                    yield repo, f"{repo}/{e.path[len(inner) + 1 :]}", len(body), body.decode(errors="replace")


def watch_tree(spark: SparkSession, folder: str, settle: float = 1.0) -> DataFrame:
    """Stream of (repo, path, size, content): files below a folder that are new or changed.

    Paths start with the folder's own name.  Excluded names are passed over with all below
    them.  A file that is changed while it is read comes again in a later batch.  A file counts by its
    time of modification: one that is moved in with a time before the last offset isn't seen, so
    `settle` should be longer than writers take from a file's last byte to its place.
    """
    ship(spark)
    spark.dataSource.register(TreeWatch)
    reader = spark.readStream.format("repoloom_watch")
    return reader.option("folder", folder).option("settle", str(settle)).load()
