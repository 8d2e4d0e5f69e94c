"""A source tree as a batch data source: partitions are made of directories, headers are read by range.

The driver lists from the root downwards only until there are enough directories to keep all
tasks busy; below those the tasks list for themselves.  However many directories that level has,
they are dealt to a number of partitions that the number of tasks alone bounds.  Conditions on path reach the tasks
before a file is opened, and where headers are enough only the beginning of a file is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from ..functions import fixed_values as fv
from ..functions.shipping import ship
from .tree_sink import file_system

_SCHEMA = "repo string, path string, size bigint, content string"
#: Files of one directory that a task takes on.
FILES_PER_TASK = 20_000
#: Partitions per task, at most, that the directories of a level are dealt to.
SHARES = 16
#: Bytes that hold the 4,096 characters of a header for sure: four a character, and each may
#: be one of the two of a line end.
HEADER_BYTES = 4096 * 4 * 2


class TreeSource(DataSource):
    """`format('repoloom_files')` with options `folder`, `headers`, `everything` and `tasks`."""

    @classmethod
    def name(cls) -> str:
        return "repoloom_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.options
        everything = options.get("everything") == "true"
        return TreeReader(options["folder"], options.get("headers") == "true", int(options.get("tasks", "8")), everything)


class Part(InputPartition):
    """Directories with all below them, or the k-th of n shares of a directory's own files."""

    def __init__(self, paths: list[str], whole: bool, k: int = 0, n: int = 1) -> None:
        self.paths, self.whole, self.k, self.n = paths, whole, k, n

    @property
    def path(self) -> str:
        return self.paths[0]


def dealt(paths: list[str], n: int) -> list[list[str]]:
    """Paths in n equal shares at most, neighbours apart."""
    mixed = sorted(paths, key=lambda p: (zlib.crc32(p.encode(errors="surrogateescape")), p))
    return [mixed[k::n] for k in range(min(n, len(mixed)))]


def wanted(name: str) -> bool:
    """Whether a walk takes a name, by the exclude list and the rule on leading dots."""
    return name not in fv.EXCLUDED_NAMES and (not name.startswith(".") or name in fv.KEPT_DOT_NAMES)


class TreeReader(DataSourceReader):
    def __init__(self, folder: str, headers: bool, tasks: int, everything: bool = False) -> None:
        self.folder, self.headers, self.tasks, self.everything = folder.rstrip("/"), headers, tasks, everything
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes conditions on path as hints; Spark applies all of them again."""
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("path",):
                self.suffixes.append(f.value)
            elif isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            yield f

    def _file(self, path: str) -> bool:
        return (
            all(path.startswith(p) for p in self.prefixes)
            and all(path.endswith(s) for s in self.suffixes)
            and (self.names is None or path in self.names)
        )

    def _directory(self, path: str) -> bool:
        """Whether a file that is asked for may lie below a directory."""
        below = f"{path}/"
        return all(p.startswith(below) or below.startswith(p) for p in self.prefixes) and (
            self.names is None or any(x.startswith(below) for x in self.names)
        )

    def _listed(self, path: str) -> tuple[list, list]:
        """Directories and files of a directory that are wanted; one that may not be read has none."""
        from pyarrow import fs

        system, inner = file_system(self.folder)
        try:
            entries = system.get_file_info(fs.FileSelector(path))
        except PermissionError:
            return [], []
        local = isinstance(system, fs.LocalFileSystem)
        if local:
            import os

            entries = [e for e in entries if not os.path.islink(e.path)]
        if not self.everything:
            entries = [e for e in entries if wanted(e.base_name)]
        dirs = [e for e in entries if e.type == fs.FileType.Directory and self._directory(self._shown(inner, e.path))]
        files = [e for e in entries if e.type == fs.FileType.File and self._file(self._shown(inner, e.path))]
        return dirs, files

    @staticmethod
    def _shown(inner: str, path: str) -> str:
        """The path that starts with the root's own name."""
        return inner.rsplit("/", 1)[-1] + path[len(inner) :]

    def partitions(self) -> list[InputPartition]:
        _, inner = file_system(self.folder)
        found, level = [], [inner]
        while level and len(level) < 4 * self.tasks:
            following = []
            for path in level:
                dirs, files = self._listed(path)
                following += [e.path for e in dirs]
                n = -(-len(files) // FILES_PER_TASK)
                found += [Part([path], False, k, n) for k in range(n)]
            level = following
        # One at least: an empty tree still has its root.
        return [*found, *(Part(own, True) for own in dealt(level, SHARES * self.tasks))] or [Part([inner], False)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, inner = file_system(self.folder)
        repo = inner.rsplit("/", 1)[-1]
        todo = list(partition.paths)
        while todo:
            dirs, files = self._listed(todo.pop())
            if partition.whole:
                todo += [e.path for e in dirs]
            for e in files:
                if partition.n > 1 and zlib.crc32(e.base_name.encode()) % partition.n != partition.k:
                    continue
                yield repo, self._shown(inner, e.path), e.size, self._content(system, e)

    def _content(self, system, entry) -> str | None:
        if self.headers and any(entry.base_name.lower().endswith(x) for x in fv.BINARY_EXTENSIONS):
            return None
        try:
            with system.open_input_stream(entry.path, compression=None) as file:
                body = file.read(HEADER_BYTES) if self.headers else file.read()
        except (PermissionError, FileNotFoundError):
            return None
        return body.decode(errors="replace")


def scan_tree(spark: SparkSession, folder: str, headers: bool = False, everything: bool = False) -> DataFrame:
    """files(repo, path, size, content) of the tree below a folder given as URI or local path.

    Excluded names are passed over with all below them, unless `everything` is asked for; symbolic links are not followed.  With `headers`
    content is only the beginning of each file, enough for its header, and null for binary
    extensions.  Conditions on path are applied before files are opened.
    """
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    options = {"folder": folder, "headers": str(headers).lower(), "everything": str(everything).lower(), "tasks": str(spark.sparkContext.defaultParallelism)}
    return spark.read.format("repoloom_files").options(**options).load()
