"""Source trees on a file system, and rewritten files back to one."""

import os
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import rules
from ..functions.shipping import ship
from ..operators.filters import scannable_expr
from ..operators.rounds import Rounds

_ENTRY = "repo string, path string, root string, location string, is_dir boolean, size bigint"
_FILE = "repo string, path string, size bigint, content string"


def read_files(spark: SparkSession, location: str) -> DataFrame:
    """The usual corpus form: a parquet table files(repo, path, content)."""
    return spark.read.parquet(location)


# Text gathered, and entries listed, before a task hands them on.
_READ_BATCH_CHARS = 16 << 20
_LIST_BATCH = 10_000
#: Directories after which a task hands on those it finds.
DIRS_PER_TASK = 200


class _Systems:
    """The file system of each root, made once per task."""

    def __init__(self) -> None:
        self.known: dict = {}

    def of(self, root: str):
        from pyarrow import fs

        if root not in self.known:
            plain = "://" not in root and not root.startswith("file:")
            self.known[root] = (fs.LocalFileSystem(), root) if plain else fs.FileSystem.from_uri(root)
        return self.known[root]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, f.type) for values, f in zip(zip(*rows), fields)], schema=pa.schema(fields)
    )


def _listing(excluded: str, budget: int):
    """Entries of the given directories; those that may not be read have none.

    A task goes on with the directories it finds, the nearest first, until it has listed
    `budget` of them; the others come out as directories still to be listed.  So a deep tree
    takes few rounds, and a large one is dealt out anew before a task has much of it.
    Symbolic links are not followed.  Only roots are URIs; below them bare paths are passed on,
    so any name a file system allows is taken as it is.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        systems, left_out = _Systems(), re.compile(excluded)
        rows, own, listed = [], deque(), 0

        def directories() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["repo"], row["path"], row["root"], row["location"]
            while own:
                yield own.popleft()

        for repo, path, root, location in directories():
            listed += 1
            system, inner = systems.of(root)
            try:
                entries = system.get_file_info(fs.FileSelector(location or inner))
            except PermissionError:
                continue
            local = isinstance(system, fs.LocalFileSystem)
            for e in entries:
                shown = f"{path}/{e.base_name}"
                if left_out.search(shown) or (local and os.path.islink(e.path)):
                    continue
                is_dir = e.type == fs.FileType.Directory
                if is_dir and listed + len(own) < budget:
                    own.append((repo, shown, root, e.path))
                    continue
                rows.append((repo, shown, root, e.path, is_dir, e.size or 0))
                if len(rows) == _LIST_BATCH:
                    yield _batch(rows, _ENTRY)
                    rows = []
        if rows:
            yield _batch(rows, _ENTRY)

    return walk


def _read_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts of the given files, invalid UTF-8 replaced; NULL where reading isn't permitted."""
    systems = _Systems()
    rows, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            system, _ = systems.of(row["root"])
            try:
                with system.open_input_stream(row["location"], compression=None) as stream:
                    content = stream.read().decode("utf-8", errors="replace")
            except PermissionError:
                content = None
            rows.append((row["repo"], row["path"], row["size"], content))
            held += len(content or "")
            if held > _READ_BATCH_CHARS or len(rows) == _LIST_BATCH:
                yield _batch(rows, _FILE)
                rows, held = [], 0
    if rows:
        yield _batch(rows, _FILE)


def _named_roots(roots: Iterable[str]) -> list[tuple[str, str]]:
    """(repo, root): the last segment, and for later roots of the same one a number behind it."""
    named: dict[str, str] = {}
    for root in (r.rstrip("/") for r in roots):
        name = wanted = root.rsplit("/", 1)[-1]
        number = 1
        while name in named:
            number += 1
            name = f"{wanted}-{number}"
        named[name] = root
    return list(named.items())


def scan_corpus(
    spark: SparkSession,
    roots: Iterable[str],
    extra_excludes: Iterable[str] = (),
    scan_headers: bool = True,
    tasks: int | None = None,
    excludes: Iterable[str] = fv.EXCLUDED_NAMES,
    kept_dot_names: Iterable[str] = fv.KEPT_DOT_NAMES,
) -> DataFrame:
    """Directories given as URIs or local paths -> files(repo, path, size, content).

    Spark's own file listing hides names that start with '_' or '.', which are
    ordinary source files here, so directories are listed by tasks, a part of all trees at
    a time, which is stored and listed once.  Excluded directories are never entered; annotation, which leaves
    out others than description does, gives its own lists.  Contents are read where
    a header scan or annotation can use them.  What may not be read is passed over; any other
    failure of the file system fails the scan.
    """
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ship(spark)
    listing = _listing(rules.excluded_in_tasks([*excludes, *extra_excludes], list(kept_dot_names)), DIRS_PER_TASK)
    rows = [(name, name, root, None, True, 0) for name, root in _named_roots(roots)]
    frontier, waiting = spark.createDataFrame(rows, _ENTRY), len(rows)
    rounds, files = Rounds(spark, "scan"), None
    while True:
        dealt = frontier.repartition(max(1, min(tasks, waiting)))
        entries = rounds.store(dealt.mapInArrow(listing, _ENTRY))
        found = entries.filter(~F.col("is_dir"))
        files = found if files is None else files.unionByName(found)
        frontier = entries.filter("is_dir")
        waiting = frontier.count()
        if not waiting:
            break
    unread = files.select("repo", "path", "size", F.lit(None).cast("string").alias("content"))
    if not scan_headers:
        return unread
    wanted = (
        scannable_expr()
        | rules.is_one_of("substring_index(path, '/', -1)", fv.README_NAMES)
        | rules.is_one_of(rules.PATH_EXTENSION, fv.ANNOTATABLE_EXTENSIONS)
    )
    read = files.filter(wanted).repartition(tasks).mapInArrow(_read_contents, _FILE)
    return unread.filter(~wanted).unionByName(read)


def rewritten_path(in_place: bool = False) -> Column:
    """'a/b.py' -> 'a/b.annotated.py', or the path itself."""
    if in_place:
        return F.col("path")
    # Looked for in the name only; a leading dot starts no suffix.
    suffix = r"regexp_extract(substring_index(path, '/', -1), '(?s)^.+(\\.[^.]+)$', 1)"
    return F.expr(
        f"concat(left(path, length(path) - length({suffix})), '.annotated', {suffix})"
    )


def by_repo(rows: DataFrame) -> DataFrame:
    """Rows clustered for a write partitioned by repo.

    Without it every task would leave a file in every repo.  The rebalance lets
    AQE merge small repos into one task and split a large one over several.
    """
    return rows.hint("rebalance", "repo")


def with_target(files: DataFrame, in_place: bool = False) -> DataFrame:
    return files.withColumn("target", rewritten_path(in_place))


def write_rewritten(files: DataFrame, location: str, in_place: bool = False) -> None:
    """files(repo, path, content) -> parquet by repo with the target path of each text.

    """
    (
        by_repo(with_target(files, in_place).select("repo", "path", "target", "content"))
        .write.mode("overwrite")
        .partitionBy("repo")
        .parquet(location)
    )
