"""Texts as files below a folder: a Spark data source that writes whole files or none.

A task writes its files to a folder of its own attempt, below a staging folder beside the
target: numbered ones, in few folders, each with a list of the paths they are meant for.
When all tasks are through, the writer's commit notes which attempts count, and their files
are moved to their places, each by one rename, by tasks again.  What failed or lost attempts have written
goes with the staging folder, which never holds the tree's own directories.  So no reader ever
meets half a file, and a job that fails before its commit changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.shipping import ship

#: Files per staging folder, which are moved by one task.
PER_FOLDER = 1000


def file_system(folder: str):
    """pyarrow's file system and the bare path of a folder given as URI or local path."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


@dataclass
class Attempt(WriterCommitMessage):
    """A task attempt's folder and the files in it."""

    folder: str
    files: int


class TreeSink(DataSource):
    """`format('repoloom_tree')` with option `staging`: rows (path, content) to staged files."""

    @classmethod
    def name(cls) -> str:
        return "repoloom_tree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["staging"], schema.fieldNames())


class TreeWriter(DataSourceWriter):
    def __init__(self, staging: str, names: list[str]) -> None:
        self.staging = staging
        self.at = names.index("path"), names.index("content")

    def write(self, iterator: Iterator) -> Attempt:
        # A name of its own, so that attempts which run at once don't meet.
        system, inner = file_system(f"{self.staging}/{uuid.uuid4().hex}")
        files, names = 0, None
        try:
            for row in iterator:
                path, content = row[self.at[0]], row[self.at[1]]
                folder, place = divmod(files, PER_FOLDER)
                if not place:
                    if names is not None:
                        names.close()
                    system.create_dir(f"{inner}/{folder}", recursive=True)
                    names = system.open_output_stream(f"{inner}/{folder}/_paths", compression=None)
                with system.open_output_stream(f"{inner}/{folder}/{place}", compression=None) as out:
                    out.write((content or "").encode())
                names.write((json.dumps(path) + "\n").encode())
                files += 1
        finally:
            if names is not None:
                names.close()
        return Attempt(inner, files)

    def commit(self, messages: list[Attempt | None]) -> None:
        """Notes the attempts that count, a line each."""
        system, inner = file_system(self.staging)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/_attempts") as out:
            for m in messages:
                if m is not None and m.files:
                    out.write((json.dumps({"folder": m.folder, "files": m.files}) + "\n").encode())

    def abort(self, messages: list[Attempt | None]) -> None:
        remove(self.staging)


def remove(folder: str) -> None:
    from pyarrow import fs

    system, inner = file_system(folder)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def _moved(target: str):
    """Renames the files of staging folders to their places; one that is gone was moved before."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, inner = file_system(target)
        moved, made = 0, set()
        for folder in (f for batch in batches for f in batch["folder"]):
            with system.open_input_stream(f"{folder}/_paths", compression=None) as lines:
                paths = [json.loads(x) for x in lines.read().decode().splitlines()]
            for i, path in enumerate(paths):
                source, place = f"{folder}/{i}", f"{inner}/{path}"
                if system.get_file_info(source).type != fs.FileType.File:
                    continue
                above = place.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made.add(above)
                system.move(source, place)
                moved += 1
        yield pd.DataFrame({"moved": [moved]})

    return move


def write_files(files: DataFrame, folder: str) -> int:
    """files(path, content) as files below a folder, in place of those that are there; their number.

    `folder` is a URI or local path that all executors reach.  Paths are relative to it and
    must differ, or any one of a path's rows stays.  Files that the rows don't name are left alone.
    A null content is an empty file.  Only the attempts' folders, one per task, reach the driver.
    """
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(TreeSink)
    staging = f"{folder.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows = files.select("path", "content").filter(F.col("path").isNotNull())
    try:
        rows.write.format("repoloom_tree").option("staging", staging).mode("append").save()
        system, inner = file_system(staging)
        with system.open_input_stream(f"{inner}/_attempts") as lines:
            attempts = [json.loads(x) for x in lines.read().decode().splitlines()]
        if attempts:
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            noted = spark.createDataFrame([(a["folder"], a["files"]) for a in attempts], "folder string, files long")
            last = F.floor((F.col("files") - 1) / PER_FOLDER)
            parts = noted.select("folder", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
            parts = parts.select(F.concat_ws("/", "folder", "part").alias("folder"))
            folders = sum(-(-a["files"] // PER_FOLDER) for a in attempts)
            parts.repartition(min(folders, tasks)).mapInPandas(_moved(folder), "moved long").agg(F.sum("moved")).collect()
        return sum(a["files"] for a in attempts)
    finally:
        remove(staging)
