"""Helpers the corpus operators share: work folders, stored tables, text buffers, packed columns."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.functions.shipping import ship  # noqa: F401


U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names.

    Only where that setting is absent and everything runs on this machine a
    temporary folder takes its place; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"repoloom-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/repoloom-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back; cuts the lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: Column) -> Column:
    """Tells apart rows of one doc_id that hold different texts; null texts are empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# -- text as bytes ---------------------------------------------------------------


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, joined, and the n + 1 borders; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, borders, data = column.buffers()
    ends = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def byte_values(seed: int) -> np.ndarray:
    """A 64-bit number for each byte value."""
    return np.random.default_rng(seed).integers(0, 2**64, 256, dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values in place (finalizer of splitmix64)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


# -- packed columns --------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Equal-length arrays as one compressed binary value, byte plane by byte plane.

    Ascending columns are worth differencing first: their upper planes vanish.
    """
    planes = [
        np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes()
        for c in columns
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of `pack`, given their dtypes."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(value), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(sizes)
    found, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        plane = raw[at : at + n * size].reshape(size, n)
        found.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * size
    return found


def differences(values: np.ndarray) -> np.ndarray:
    """values[0], then the steps; `np.cumsum` of the same dtype undoes it, wrapping included."""
    steps = values.copy()
    steps[1:] -= values[:-1]
    return steps


def groups_of(keys: Sequence[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Borders of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    if not n:
        return
    change = np.zeros(n - 1, bool)
    for key in keys:
        change |= key[1:] != key[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
    yield from zip(starts[:-1], starts[1:], strict=True)


# -- files that tasks write and read themselves ------------------------------------


def file_system(folder: str):
    """pyarrow's file system and the bare path of a folder given as URI or local path."""
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)
