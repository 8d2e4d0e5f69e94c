"""Row numbers inside groups of any size, and the folder that intermediate tables go to."""

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship

# Up to here Spark limits a rank before the shuffle as well.
LIMITED_RANK = 1000


def shared_directory(spark: SparkSession) -> str:
    """The folder all executors see, as the session or its context names it.

    Where neither does, a local one takes its place only if everything runs in one process.
    """
    directory = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    directory = directory or context.getCheckpointDir()
    if directory:
        return directory.rstrip("/")
    if not context.master.startswith("local") or "cluster" in context.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_directory(spark))


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Adds the 1-based position of each row among those with equal keys, as a bigint.

    One way for groups of any size, and each row moves once: the rows are sorted into
    ranges of (keys, order), numbered inside their range, and written to the shared
    folder, which fixes the ranges.  A group that runs over several ranges is continued by
    an offset; only the first group of a range can have one, so there are at most as
    many offsets as ranges.  Rows that are equal in keys and order get any of their positions.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns
    flagged = [c for key in keys for c in (F.isnull(key), F.col(key))]
    by = [*[F.col(k) for k in keys], *order]
    keyed = rows.withColumn("_group", F.xxhash64(F.lit(0), *flagged))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    folder = f"{shared_directory(spark)}/repoloom-ranks/{uuid.uuid4().hex}"
    (
        keyed.repartitionByRange(tasks, *by)
        .sortWithinPartitions(*by)
        .mapInArrow(_numbered, f"{kinds}, _range int, _place bigint")
        .write.parquet(folder)
    )
    numbered = spark.read.parquet(folder)
    spans = numbered.groupBy("_group", "_range").agg(F.max("_place").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("_group", "_range", F.sum("_rows").over(before).alias("_offset"))
    # A row per range at most.
    offsets = F.broadcast(offsets.filter("_offset > 0"))
    place = F.col("_place") + F.coalesce(F.col("_offset"), F.lit(0))
    return numbered.join(offsets, ["_group", "_range"], "left").select(*columns, place.alias(out))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts on through the runs of equal groups of one sorted range."""
    at = TaskContext.get().partitionId()
    last, carried = None, 0
    for batch in batches:
        group = batch.column("_group").to_numpy()
        if not len(group):
            continue
        starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        lengths = np.diff(np.concatenate([starts, [len(group)]]))
        place = np.arange(1, len(group) + 1) - np.repeat(starts, lengths)
        if group[0] == last:
            place[: lengths[0]] += carried
        last, carried = group[-1], int(place[-1])
        yield batch.append_column("_range", pa.array(np.full(len(group), at, np.int32))).append_column(
            "_place", pa.array(place)
        )


def first_ranks(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str
) -> DataFrame:
    """The first n rows of each group with their position.

    A small n is limited inside every task, so that at most n rows per group and task
    travel; beyond what Spark limits that way, whole groups are ranked by ranges.
    """
    if n > LIMITED_RANK:
        return ranked(rows, keys, order, out).filter(F.col(out) <= n)
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(window).cast("bigint")).filter(F.col(out) <= n)
