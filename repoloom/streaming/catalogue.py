"""Catalogue and file changes as streams.

Marks and tags are stateless, so the batch operators run unchanged.  The latest
catalogue per key is kept as a log of parsed versions, one folder per
micro-batch: writing is idempotent, nothing already written is rewritten, and no
stream state holds whole documents.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.shipping import ship
from ..operators import marks
from ..operators.ranking import shared_directory
from ..plans.catalogue import tagged_files


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_directory(spark)}/{name}-{uuid.uuid4().hex}"


def latest_versions(catalogues: DataFrame) -> DataFrame:
    """(repo, version, body) of the newest version of each catalogue."""
    newest = F.max_by(F.struct("version", "body"), F.col("version"))
    return (
        catalogues.groupBy("repo")
        .agg(newest.alias("newest"))
        .select("repo", F.col("newest.version").alias("version"), F.col("newest.body").alias("body"))
    )


def usable_catalogues(catalogues: DataFrame) -> DataFrame:
    """Catalogues that parse and hold a tree; others must not replace a state."""
    tree = F.expr("try_variant_get(try_parse_json(body), '$.tree', 'variant')")
    return catalogues.filter(tree.isNotNull())


def stream_catalogue(catalogues: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Stream of (repo, version, body) -> log of usable versions below `log`."""
    run = uuid.uuid4().hex

    def append(batch: DataFrame, batch_id: int) -> None:
        # Within a run the same batch lands in the same folder.  Another run, which numbers from
        # the start if the checkpoint is lost, never writes over it; a version that is there
        # twice counts once.
        latest_versions(batch).write.mode("overwrite").parquet(f"{log}/{run}-{batch_id}")

    return (
        usable_catalogues(catalogues)
        .select("repo", "version", "body")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _newer(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The newest row of a repo, if it is newer than all that were seen; only its version is kept."""
    newest = state.get[0] if state.exists else None
    found = None
    for batch in batches:
        own = batch.loc[[batch["version"].idxmax()]]
        version = int(own["version"].iloc[0])
        if newest is None or version > newest:
            newest, found = version, own
    if found is not None:
        state.update((newest,))
        yield found[["repo", "version", "body"]]


def newer_versions(catalogues: DataFrame) -> DataFrame:
    """Stream of (repo, version, body) -> usable rows that are newer than all before of their repo.

    The state holds a version per repo, no documents.  Of one micro-batch the newest row of a repo
    goes on; replays, late and older versions are dropped on the way in.
    """
    rows = usable_catalogues(catalogues).select("repo", F.col("version").cast("long").alias("version"), "body")
    return (
        rows.filter("version IS NOT NULL")
        .groupBy("repo")
        .applyInPandasWithState(_newer, rows.schema, "version long", "append", "NoTimeout")
    )


def stream_newest(catalogues: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """`stream_catalogue` with keyed state: the log gets each repo's rising versions only.

    It holds no replays, so it needs no compaction to stay in proportion to what changed.  If the
    checkpoint is lost the state starts anew; what is then logged again doesn't alter
    `current_catalogues`.
    """
    ship(catalogues.sparkSession)
    run = uuid.uuid4().hex

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/{run}-{batch_id}")

    return (
        newer_versions(catalogues)
        .writeStream.outputMode("append")
        .foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(log)


def current_catalogues(spark: SparkSession, log: str) -> DataFrame:
    """The state of the log: the newest usable version of each catalogue."""
    return latest_versions(_read_log(spark, log))


def compact_log(spark: SparkSession, log: str) -> None:
    """Replaces what the log holds by its current state.

    The state is written first, then the folders it was read from are deleted, so a reader finds
    every newest version at any time.  Folders that a stream adds meanwhile stay.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(log)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in system.listStatus(path) if s.isDirectory()]
    rows = spark.read.parquet(*[p.toString() for p in old])
    latest_versions(rows).write.parquet(f"{log}/{uuid.uuid4().hex}-state")
    for folder in old:
        system.delete(folder, True)


def _append_to(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_marks(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Stream of files -> marked lines."""
    return _append_to(marks.extract_marks(files), target, checkpoint)


def stream_tags(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Stream of files -> tags and purposes."""
    return _append_to(tagged_files(files), target, checkpoint)
