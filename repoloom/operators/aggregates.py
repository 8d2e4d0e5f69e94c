"""Counters over nodes; every one combines before its shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.evaluation import evaluated_once

NAME_TAGS = [tag for tag, _ in fv.NAME_TAG_PATTERNS]


def _file_tags(nodes: DataFrame) -> DataFrame:
    files = evaluated_once(nodes.filter(F.col("kind") == "file").select("tags"), "tags")
    return files.select(F.explode("tags").alias("tag"))


def distinct_tags(nodes: DataFrame) -> DataFrame:
    return _file_tags(nodes).distinct().orderBy("tag")


def tag_counts(nodes: DataFrame) -> DataFrame:
    """Number of files per tag."""
    return _file_tags(nodes).groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


def _inferred(tags):
    """How many tags of a file cannot come from its name."""
    return F.size(F.filter(tags, lambda t: ~t.isin(NAME_TAGS))).cast("bigint")


def inferred_tag_count(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter(F.col("kind") == "file")
        .groupBy("repo")
        .agg(F.sum(_inferred(F.col("tags"))).alias("inferred_tags"))
    )


def scan_summary(nodes: DataFrame) -> DataFrame:
    """Per repo: all items (root included), files with a snippet, inferred tags."""
    return nodes.groupBy("repo").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("snippet").alias("files_with_snippet"),
        F.coalesce(
            F.sum(F.when(F.col("kind") == "file", _inferred(F.col("tags")))), F.lit(0)
        ).alias("inferred_tags"),
    )
