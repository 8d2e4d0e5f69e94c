"""From a file corpus to the node table."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.sqltext import text_array
from ..operators import describe, filters, tree


def tagged_files(
    files: DataFrame, extra_excludes: Iterable[str] = (), scan_headers: bool = True
) -> DataFrame:
    """Excludes, header snippets, name and import tags, purpose: one narrow stage.

    Keeps every input column except `content`.
    """
    kept = filters.exclude_paths(files, extra_excludes)
    if scan_headers:
        kept = describe.import_tags(describe.header_snippet(kept))
    else:
        kept = kept.select(
            "*",
            F.lit(None).cast("string").alias("snippet"),
            F.expr(text_array([])).alias("import_tags"),
        )
    tagged = describe.merge_tags(describe.name_tags(kept))
    return describe.describe_files(tagged).drop("content")


def file_nodes(tagged: DataFrame, extra_columns: Iterable[str] = ()) -> DataFrame:
    return tagged.select(
        *extra_columns,
        "repo",
        "path",
        paths.parent_path().alias("parent_path"),
        "name",
        F.lit("file").alias("kind"),
        paths.depth().alias("depth"),
        F.col("purpose").alias("description"),
        F.expr("IF(purpose IS NOT NULL, 'heuristic', NULL)").alias("description_source"),
        "tags",
        "snippet",
    )


def directory_nodes(files: DataFrame) -> DataFrame:
    """Every directory above rows that have `parent_path`, each once."""
    return describe.describe_dirs(tree.distinct_directories(files)).select(
        "repo",
        "path",
        paths.parent_path().alias("parent_path"),
        "name",
        F.lit("dir").alias("kind"),
        "depth",
        "description",
        F.lit("heuristic").alias("description_source"),
        F.expr(text_array([])).alias("tags"),
        F.lit(None).cast("string").alias("snippet"),
    )


def scan(
    files: DataFrame,
    extra_excludes: Iterable[str] = (),
    scan_headers: bool = True,
    extra_columns: Iterable[str] = (),
) -> DataFrame:
    """files(repo, path, content) -> nodes.  Directories hold at least one file.

    Extra columns of files are null for directories.

    Multi-branch operators read the nodes several times, so write them to a
    table once and work from that.
    """
    nodes = file_nodes(tagged_files(files, extra_excludes, scan_headers), extra_columns)
    # Directories come from paths alone, so this branch never reads contents.
    above = filters.exclude_paths(files, extra_excludes).select(
        "repo", paths.parent_path().alias("parent_path")
    )
    return nodes.unionByName(directory_nodes(above), allowMissingColumns=True)
