"""Path lists, one path per line, as node tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths, rules
from ..functions.sqltext import text_array
from ..functions.text import BLANKS, strip

_FILE_NAME = "\\.\\w{1,10}$"


def listed_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, kind) -> node columns, described by the listing tables."""
    is_file = F.col("kind") == "file"
    placed = nodes.select(
        *keys,
        "path",
        paths.parent_path().alias("parent_path"),
        paths.file_name().alias("name"),
        "kind",
        paths.depth().alias("depth"),
    )
    return placed.select(
        "*",
        F.when(
            is_file,
            rules.file_description(
                "name", fv.LISTING_FILE_DESCRIPTIONS, fv.LISTING_FILE_PATTERNS
            ),
        )
        .otherwise(
            rules.directory_description("name", "depth", fv.LISTING_DIRECTORY_DESCRIPTIONS)
        )
        .alias("description"),
        F.lit("heuristic").alias("description_source"),
        F.when(is_file, rules.name_tags("name"))
        .otherwise(F.expr(text_array([])))
        .alias("tags"),
        F.lit(None).cast("string").alias("snippet"),
    )


def cleaned_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Trimmed paths without a leading './', blank lines and '#' comments."""
    cleaned = F.regexp_replace(strip(F.col(path), BLANKS), "^\\./", "")
    return df.withColumn(path, cleaned).filter(
        (F.col(path) != "") & ~F.startswith(F.col(path), F.lit("#"))
    )


def import_path_list(df: DataFrame, order: str, list_id: str | None = None) -> DataFrame:
    """df([list_id,] order, path) -> nodes with `repo` = list id (or the root name).

    The first path of a list names its root; paths with another first segment
    hang under it.  A last segment with an extension is a file, everything else
    a directory.
    """
    lines = cleaned_paths(df)
    raw = F.split("path", "/")
    lines = lines.select(
        *([F.col(list_id).cast("string").alias("repo")] if list_id else []),
        F.col(order).alias("ord"),
        raw.getItem(0).alias("first"),
        # A trailing '/' makes even 'a.txt/' a directory.
        (F.rlike(F.element_at(raw, -1), F.lit(_FILE_NAME))).alias("is_file"),
        F.filter(raw, lambda s: s != "").alias("parts"),
    )
    first = F.coalesce(F.nullif(F.min_by("first", "ord"), F.lit("")), F.lit("project"))
    if list_id:
        lines = lines.join(lines.groupBy("repo").agg(first.alias("root")), "repo")
    else:
        # One short text for the whole list, found when the nodes are.
        root = lines.agg(first.alias("root")).scalar()
        lines = lines.withColumn("root", root).withColumn("repo", F.col("root"))
    own_root = F.coalesce(F.get("parts", F.lit(0)) == F.col("root"), F.lit(False))
    parts = F.when(own_root, F.col("parts")).otherwise(
        F.concat(F.array("root"), F.col("parts"))
    )
    # Exploded before the only shuffle: the map side already drops repeats, so
    # what travels is each file once and few copies of each directory.
    nodes = (
        lines.select("repo", "is_file", F.array_join(parts, "/").alias("path"))
        .select(
            "repo",
            "is_file",
            paths.depth().alias("last"),
            F.posexplode(paths.prefixes()).alias("level", "path"),
        )
        .select(
            "repo",
            "path",
            # The root itself is a directory even when its name has a suffix.
            F.when(
                F.col("is_file") & (F.col("level") == F.col("last")) & (F.col("level") > 0), "file"
            )
            .otherwise("dir")
            .alias("kind"),
        )
        .distinct()
    )
    return listed_nodes(nodes, ["repo"])
