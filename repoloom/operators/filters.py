"""Row filters over file and node tables."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths, rules
from ..functions.evaluation import evaluated_once
from ..functions.sqltext import text_list
from .marks import has_marks_expr


def parse_name_list(text: str | None) -> list[str]:
    """'logs, tmp,data' -> ['logs', 'tmp', 'data']."""
    return [n.strip() for n in (text or "").split(",") if n.strip()]


def exclude_paths(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Drop files with an excluded or hidden segment anywhere below the root."""
    names = fv.EXCLUDED_NAMES + list(extra)
    return files.filter(~rules.excluded("path", names, fv.KEPT_DOT_NAMES))


def scannable_expr() -> Column:
    """Decided on the path alone, before any content is touched."""
    return F.expr(
        f"{rules.PATH_EXTENSION} NOT IN ({text_list(fv.BINARY_EXTENSIONS)})"
        f" AND ({rules.PATH_EXTENSION} IN ({text_list(fv.SCANNABLE_EXTENSIONS)})"
        f" OR {rules.PATH_NAME} IN ({text_list(fv.FILE_DESCRIPTIONS)}))"
    )


def scannable(files: DataFrame) -> DataFrame:
    """Files whose header is worth reading."""
    return files.filter(scannable_expr())


def annotatable(files: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Source files of a size that can be annotated as a whole."""
    return files.filter(rules.annotatable_path(extra)).filter(
        f"octet_length(content) > {fv.ANNOTATABLE_MIN_BYTES}"
        f" AND octet_length(content) < {fv.ANNOTATABLE_MAX_BYTES}"
    )


def prune_empty_dirs(nodes: DataFrame) -> DataFrame:
    """Keep directories that have a file somewhere below, every file, and roots."""
    occupied = (
        nodes.filter("kind = 'file' AND parent_path IS NOT NULL")
        .select("repo", "parent_path")
        .distinct()
        .select("repo", F.explode(paths.prefixes("parent_path")).alias("path"))
        .distinct()
    )
    dirs = nodes.filter("kind = 'dir' AND depth > 0")
    rest = nodes.filter("kind = 'file' OR depth = 0")
    kept = dirs.join(occupied, ["repo", "path"], "left_semi").select(*nodes.columns)
    return rest.unionByName(kept)


def files_with_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """Name, purpose and path of the files that carry the tag."""
    files = evaluated_once(
        nodes.filter("kind = 'file'").select("repo", "name", "description", "path", "tags"),
        "tags",
    )
    return files.filter(F.array_contains("tags", tag)).select(
        "repo", "name", F.col("description").alias("purpose"), "path"
    )


def has_marks(files: DataFrame) -> DataFrame:
    """Files with a valid mode mark and at least one marked comment line."""
    return files.filter(has_marks_expr(F.col("content")))
