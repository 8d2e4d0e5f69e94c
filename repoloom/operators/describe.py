"""Descriptions, tags and other per-row facts of files and directories."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths, rules, text
from .filters import scannable_expr


def describe_files(files: DataFrame, listing: bool = False) -> DataFrame:
    """Adds `name` and `purpose`; purpose is NULL when no rule knows the name."""
    exact = fv.LISTING_FILE_DESCRIPTIONS if listing else fv.FILE_DESCRIPTIONS
    patterns = fv.LISTING_FILE_PATTERNS if listing else fv.FILE_PATTERNS
    return files.withColumn("name", paths.file_name()).withColumn(
        "purpose", rules.file_description("name", exact, patterns)
    )


def describe_dirs(dirs: DataFrame, listing: bool = False) -> DataFrame:
    """Adds `name`, `depth` and `description` to directories given by path."""
    table = fv.LISTING_DIRECTORY_DESCRIPTIONS if listing else fv.DIRECTORY_DESCRIPTIONS
    return dirs.select(
        "*", paths.file_name().alias("name"), paths.depth().alias("depth")
    ).withColumn("description", rules.directory_description("name", "depth", table))


def name_tags(files: DataFrame) -> DataFrame:
    return files.withColumn("name", paths.file_name()).withColumn(
        "name_tags", rules.name_tags("name")
    )


def header_snippet(files: DataFrame) -> DataFrame:
    """Adds `snippet`: the stripped head of scannable files, else NULL."""
    head = F.when(scannable_expr(), text.header("content", fv.HEADER_CHARS, fv.HEADER_LINES))
    # In two projections: the test for emptiness must not repeat the work.
    return files.withColumn("snippet", head).withColumn("snippet", F.expr("nullif(snippet, '')"))


def import_tags(files: DataFrame, table: Mapping = fv.IMPORT_TAG_RULES) -> DataFrame:
    """Adds `import_tags` found in `snippet`."""
    return (
        files.withColumn("_import_pieces", rules.import_pieces("snippet", table))
        .withColumn("import_tags", rules.import_tags("_import_pieces", table))
        .drop("_import_pieces")
    )


def merge_tags(files: DataFrame) -> DataFrame:
    """`tags`: name tags first, then import tags not yet seen."""
    return files.withColumn("tags", F.array_union("name_tags", "import_tags"))


def language_of(files: DataFrame) -> DataFrame:
    return (
        files.withColumn("_ext", paths.extension("substring_index(path, '/', -1)"))
        .withColumn("language", rules.language("_ext"))
        .drop("_ext")
    )


def snippet_preview(files: DataFrame, n: int = fv.PROMPT_SNIPPET_LINES) -> DataFrame:
    return files.withColumn("preview", text.first_lines("snippet", n))


def absolute_path_expr(base: str | None) -> Column:
    if not base:
        return F.lit(None).cast("string")
    return F.concat(F.lit(base.removesuffix("/") + "/"), paths.below_root())


def absolute_path(files: DataFrame, base: str | None) -> DataFrame:
    """Adds `absolute_path` and the editor link; NULL without a base path."""
    absolute = absolute_path_expr(base)
    return files.select(
        "*",
        absolute.alias("absolute_path"),
        F.concat(F.lit("vscode://file/"), absolute).alias("uri"),
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """Breadcrumbs: one row per prefix of every path, root at level 0."""
    return nodes.select("*", F.posexplode(paths.prefixes()).alias("level", "ancestor"))


def primary_tag(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("primary_tag", rules.primary_tag("tags"))
