"""The README that gives a repo its context."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths, rules
from ..functions.sqltext import text_array


def readme_context(files: DataFrame, chars: int = fv.README_CONTEXT_CHARS) -> DataFrame:
    """(repo, readme) for every repo: head of its best root README, '' without one.

    Only root READMEs, cut to the wanted head, reach the shuffle.
    """
    name = "substring_index(path, '/', -1)"
    tie = F.col("doc_id" if "doc_id" in files.columns else "path")
    preference = F.expr(f"array_position({text_array(fv.README_NAMES)}, {name})")
    best = (
        files.filter(paths.depth() == 1)
        .filter(rules.is_one_of(name, fv.README_NAMES))
        .select(
            "repo",
            F.struct(preference.alias("preference"), tie.alias("tie")).alias("rank"),
            F.substring("content", 1, chars).alias("head"),
        )
        .groupBy("repo")
        .agg(F.min_by("head", "rank").alias("head"))
    )
    return (
        files.select("repo").distinct().join(best, "repo", "left")
        .select("repo", F.coalesce("head", F.lit("")).alias("readme"))
    )
