"""Marked comments: whole-line comments that carry the marker and a [mode].

Text is handled as a whole: one pass of a constant pattern per file, behind a
cheap substring test, so files without the marker cost next to nothing.  Only
`extract_marks` multiplies rows, and it filters lines as they are produced.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import rules
from ..functions.text import BLANKS, INLINE_BLANKS, char_class, quoted

_INLINE = char_class(INLINE_BLANKS)
_ANY_BLANK = char_class(BLANKS)
_OPENER = "(?://|#|--|/\\*|<!--)"
_MODE = "\\w[\\w-]*"


def _line_pattern(mode_pattern: str, marker: str) -> str:
    """A marked comment line up to, not including, its line feed.

    After the mode come blanks, ordinary characters, and then only blanks around
    at most one closing token; possessive, so long lines never backtrack.
    """
    return (
        f"[ \\t]*{_OPENER}{_INLINE}*{quoted(marker)}{_INLINE}*\\[{mode_pattern}\\]"
        f"{_INLINE}*+[^\\n\\r\\x{{2028}}\\x{{2029}}]*+"
        f"(?:{_INLINE}*+(?:\\*/|-->))?+{_INLINE}*+(?=\\n|\\z)"
    )


def _fed_line(mode: str | None, marker: str) -> str:
    """A marked line with the line feed before it."""
    return "\\n" + _line_pattern(_MODE if mode is None else quoted(mode), marker)


def _fed(content) -> Column:
    """The text with a line feed in front, so that every line has one."""
    return F.concat(F.lit("\n"), content)


def _detect_pattern(marker: str) -> str:
    modes = "|".join(quoted(m) for m in fv.MODES)
    return f"{quoted(marker)}{_ANY_BLANK}*\\[({modes})\\]"


def has_marks_expr(content, marker: str = fv.MARKER) -> Column:
    return (
        F.contains(content, F.lit(marker))
        & F.rlike(content, F.lit(_detect_pattern(marker)))
        & F.rlike(_fed(content), F.lit(_fed_line(None, marker)))
    )


def count_marks_expr(content, mode: str | None = None, marker: str = fv.MARKER) -> Column:
    found = F.regexp_count(_fed(content), F.lit(_fed_line(mode, marker)))
    return F.when(F.contains(content, F.lit(marker)), found).otherwise(0).cast("bigint")


def strip_marks_expr(content, mode: str | None = None, marker: str = fv.MARKER) -> Column:
    """The text without its marked lines; every other byte stays."""
    left = F.regexp_replace(_fed(content), _fed_line(mode, marker), "")
    return F.when(
        F.contains(content, F.lit(marker)), F.substr(left, F.lit(2))
    ).otherwise(content)


def detect_modes_expr(content, marker: str = fv.MARKER) -> Column:
    """Valid modes anywhere in the text, first seen first."""
    found = F.array_distinct(
        F.regexp_extract_all(content, F.lit(_detect_pattern(marker)), F.lit(1))
    )
    return F.when(F.contains(content, F.lit(marker)), found).otherwise(
        F.array().cast("array<string>")
    )


def _drop_closer(tail) -> Column:
    """Comment text without trailing blanks and without one closing token."""
    text = F.rtrim(tail, F.lit(INLINE_BLANKS))
    out = text
    for closer in fv.COMMENT_CLOSERS:
        out = F.when(
            F.endswith(text, F.lit(closer)),
            F.rtrim(F.left(text, F.length(text) - len(closer)), F.lit(INLINE_BLANKS)),
        ).otherwise(out)
    return out


def extract_marks(files: DataFrame, marker: str = fv.MARKER) -> DataFrame:
    """One row per marked line: line number, indent, syntax, mode and body."""
    others = [c for c in files.columns if c != "content"]
    line = F.col("line")
    parts = (
        f"^([ \\t]*)({_OPENER}){_INLINE}*{quoted(marker)}{_INLINE}*"
        f"\\[({_MODE})\\]{_INLINE}*([^\\n]*)"
    )
    return (
        files.filter(F.contains("content", F.lit(marker)))
        .select(*others, F.posexplode(F.split("content", "\n")).alias("pos", "line"))
        .filter(F.contains(line, F.lit(marker)))
        .filter(F.rlike(line, F.lit("\\A" + _line_pattern(_MODE, marker))))
        .select(
            *others,
            (F.col("pos") + 1).alias("line_no"),
            F.regexp_extract(line, parts, 1).alias("indent"),
            F.regexp_extract(line, parts, 2).alias("syntax"),
            F.regexp_extract(line, parts, 3).alias("mode"),
            _drop_closer(F.regexp_extract(line, parts, 4)).alias("body"),
        )
    )


def detect_modes(files: DataFrame, marker: str = fv.MARKER) -> DataFrame:
    return files.withColumn("modes", detect_modes_expr(F.col("content"), marker)).drop("content")


def count_marks(files: DataFrame, mode: str | None = None, marker: str = fv.MARKER) -> DataFrame:
    return files.withColumn(
        "mark_count", count_marks_expr(F.col("content"), mode, marker)
    ).drop("content")


def strip_marks(files: DataFrame, marker: str = fv.MARKER) -> DataFrame:
    """Adds `stripped` and the number of lines removed."""
    content = F.col("content")
    return files.select(
        "*",
        strip_marks_expr(content, None, marker).alias("stripped"),
        count_marks_expr(content, None, marker).alias("removed"),
    ).drop("content")


def strip_marks_by_mode(files: DataFrame, mode: str, marker: str = fv.MARKER) -> DataFrame:
    content = F.col("content")
    return files.select(
        "*",
        strip_marks_expr(content, mode, marker).alias("stripped"),
        count_marks_expr(content, mode, marker).alias("removed"),
    ).drop("content")


def apply_strategy(
    files: DataFrame, strategy: str = "replace", marker: str = fv.MARKER
) -> DataFrame:
    """'replace' takes existing marks out before new annotation, 'merge' keeps them."""
    if strategy not in ("replace", "merge"):
        raise ValueError(f"unknown strategy {strategy!r}: use 'replace' or 'merge'")
    if strategy == "merge":
        return files
    content = F.col("content")
    return files.withColumn(
        "content",
        F.when(has_marks_expr(content, marker), strip_marks_expr(content, None, marker))
        .otherwise(content),
    )


def erase_report(
    files: DataFrame, extra_excludes: Iterable[str] = (), marker: str = fv.MARKER
) -> DataFrame:
    """Per repo: files that would be cleaned and marked lines removed.

    Looks at the same paths as annotation does, whatever the size of the files.
    """
    content = F.col("content")
    return (
        files.filter(rules.annotatable_path(list(extra_excludes)))
        .filter(has_marks_expr(content, marker))
        .select("repo", count_marks_expr(content, None, marker).alias("removed"))
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("files_cleaned"),
            F.sum("removed").alias("marks_removed"),
        )
    )


def clean_response_expr(body) -> Column:
    """Model output without one leading and one trailing code fence."""
    opened = F.regexp_replace(body, "\\A```\\w*\\n?", "")
    return F.regexp_replace(opened, f"\\n?```{_ANY_BLANK}*\\z", "")


def clean_responses(responses: DataFrame) -> DataFrame:
    return responses.withColumn("body", clean_response_expr(F.col("body")))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Number of files per outcome; outcomes(repo, path, status, reason)."""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("status") == "failed").select("repo", "path", "reason")
