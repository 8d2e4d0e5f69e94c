"""Path expressions.  A path is '/'-joined and starts with its root's own name.

Every function takes the name of the column that holds the path (or file name).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: str = "path") -> Column:
    return F.expr(f"substring_index({path}, '/', -1)")


def parent_path(path: str = "path") -> Column:
    """Path without its last segment; NULL for a root."""
    return F.expr(
        f"nullif(left({path}, length({path}) - length(substring_index({path}, '/', -1)) - 1), '')"
    )


def depth(path: str = "path") -> Column:
    """Number of segments below the root (root = 0)."""
    return F.expr(f"length({path}) - length(replace({path}, '/', ''))")


def extension(name: str = "name") -> Column:
    """Lower-cased suffix with its dot; '' for dot files, trailing dots and none."""
    return F.expr(rf"lower(regexp_extract({name}, '(?s)^.+(\\.[^.]+)$', 1))")


def below_root(path: str = "path") -> Column:
    """The path relative to its root; '' for the root itself."""
    return F.expr(f"regexp_replace({path}, '^[^/]*/?', '')")


def prefixes(path: str = "path") -> Column:
    """All path prefixes, root first, the path itself last."""
    return F.expr(
        f"transform(sequence(1, length({path}) - length(replace({path}, '/', '')) + 1),"
        f" k -> substring_index({path}, '/', k))"
    )


def walk_key(path: str = "path", kind: str = "kind") -> Column:
    """Text whose plain order is that of a walk: a directory, its files, then its child directories
    with all below them; names ignoring case, then by case.

    For each segment: whether it is a file or a directory, the lower-cased name and the name.
    Every part ends in NUL, which sorts before all that names can hold, and a directory's key begins
    those of everything below it.
    """
    def part(segment: Column, mark: Column) -> Column:
        return F.concat(mark, F.lower(segment), F.lit("\x00"), segment, F.lit("\x00"))

    parts = F.split(F.col(path), "/")
    above = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda s: part(s, F.lit("\x02")))
    mark = F.when(F.col(kind) == "dir", F.lit("\x02")).otherwise(F.lit("\x01"))
    return F.concat(F.array_join(above, ""), part(F.element_at(parts, -1), mark))
