"""Hierarchy operators on nodes(repo, path, parent_path, name, kind, depth, ...).

Roll-ups explode each node to its ancestors and aggregate: one shuffle whose
map side already combines, whatever the depth or the size of one directory.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths
from .ranking import first_ranks, ranked


def distinct_directories(files: DataFrame) -> DataFrame:
    """(repo, path) of every directory above rows that have `parent_path`."""
    return (
        files.filter(F.col("parent_path").isNotNull())
        .select("repo", "parent_path")
        .distinct()
        .select("repo", F.explode(paths.prefixes("parent_path")).alias("path"))
        .distinct()
    )


def all_paths(nodes: DataFrame) -> DataFrame:
    """Every directory and file path, the roots included, each once."""
    return nodes.select("repo", "path", "kind").distinct()


def walk(nodes: DataFrame) -> DataFrame:
    """`all_paths` with `walk_rank`, the place of each path in a walk of its repo: a
    directory, its files, then its child directories."""
    keyed = all_paths(nodes).withColumn("_walk", paths.walk_key())
    return ranked(keyed, ["repo"], [F.col("_walk")], "walk_rank").drop("_walk")


def flatten_items(nodes: DataFrame) -> DataFrame:
    """The search relation: everything but the roots."""
    return nodes.filter(F.col("depth") > 0).select(
        "repo",
        "name",
        "description",
        "tags",
        "path",
        "parent_path",
        F.when(F.col("kind") == "dir", "folder").otherwise("file").alias("type"),
    )


def node_at(nodes: DataFrame, path: str, repo: str | None = None) -> DataFrame:
    """The directory with this path; no rows when there is none."""
    found = nodes.filter((F.col("path") == path) & (F.col("kind") == "dir"))
    return found if repo is None else found.filter(F.col("repo") == repo)


def subtree_counts(nodes: DataFrame) -> DataFrame:
    """Files and directories strictly below each directory; empty ones show 0."""
    is_dir, is_self = F.col("kind") == "dir", F.col("level") == F.col("depth")
    return (
        nodes.select(
            "repo", "kind", "depth", F.posexplode(paths.prefixes()).alias("level", "path")
        )
        # A directory also reports itself, with nothing, so none gets lost.
        .filter(is_dir | ~is_self)
        .groupBy("repo", "path")
        .agg(
            F.count(F.when(~is_dir, 1)).alias("files"),
            F.count(F.when(is_dir & ~is_self, 1)).alias("dirs"),
        )
    )


def subtree_weight(nodes: DataFrame) -> DataFrame:
    """Weight of each directory: files below it plus empty directories in it.

    One pass over the nodes gives every directory its files and whether it has
    children; a second, over directories only, adds the empty ones.
    """
    is_file = F.col("kind") == "file"
    above = F.col("depth") - F.col("level")
    directories = (
        nodes.select(
            "repo", "kind", "depth", F.posexplode(paths.prefixes()).alias("level", "path")
        )
        .filter((is_file & (above > 0)) | (~is_file & (above <= 1)))
        .groupBy("repo", "path")
        .agg(
            F.count(F.when(is_file, 1)).alias("files"),
            F.bool_or(above == 1).alias("has_children"),
        )
    )
    own = F.array(F.struct("path", F.col("files").alias("units")))
    one_each = F.transform(
        paths.prefixes(),
        lambda p: F.struct(p.alias("path"), F.lit(1).cast("bigint").alias("units")),
    )
    return (
        directories.select(
            "repo",
            F.inline(F.when(F.col("has_children"), own).otherwise(F.concat(own, one_each))),
        )
        .groupBy("repo", "path")
        .agg(F.sum("units").alias("weight"))
    )


def area_share(nodes: DataFrame, total_area: float = 1.0) -> DataFrame:
    """Share of each child in its directory's area.

    A directory's weight is the sum of its children's, so the only work beyond
    `subtree_weight` is one join by directory, which AQE splits where one
    directory holds very many children.
    """
    weights = subtree_weight(nodes)
    dirs = weights.select(
        "repo", paths.parent_path().alias("parent_path"), "path",
        F.lit("dir").alias("kind"), F.col("weight").alias("value"),
    )
    files = nodes.filter(F.col("kind") == "file").select(
        "repo", "parent_path", "path", "kind", F.lit(1).cast("bigint").alias("value")
    )
    items = dirs.unionByName(files).filter(F.col("parent_path").isNotNull())
    totals = weights.select("repo", F.col("path").alias("parent_path"), F.col("weight").alias("total"))
    return items.join(totals, ["repo", "parent_path"]).select(
        "repo", "parent_path", "path", "kind", "value",
        (F.col("value") / F.col("total") * F.lit(total_area)).alias("area"),
    )


def _listing_kind() -> Column:
    return F.when(F.col("kind") == "dir", 0).otherwise(1)


def directory_listing(nodes: DataFrame, parent: str, repo: str | None = None) -> DataFrame:
    """Children of one directory: directories first, names ignoring case."""
    children = nodes.filter(F.col("parent_path") == parent)
    if repo is not None:
        children = children.filter(F.col("repo") == repo)
    return children.orderBy(_listing_kind(), F.lower("name"), "name")


def listing_ranks(nodes: DataFrame) -> DataFrame:
    """`directory_listing` of every directory at once, with the position."""
    children = nodes.filter(F.col("parent_path").isNotNull()).select(
        "repo", "parent_path", "name", "kind", "path"
    )
    order = [_listing_kind(), F.lower("name"), F.col("name")]
    return ranked(children, ["repo", "parent_path"], order, "listing_rank")


def child_preview(
    nodes: DataFrame, dirs: int = fv.PREVIEW_DIRS, files: int = fv.PREVIEW_FILES
) -> DataFrame:
    """First child directories and files of each directory.

    The rank limit is applied before the shuffle as well, so at most that many
    rows per directory and task travel.
    """
    children = nodes.filter(F.col("parent_path").isNotNull()).select(
        "repo", "parent_path", "kind", "name"
    )
    order = [F.lower("name"), F.col("name")]
    first = first_ranks(
        children, ["repo", "parent_path", "kind"], order, max(dirs, files), "rank"
    ).filter(F.col("rank") <= F.when(F.col("kind") == "dir", dirs).otherwise(files))

    def names(kind: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("rank", "name"))
        return F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["name"])

    return (
        first.groupBy("repo", F.col("parent_path").alias("path"))
        .agg(names("dir").alias("first_dirs"), names("file").alias("first_files"))
    )


def tag_preview(nodes: DataFrame, n: int = fv.PREVIEW_TAGS) -> DataFrame:
    return nodes.filter(F.col("kind") == "file").withColumn("first_tags", F.slice("tags", 1, n))
