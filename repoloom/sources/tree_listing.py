"""Text of a directory tree drawn with box characters, as node tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evaluation import evaluated_once
from ..functions.text import BLANKS, char_class, strip
from .path_list import listed_nodes

_BOX = "├└│─"
_BLANK = char_class(BLANKS)
_ITEM = f"^([^├└]*?)[├└]{_BLANK}*─+{_BLANK}*(.+)$"


def is_tree_listing(text):
    """True when a text is a drawn tree rather than a path list."""
    return F.rlike(text, F.lit(f"[{_BOX}]"))


def _items(text: Column) -> Column:
    """Items of a listing in order: name, indentation depth (-1 for the root), drawn_dir."""
    lines = F.filter(
        F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"),
        lambda l: (strip(l) != "") & ~F.rlike(strip(l), F.lit("^\\d+ director")),
    )

    def item(line: Column, at: Column) -> Column:
        first = at == 0
        prefix = F.regexp_extract(line, _ITEM, 1)
        label = strip(F.regexp_extract(line, _ITEM, 2))
        marks = F.length(F.regexp_replace(prefix, f"(?:(?!{_BLANK}|│).)", ""))
        by_marks = F.floor(marks / 3 + F.lit(0.5))
        indent = F.when(by_marks > 0, by_marks).otherwise(
            F.floor(F.length(prefix) / 4 + F.lit(0.5))
        )
        root = F.regexp_replace(F.regexp_replace(line, f"{_BLANK}|[{_BOX}]", ""), "/$", "")
        return F.struct(
            F.when(first, F.coalesce(F.nullif(root, F.lit("")), F.lit("project")))
            .otherwise(F.regexp_replace(label, "/$", ""))
            .alias("name"),
            F.when(first, F.lit(-1)).otherwise(indent).cast("int").alias("indent"),
            (first | F.endswith(label, F.lit("/"))).alias("drawn_dir"),
            (first | F.rlike(line, F.lit(_ITEM))).alias("is_item"),
        )

    return F.filter(F.transform(lines, item), lambda x: x["is_item"])


_OPEN = "array<struct<indent:int,name:string>>"


def _paths(items: Column) -> Column:
    """Path of each item: the items still open above it, and its own name.

    A fold over the items with a stack; an item closes all that stand as deep or deeper.  A fold
    copies what it has gathered at each step, so it goes in stretches of the square root of
    the number of items: each gathers its own paths, and hands on the stack.
    """

    def step(state: Column, item: Column) -> Column:
        above = F.filter(state["open"], lambda s: s["indent"] < item["indent"])
        own = F.struct(item["indent"].alias("indent"), item["name"].alias("name"))
        names = F.concat(F.transform(above, lambda s: s["name"]), F.array(item["name"]))
        return F.struct(
            F.concat(above, F.array(own)).cast(_OPEN).alias("open"),
            F.concat(state["paths"], F.array(F.array_join(names, "/"))).alias("paths"),
        )

    def stretch(state: Column, own: Column) -> Column:
        start = F.struct(state["open"].alias("open"), F.array().cast("array<string>").alias("paths"))
        done = F.aggregate(own, start, step)
        return F.struct(
            done["open"].cast(_OPEN).alias("open"), F.concat(state["paths"], F.array(done["paths"])).alias("paths")
        )

    size = F.size(items)
    width = F.greatest(F.ceil(F.sqrt(size)), F.lit(1)).cast("int")
    last = F.greatest(F.ceil(size / width), F.lit(1)).cast("int") - 1
    stretches = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * width + 1, width))
    start = F.struct(
        F.array().cast(_OPEN).alias("open"), F.array().cast("array<array<string>>").alias("paths")
    )
    return F.flatten(F.aggregate(stretches, start, stretch)["paths"])


def import_tree_listing(df: DataFrame, listing_id: str = "listing_id", text: str = "text") -> DataFrame:
    """df(listing_id, text) -> nodes with `repo` = listing id.

    A listing is one cell of the input and is folded in its own row, whatever its depth:
    no shuffle before the nodes are described, and a plan that doesn't depend on the data.
    """
    parsed = evaluated_once(
        df.select(
            F.col(listing_id).cast("string").alias("repo"), _items(F.col(text)).alias("items")
        ),
        "items",
    )
    deeper = F.transform(
        "items",
        lambda x, i: x["drawn_dir"]
        | F.coalesce(F.get("items", i + 1)["indent"] > x["indent"], F.lit(False)),
    )
    placed = parsed.select(
        "repo", F.explode(F.arrays_zip(_paths(F.col("items")).alias("path"), deeper.alias("is_dir"))).alias("n")
    )
    nodes = placed.select(
        "repo", F.col("n.path").alias("path"), F.when(F.col("n.is_dir"), "dir").otherwise("file").alias("kind")
    )
    return listed_nodes(nodes, ["repo"])
