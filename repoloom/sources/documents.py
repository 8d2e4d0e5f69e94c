"""Catalogue documents as one nested JSON text per repo, written from node tables and read back.

A walk of a tree meets its nodes in the order in which a nested document holds them: a
directory, its files, its child directories.  So each node's stretch of the text follows from the node
and the one after it: what lies between the two is a comma, the start of a list, or
the ends of all directories that are left.  Stretches are made where the rows are, however
deep the tree, and a document is their text in walk order.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths
from ..operators.ranking import ranked
from ..operators.rounds import Rounds


def _text(value: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _opened(struct: Column) -> Column:
    """A struct as a JSON object without its end."""
    text = F.to_json(struct)
    return F.left(text, F.length(text) - 1)


def _stretch() -> Column:
    """A node's own text, and what leads from it to the next node of its tree (null: none)."""
    is_file = F.col("kind") == "file"
    own = F.when(
        is_file,
        F.to_json(F.struct("name", F.coalesce("description", F.lit(fv.UNKNOWN_PURPOSE)).alias("purpose"), "tags")),
    ).otherwise(_opened(F.struct("name", "description")))
    # The innermost open directory, and how much of what is open the next node leaves open.
    innermost = F.col("depth") - is_file.cast("int")
    kept = F.coalesce(F.col("next_depth"), F.lit(0))
    ends = F.concat(
        F.when(is_file, "]").otherwise(""), F.lit("}"), F.repeat(F.lit("]}"), (innermost - kept).cast("int"))
    )
    between = (
        F.when(F.col("next_depth").isNull(), ends)
        .when(is_file & (F.col("next_kind") == "file"), ",")
        .when(F.col("next_kind") == "file", ',"files":[')
        .when(is_file & (F.col("next_depth") == F.col("depth")), '],"children":[')
        .when(F.col("next_depth") > F.col("depth"), ',"children":[')
        .otherwise(F.concat(ends, F.lit(",")))
    )
    return F.concat(own, between)


def document_lines(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, root, part, number, line): lines that in order make a document of each tree.

    nodes with repo, path, name, kind, depth, description, tags and snippet, directories above
    each node included; manifest(repo, ...) is what stands beside the tree.  A repo whose
    paths have several roots gives a document for each.  Files of one path are listed one
    by one; their snippet is the largest, for a key of the snippets part stands once.  Unknown
    purposes leave as the dash, and snippets apart from the tree.
    """
    root = F.substring_index("path", "/", 1).alias("root")
    rounds = Rounds(nodes.sparkSession, "documents")
    kept = rounds.store(
        nodes.select("repo", root, "path", "name", "kind", "depth", "description", "tags", paths.walk_key().alias("_walk"))
    )
    # Equal rows may take each other's places.
    order = ["_walk", "description", "tags"]
    walked = rounds.store(ranked(kept, ["repo", "root"], [F.col(c) for c in order], "number").drop("_walk"), kept)
    following = walked.select(
        "repo", "root", (F.col("number") - 1).alias("number"), F.col("kind").alias("next_kind"), F.col("depth").alias("next_depth")
    )
    tree = walked.join(following, ["repo", "root", "number"], "left").select(
        "repo", "root", F.lit(1).alias("part"), "number", _stretch().alias("line")
    )
    own = nodes.filter(F.col("snippet").isNotNull()).groupBy("repo", root, "path").agg(F.max("snippet").alias("snippet"))
    numbered = ranked(own, ["repo", "root"], [F.col("path")], "number")
    before = F.when(F.col("number") == 1, ',"snippets":{').otherwise(",")
    snippets = numbered.select(
        "repo", "root", F.lit(2).alias("part"), "number",
        F.concat(before, _text(F.col("path")), F.lit(":"), _text(F.col("snippet"))).alias("line"),
    )
    zero = F.lit(0).cast("bigint")
    trees = walked.filter("number = 1").select("repo", "root")
    beside = F.struct(*[c for c in manifest.columns if c != "repo"])
    heads = trees.join(manifest, "repo", "left").select(
        "repo", "root", F.lit(0).alias("part"), zero.alias("number"),
        F.concat(
            _opened(beside), F.when(_opened(beside) == "{", "").otherwise(","), F.lit('"tree":')
        ).alias("line"),
    )
    shown = snippets.filter("number = 1").select("repo", "root", F.lit("}}").alias("line"))
    tails = trees.join(shown, ["repo", "root"], "left").select(
        "repo", "root", F.lit(3).alias("part"), zero.alias("number"), F.coalesce("line", F.lit("}")).alias("line")
    )
    return heads.unionByName(tree).unionByName(snippets).unionByName(tails)


def documents(lines: DataFrame) -> DataFrame:
    """(repo, body) of `document_lines`: each document as one value, for those that fit one."""
    entry = F.struct("part", "number", "line")
    gathered = lines.groupBy("repo", "root").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda e: e["line"]), "\n")
    return gathered.select("repo", body.alias("body"))


def write_documents(lines: DataFrame, target: str) -> None:
    """A folder per repo and root with the document as one text file.

    Lines of a document are sorted, spilling if need be, and written one after the other: no
    document is ever held as a whole.
    """
    # Folder columns that can't be null, or the writer would sort once more, by them alone.
    rows = lines.withColumns({c: F.coalesce(c, F.lit("")) for c in ("repo", "root")})
    ordered = rows.repartition("repo", "root").sortWithinPartitions("repo", "root", "part", "number")
    ordered.select("repo", "root", "line").write.mode("overwrite").partitionBy("repo", "root").text(target)


def read_documents(spark: SparkSession, target: str) -> DataFrame:
    """(repo, body) of what `write_documents` wrote."""
    files = spark.read.schema("value string, repo string, root string").text(target, wholetext=True)
    return files.select("repo", F.col("value").alias("body"))
