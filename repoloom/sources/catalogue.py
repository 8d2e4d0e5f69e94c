"""Catalogue documents (JSON with a nested tree) from and to node tables."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.evaluation import evaluated_once
from ..operators.readme import readme_context
from ..operators.rounds import Rounds
from .corpus import by_repo

_FRAME = (
    "struct<done:boolean,path:string,parent_path:string,name:string,kind:string,"
    "description:string,tags:array<string>,subtree:variant>"
)


_ROOT = "coalesce(try_variant_get(document, '$.tree', 'variant'), document)"


def parsed_catalogues(df: DataFrame, repo: str = "repo_id", body: str = "body") -> DataFrame:
    """(repo, document) with the JSON parsed once.

    Bodies that do not parse, or hold no tree with a name, are left out.
    """
    parsed = df.select(
        F.col(repo).cast("string").alias("repo"), F.try_parse_json(F.col(body)).alias("document")
    )
    return evaluated_once(parsed, "document").filter(
        f"try_variant_get({_ROOT}, '$.name', 'string') IS NOT NULL"
    )


def import_manifest(df: DataFrame, repo: str = "repo_id", body: str = "body") -> DataFrame:
    """One row per catalogue with what stands beside the tree."""
    def text(key: str):
        return F.expr(f"try_variant_get(document, '$.{key}', 'string')").alias(key)

    return parsed_catalogues(df, repo, body).select(
        "repo",
        text("basePath"),
        text("readme"),
        text("generatedAt"),
        text("model"),
        F.expr("try_variant_get(document, '$.hasSnippets', 'boolean')").alias("hasSnippets"),
    )


def _nesting(body: Column) -> Column:
    """How deep the objects of a JSON text are nested at most."""
    # Escapes and strings first, so that only braces of the structure are left.
    plain = F.regexp_replace(body, r"(?s)\\.", "")
    braces = F.regexp_replace(F.regexp_replace(plain, '"[^"]*"', ""), "[^{}]", "")
    return F.aggregate(
        F.split(braces, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(c == "{", 1).otherwise(0)).alias("most"),
        ),
    )["most"]


def import_catalogue(df: DataFrame, repo: str = "repo_id", body: str = "body") -> DataFrame:
    """df(repo_id, body) -> nodes.  The tree may be wrapped in `tree` or bare, and of any depth.

    Every document is unfolded in its own row, without shuffles: each round turns the open
    directories into themselves, their files and their child directories, and there
    are as many rounds as the document has levels.  Entries without a name are left
    out, with all below them.
    """
    parsed = df.select(
        F.col(repo).cast("string").alias("repo"),
        F.try_parse_json(F.col(body)).alias("document"),
        _nesting(F.col(body)).alias("levels"),
    )
    parsed = evaluated_once(parsed, "document").filter(
        f"try_variant_get({_ROOT}, '$.name', 'string') IS NOT NULL"
    )

    def child(of: str, kind: str, description: str, tags: str, done: str, subtree: str) -> str:
        name = "try_variant_get(e, '$.name', 'string')"
        entries = f"coalesce(try_variant_get(node.subtree, '$.{of}', 'array<variant>'), array())"
        return f"""
        transform(filter({entries}, e -> {name} IS NOT NULL),
          e -> cast(named_struct('done', {done}, 'path', concat(node.path, '/', {name}),
            'parent_path', node.path, 'name', {name}, 'kind', '{kind}',
            'description', try_variant_get(e, '$.{description}', 'string'),
            'tags', {tags}, 'subtree', {subtree}) as {_FRAME}))"""

    no_tags = "cast(array() as array<string>)"
    file_tags = f"coalesce(try_variant_get(e, '$.tags', 'array<string>'), {no_tags})"
    nothing = "cast(null as variant)"
    root = f"""cast(named_struct('done', false, 'path', try_variant_get({_ROOT}, '$.name', 'string'),
      'parent_path', cast(null as string), 'name', try_variant_get({_ROOT}, '$.name', 'string'),
      'kind', 'dir', 'description', try_variant_get({_ROOT}, '$.description', 'string'),
      'tags', {no_tags}, 'subtree', {_ROOT}) as {_FRAME})"""
    unfolded = f"""
      aggregate(sequence(1, greatest(levels, 1)), array({root}), (nodes, level) -> flatten(
        transform(nodes, node -> CASE WHEN node.done THEN array(node) ELSE concat(
          array(cast(named_struct('done', true, 'path', node.path, 'parent_path', node.parent_path,
            'name', node.name, 'kind', node.kind, 'description', node.description,
            'tags', node.tags, 'subtree', {nothing}) as {_FRAME})),
          {child('files', 'file', 'purpose', file_tags, 'true', nothing)},
          {child('children', 'dir', 'description', no_tags, 'false', 'e')}) END)))"""
    frames = parsed.select("repo", F.explode(F.expr(unfolded)).alias("node"))
    description = F.nullif(F.col("node.description"), F.lit(fv.UNKNOWN_PURPOSE))
    return frames.select(
        "repo",
        F.col("node.path").alias("path"),
        F.col("node.parent_path").alias("parent_path"),
        F.col("node.name").alias("name"),
        F.col("node.kind").alias("kind"),
        (F.size(F.split("node.path", "/")) - 1).alias("depth"),
        description.alias("description"),
        F.when(description.isNotNull(), F.lit("imported")).alias("description_source"),
        F.col("node.tags").alias("tags"),
        F.lit(None).cast("string").alias("snippet"),
    )


def import_catalogue_by_level(df: DataFrame, repo: str = "repo_id", body: str = "body") -> DataFrame:
    """`import_catalogue` for documents that are much for one task.

    The open directories of all documents are a stored table; each round turns those of one
    level into their entries, spread over all tasks, and the child directories are the next
    round's.  So one document is unfolded by many tasks, and no row holds more than one
    directory's subtree.  There are as many rounds as the deepest tree has levels.
    """
    rounds = Rounds(df.sparkSession, "catalogue")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    no_tags = F.expr("cast(array() as array<string>)")
    text = lambda of, key: F.expr(f"try_variant_get({of}, '$.{key}', 'string')")

    def entries(opened: DataFrame, key: str) -> DataFrame:
        every = F.expr(f"try_variant_get(subtree, '$.{key}', 'array<variant>')")
        rows = opened.select("repo", F.col("path").alias("parent_path"), F.explode(every).alias("entry"))
        return rows.filter("try_variant_get(entry, '$.name', 'string') IS NOT NULL").withColumn(
            "name", text("entry", "name")
        )

    columns = ["repo", "path", "parent_path", "name", "kind", "description", "tags"]
    opened = rounds.store(
        parsed_catalogues(df, repo, body).select(
            "repo",
            F.expr(f"try_variant_get({_ROOT}, '$.name', 'string')").alias("path"),
            F.lit(None).cast("string").alias("parent_path"),
            F.expr(f"try_variant_get({_ROOT}, '$.name', 'string')").alias("name"),
            F.expr(f"try_variant_get({_ROOT}, '$.description', 'string')").alias("description"),
            F.expr(_ROOT).alias("subtree"),
        ).repartition(tasks)
    )
    levels = []
    while not opened.isEmpty():
        dirs = opened.select("repo", "path", "parent_path", "name", F.lit("dir").alias("kind"), "description", no_tags.alias("tags"))
        files = entries(opened, "files").select(
            "repo", F.concat_ws("/", "parent_path", "name").alias("path"), "parent_path", "name",
            F.lit("file").alias("kind"), text("entry", "purpose").alias("description"),
            F.coalesce(F.expr("try_variant_get(entry, '$.tags', 'array<string>')"), no_tags).alias("tags"),
        )
        levels.append(rounds.store(dirs.unionByName(files).select(*columns)))
        children = entries(opened, "children").select(
            "repo", F.concat_ws("/", "parent_path", "name").alias("path"), "parent_path", "name",
            text("entry", "description").alias("description"), F.col("entry").alias("subtree"),
        )
        opened = rounds.store(children.repartition(tasks), opened)
    rounds.drop(opened)
    if not levels:
        return import_catalogue(df.limit(0), repo, body)
    every = reduce(DataFrame.unionByName, levels)
    description = F.nullif(F.col("description"), F.lit(fv.UNKNOWN_PURPOSE))
    return every.select(
        "repo", "path", "parent_path", "name", "kind",
        (F.size(F.split("path", "/")) - 1).alias("depth"),
        description.alias("description"),
        F.when(description.isNotNull(), F.lit("imported")).alias("description_source"),
        "tags",
        F.lit(None).cast("string").alias("snippet"),
    )


def import_snippets(df: DataFrame, repo: str = "repo_id", body: str = "body") -> DataFrame:
    """(repo, path, snippet) rows of the snippets part of catalogue documents."""
    return parsed_catalogues(df, repo, body).select(
        "repo",
        F.explode(
            F.expr("try_variant_get(document, '$.snippets', 'map<string,string>')")
        ).alias("path", "snippet"),
    )


def attach_snippets(nodes: DataFrame, snippets: DataFrame) -> DataFrame:
    """Nodes with the imported snippet of each path."""
    return nodes.drop("snippet").join(snippets, ["repo", "path"], "left").select(*nodes.columns)


def manifest(
    nodes: DataFrame,
    files: DataFrame,
    base_path: str,
    generated_at: str,
    model: str = "model",
) -> DataFrame:
    """One row per repo with everything a catalogue document has beside the tree.

    The model label is used where a description came from a model.
    """
    facts = nodes.groupBy("repo").agg(
        F.max(F.col("snippet").isNotNull()).alias("has_snippets"),
        F.coalesce(F.max(F.col("description_source") == "model"), F.lit(False)).alias("_model"),
    )
    readmes = readme_context(files)
    return facts.join(readmes, "repo", "left").select(
        "repo",
        F.concat(F.lit(base_path.removesuffix("/") + "/"), F.col("repo")).alias("basePath"),
        F.substring(F.coalesce("readme", F.lit("")), 1, fv.README_STORED_CHARS).alias("readme"),
        F.lit(generated_at).alias("generatedAt"),
        F.when(F.col("_model"), F.lit(model)).otherwise(F.lit("heuristics-only")).alias("model"),
        F.col("has_snippets").alias("hasSnippets"),
    )


def export_catalogue(nodes: DataFrame, manifest_rows: DataFrame, target: str) -> None:
    """Writes manifest, tree without snippets, and the snippets on their own.

    Unknown purposes leave as the dash.  All three parts are replaced, so a snippets part
    without rows takes the place of an older one.  The manifest has the keys that
    `import_manifest` reads.
    """
    purpose = F.when(
        F.col("kind") == "file", F.coalesce("description", F.lit(fv.UNKNOWN_PURPOSE))
    ).otherwise(F.col("description"))
    manifest_rows.write.mode("overwrite").json(f"{target}/manifest")
    tree = nodes.drop("snippet").withColumn("description", purpose)
    by_repo(tree).write.mode("overwrite").partitionBy("repo").json(f"{target}/tree")
    snippets = nodes.filter(F.col("snippet").isNotNull()).select("repo", "path", "snippet")
    by_repo(snippets).write.mode("overwrite").partitionBy("repo").json(f"{target}/snippets")
