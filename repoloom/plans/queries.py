"""One query per operator over the given tables.

Arrays leave as comma-joined text and numbers as bigint, so that results compare
value by value with SQL.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import (
    aggregates, describe, filters, marks, readme, release, requests, search, search_index, tree,
)
from ..sources import catalogue as catalogue_source
from ..sources import corpus, path_list, tree_listing, tree_sink, tree_source
from ..sources import documents as document_source
from ..streaming import catalogue as streams
from ..streaming import watch
from . import catalogue, fixtures

Query = Callable[[SparkSession, str], DataFrame]

BASE_PATH = "/srv/checkouts/"
GENERATED_AT = "2024-02-01T00:00:00Z"
VERSIONED_CATALOGUES = (
    "SELECT cast(floor(repo_id / 10) AS bigint) AS repo, repo_id AS version, "
    "CASE WHEN repo_id % 10 = 3 THEN substr(body, 1, length(body) - 1) ELSE body END AS body "
    f"FROM ({fixtures.CATALOGUES}) c"
)


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def _big(column: str):
    return F.col(column).cast("bigint").alias(column)


def _flat_nodes(nodes: DataFrame, *extra: str) -> DataFrame:
    return nodes.select(
        *extra, "repo", "path", "parent_path", "name", "kind", _big("depth"),
        "description", _joined("tags"),
    )


def _path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_list.import_path_list(fixtures.paths(spark, sf_dir), "page_id")


def _list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of several lists, told apart by repo only."""
    return path_list.import_path_list(fixtures.path_lists(spark, sf_dir), "page_id", "list_id")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.tagged_files(fixtures.files(spark, sf_dir))


def _file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.file_nodes(_tagged(spark, sf_dir), ["doc_id"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag counts over the corpus."""
    return aggregates.tag_counts(_file_nodes(spark, sf_dir))


# --- sources and sinks -------------------------------------------------------

def s1_scan_corpus(spark, sf_dir):
    nodes = catalogue.scan(fixtures.files(spark, sf_dir))
    return _flat_nodes(nodes, "snippet")


def s1_scan_tree(spark, sf_dir):
    """The files as a tree on a file system, scanned back whole."""
    folder = streams.work_folder(spark, "tree")
    files = fixtures.files(spark, sf_dir)
    # A folder of its own for each document, for some paths occur twice.
    place = F.regexp_replace("path", "([^/]+)$", F.concat(F.lit("n"), F.col("doc_id"), F.lit(" [é#%41]/$1")))
    files = files.withColumn("path", F.concat(F.lit("corpus/"), place)).repartition("doc_id")
    tree_sink.write_files(files, folder)
    scanned = corpus.scan_corpus(spark, [f"{folder}/corpus"])
    return scanned.select("path", "size", F.md5("content").alias("content_md5"))


def s1_scan_headers(spark, sf_dir):
    """The files on disk, and what their headers say of them; no file is read further."""
    folder = f"{streams.work_folder(spark, 'headers')}/corpus"
    place = F.regexp_replace("path", "([^/]+)$", F.concat(F.lit("n"), F.col("doc_id"), F.lit("/$1")))
    tree_sink.write_files(fixtures.files(spark, sf_dir).withColumn("path", place), folder)
    tagged = catalogue.tagged_files(tree_source.scan_tree(spark, folder, headers=True))
    return tagged.select(
        F.regexp_extract("path", "/n(\\d+)/[^/]+$", 1).cast("bigint").alias("doc_id"), _joined("tags"), "purpose", "snippet"
    )


def s2_import_path_list(spark, sf_dir):
    return _flat_nodes(_path_nodes(spark, sf_dir))


def s2_import_path_lists(spark, sf_dir):
    return _flat_nodes(_list_nodes(spark, sf_dir))


def s3_import_tree_listing(spark, sf_dir):
    return _flat_nodes(tree_listing.import_tree_listing(fixtures.listings(spark, sf_dir)))


def s4_import_catalogue(spark, sf_dir):
    return _flat_nodes(catalogue_source.import_catalogue(fixtures.catalogues(spark, sf_dir)))


def s4_import_catalogue_by_level(spark, sf_dir):
    return _flat_nodes(catalogue_source.import_catalogue_by_level(fixtures.catalogues(spark, sf_dir)))


def s4_import_manifest(spark, sf_dir):
    return catalogue_source.import_manifest(fixtures.catalogues(spark, sf_dir)).select(
        "repo", F.col("basePath").alias("base_path"), "readme",
        F.col("generatedAt").alias("generated_at"), "model",
        F.col("hasSnippets").alias("has_snippets"),
    )


def s4_import_snippets(spark, sf_dir):
    documents = fixtures.catalogues(spark, sf_dir)
    nodes = catalogue_source.import_catalogue(documents)
    found = catalogue_source.attach_snippets(nodes, catalogue_source.import_snippets(documents))
    return found.filter(F.col("snippet").isNotNull()).select("repo", "path", "snippet")


def _exported(spark, sf_dir) -> str:
    """The folder that manifest, tree and snippets of the scan were written to."""
    folder = streams.work_folder(spark, "export")
    files = fixtures.files(spark, sf_dir)
    catalogue.scan(files).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    manifest = catalogue_source.manifest(nodes, files, BASE_PATH, GENERATED_AT)
    catalogue_source.export_catalogue(nodes, manifest, f"{folder}/out")
    return f"{folder}/out"


def s5_export_catalogue(spark, sf_dir):
    return spark.read.json(f"{_exported(spark, sf_dir)}/manifest").select(
        "repo", F.col("basePath").alias("base_path"), "readme",
        F.col("generatedAt").alias("generated_at"), "model",
        F.col("hasSnippets").alias("has_snippets"),
    )


def s5_export_tree(spark, sf_dir):
    return _flat_nodes(spark.read.json(f"{_exported(spark, sf_dir)}/tree"), "description_source")


def s5_export_snippets(spark, sf_dir):
    return spark.read.json(f"{_exported(spark, sf_dir)}/snippets").select("repo", "path", "snippet")


def s5_export_documents(spark, sf_dir):
    """One nested document per repo, written, read back and imported."""
    folder = streams.work_folder(spark, "documents")
    files = fixtures.files(spark, sf_dir)
    catalogue.scan(files).write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    manifest = catalogue_source.manifest(nodes, files, BASE_PATH, GENERATED_AT)
    document_source.write_documents(document_source.document_lines(nodes, manifest), f"{folder}/out")
    found = document_source.read_documents(spark, f"{folder}/out")
    imported = catalogue_source.import_catalogue(found, repo="repo")
    snippets = catalogue_source.import_snippets(found, repo="repo")
    return _flat_nodes(catalogue_source.attach_snippets(imported, snippets), "snippet")


def s6_readme_context(spark, sf_dir):
    return readme.readme_context(fixtures.files(spark, sf_dir))


def s7_write_rewritten(spark, sf_dir):
    folder = streams.work_folder(spark, "rewritten")
    corpus.write_rewritten(fixtures.files(spark, sf_dir), folder)
    return spark.read.parquet(folder).select(
        "repo", "path", "target", F.md5("content").alias("content_md5")
    )


def s7_rewrite_tree(spark, sf_dir):
    """The files on disk, and beside each annotatable one its text without marks."""
    folder = streams.work_folder(spark, "rewrite")
    place = F.regexp_replace("path", "([^/]+)$", F.concat(F.lit("n"), F.col("doc_id"), F.lit("/$1")))
    # Without names with a leading dot.
    files = fixtures.files(spark, sf_dir).filter(~F.contains("path", F.lit("/."))).withColumn("path", place)
    tree_sink.write_files(files, folder)
    kept = marks.strip_marks(filters.annotatable(files))
    rewritten = corpus.with_target(kept).select(F.col("target").alias("path"), F.col("stripped").alias("content"))
    tree_sink.write_files(rewritten, folder)
    found = tree_source.scan_tree(spark, folder, everything=True)
    # Below the work folder, whose name is a hash.
    return found.select(
        F.regexp_extract("path", r"^[^/]*/(.*)$", 1).alias("path"),
        "size",
        F.md5("content").alias("content_md5"),
    )


# --- filters -----------------------------------------------------------------

def f1_exclude_paths(spark, sf_dir):
    extra = filters.parse_name_list("tests, d7")
    return filters.exclude_paths(fixtures.files(spark, sf_dir), extra).select("doc_id", "path")


def f2_scannable(spark, sf_dir):
    return filters.scannable(fixtures.files(spark, sf_dir)).select("doc_id", "path")


def f3_annotatable(spark, sf_dir):
    return filters.annotatable(fixtures.files(spark, sf_dir)).select("doc_id", "path")


def f4_prune_empty_dirs(spark, sf_dir):
    return filters.prune_empty_dirs(_path_nodes(spark, sf_dir)).select("path", "kind")


def f5_files_with_tag(spark, sf_dir):
    return filters.files_with_tag(_file_nodes(spark, sf_dir), "api")


def f6_has_marks(spark, sf_dir):
    return filters.has_marks(fixtures.files(spark, sf_dir)).select("doc_id")


# --- per-row facts -----------------------------------------------------------

def p1_describe_files(spark, sf_dir):
    return describe.describe_files(fixtures.files(spark, sf_dir)).select("doc_id", "name", "purpose")


def p2_describe_dirs(spark, sf_dir):
    files = fixtures.files(spark, sf_dir)
    above = files.select("repo", paths.parent_path().alias("parent_path"))
    return describe.describe_dirs(tree.distinct_directories(above)).select("path", "description")


def p3_name_tags(spark, sf_dir):
    return describe.name_tags(fixtures.files(spark, sf_dir)).select("doc_id", _joined("name_tags"))


def p4_import_tags(spark, sf_dir):
    files = describe.header_snippet(fixtures.files(spark, sf_dir))
    return describe.import_tags(files).select("doc_id", _joined("import_tags"))


def p5_merge_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", _joined("tags"))


def p6_header_snippet(spark, sf_dir):
    return describe.header_snippet(fixtures.files(spark, sf_dir)).select("doc_id", "snippet")


def p7_language_of(spark, sf_dir):
    return describe.language_of(fixtures.files(spark, sf_dir)).select("doc_id", "language")


def p8_snippet_preview(spark, sf_dir):
    return describe.snippet_preview(_tagged(spark, sf_dir), 6).select("doc_id", "preview")


def p9_absolute_path(spark, sf_dir):
    return describe.absolute_path(fixtures.files(spark, sf_dir), BASE_PATH).select(
        "doc_id", "absolute_path", "uri"
    )


def p10_ancestors(spark, sf_dir):
    return describe.ancestors(_path_nodes(spark, sf_dir)).select("path", "kind", _big("level"), "ancestor")


def p11_primary_tag(spark, sf_dir):
    return describe.primary_tag(_tagged(spark, sf_dir)).select("doc_id", "primary_tag")


# --- trees -------------------------------------------------------------------

def t1_all_paths(spark, sf_dir):
    return tree.all_paths(_path_nodes(spark, sf_dir)).select("path", "kind")


def t1_walk(spark, sf_dir):
    return tree.walk(_path_nodes(spark, sf_dir)).select("path", "kind", "walk_rank")


def t2_flatten_items(spark, sf_dir):
    return tree.flatten_items(_path_nodes(spark, sf_dir)).select(
        "name", "description", _joined("tags"), "path", "parent_path", "type"
    )


def t3_node_at(spark, sf_dir):
    nodes = _flat_nodes(catalogue.scan(fixtures.files(spark, sf_dir)))
    return tree.node_at(nodes, "src3/src/components").select("path", "name", "description")


def t4_subtree_counts(spark, sf_dir):
    return tree.subtree_counts(_path_nodes(spark, sf_dir)).select("path", "files", "dirs")


def t5_subtree_weight(spark, sf_dir):
    return tree.subtree_weight(_path_nodes(spark, sf_dir)).select("path", "weight")


def t6_area_share(spark, sf_dir):
    return tree.area_share(_path_nodes(spark, sf_dir)).select(
        "parent_path", "path", "kind", "value", F.round("area", 9).alias("area")
    )


def t7_directory_listing(spark, sf_dir):
    return tree.listing_ranks(_path_nodes(spark, sf_dir)).select("path", "kind", "listing_rank")


def t8_child_preview(spark, sf_dir):
    return tree.child_preview(_path_nodes(spark, sf_dir)).select(
        "path", _joined("first_dirs"), _joined("first_files")
    )


def t_trees_of_lists(spark, sf_dir):
    """What T1 and T4 to T8 say of each node, over several trees that hold equal paths."""
    nodes = _list_nodes(spark, sf_dir)
    key = ["repo", "path"]
    found = tree.walk(nodes).select(*key, "kind", "walk_rank")
    for part in (
        tree.subtree_counts(nodes).select(*key, "files", "dirs"),
        tree.subtree_weight(nodes).select(*key, "weight"),
        tree.area_share(nodes).select(*key, F.round("area", 9).alias("area")),
        tree.listing_ranks(nodes).select(*key, "listing_rank"),
        tree.child_preview(nodes).select(*key, _joined("first_dirs"), _joined("first_files")),
    ):
        found = found.join(part, key, "left")
    return found


def f4_prune_lists(spark, sf_dir):
    return filters.prune_empty_dirs(_list_nodes(spark, sf_dir)).select("repo", "path", "kind")


def p10_ancestors_of_lists(spark, sf_dir):
    return describe.ancestors(_list_nodes(spark, sf_dir)).select("repo", "path", "kind", _big("level"), "ancestor")


def t8_tag_preview(spark, sf_dir):
    return tree.tag_preview(_file_nodes(spark, sf_dir), 3).select("doc_id", _joined("first_tags"))


# --- counters ----------------------------------------------------------------

def a1_distinct_tags(spark, sf_dir):
    return aggregates.distinct_tags(_file_nodes(spark, sf_dir))


def a2_tag_counts(spark, sf_dir):
    return flagship(spark, sf_dir)


def a3_inferred_tag_count(spark, sf_dir):
    return aggregates.inferred_tag_count(_file_nodes(spark, sf_dir))


def a4_scan_summary(spark, sf_dir):
    return aggregates.scan_summary(catalogue.scan(fixtures.files(spark, sf_dir)))


# --- search ------------------------------------------------------------------

def _items(spark, sf_dir):
    """Files and folders of the scan."""
    return tree.flatten_items(catalogue.scan(fixtures.files(spark, sf_dir)))


def q1_search(spark, sf_dir):
    return search.search(_items(spark, sf_dir), "widget react").select(
        "path", "type", _big("score")
    )


def q2_search_many(spark, sf_dir):
    asked = spark.createDataFrame(fixtures.QUERY_TEXTS, "query_id int, query string")
    return search.search_many(_items(spark, sf_dir), asked).select(
        _big("query_id"), _big("rank"), "path", "type", _big("score")
    )


def q2_search_index(spark, sf_dir):
    """Two sets of queries on one stored index: fixed ones, and the last path segments of the pages."""
    folder = streams.work_folder(spark, "search")
    search_index.build(_items(spark, sf_dir), folder)
    asked = spark.createDataFrame(fixtures.QUERY_TEXTS, "query_id int, query string")
    more = fixtures.paths(spark, sf_dir).select(
        F.col("page_id").alias("query_id"),
        F.concat(F.lit("d"), F.col("page_id") % 40, F.lit(" "), F.element_at(F.split("path", "/"), -1), F.lit(" py")).alias("query"),
    )
    first = search_index.search(spark, folder, asked).withColumn("set", F.lit("fixed"))
    second = search_index.search(spark, folder, more, 5).withColumn("set", F.lit("pages"))
    columns = ["set", _big("query_id"), _big("rank"), "path", "type", _big("score")]
    return first.select(*columns).unionByName(second.select(*columns))


# --- description requests ----------------------------------------------------

def _all_nodes(spark, sf_dir):
    """Files, told apart by doc_id, and directories."""
    return catalogue.scan(fixtures.files(spark, sf_dir), extra_columns=["doc_id"])


def _batches(spark, sf_dir, snippets=False):
    return requests.batch_paths(_all_nodes(spark, sf_dir), snippets=snippets)


def l1_batch_paths(spark, sf_dir):
    return _batches(spark, sf_dir).select("repo", "doc_id", "path", "position", "batch_id")


def l2_build_requests(spark, sf_dir):
    readmes = readme.readme_context(fixtures.files(spark, sf_dir))
    return requests.build_requests(_batches(spark, sf_dir, True), readmes, "plain")


def l3_parse_responses(spark, sf_dir):
    return requests.parse_responses(fixtures.responses(spark, sf_dir)).select(
        "batch_id", "turn", "path", "description"
    )


def _descriptions(spark, sf_dir):
    # Several batches speak about the same document, the last one wins.
    parsed = requests.parse_responses(fixtures.responses(spark, sf_dir)).withColumn(
        "path", F.expr("cast(cast(path AS bigint) div 16 AS string)")
    )
    return requests.merge_descriptions(parsed, ("path",), ("batch_id", "turn", "entry_no"))


def l4_merge_descriptions(spark, sf_dir):
    return _descriptions(spark, sf_dir)


def l5_apply_descriptions(spark, sf_dir):
    # One answer in seven speaks about a directory, the others about documents.
    number = F.col("path").cast("bigint")
    found = _descriptions(spark, sf_dir).select(
        F.when(number % 7 == 0, F.concat(F.lit("src"), number % 20, F.lit("/src/d"), number % 40))
        .otherwise(F.concat(F.lit("#"), number))
        .alias("key"),
        "path",
        "description",
    )
    found = found.groupBy("key").agg(F.max_by("description", F.col("path").cast("bigint")).alias("description"))
    nodes = _all_nodes(spark, sf_dir).withColumn(
        "key", F.when(F.col("kind") == "dir", F.col("path")).otherwise(F.concat(F.lit("#"), "doc_id"))
    )
    return requests.apply_descriptions(nodes, found, ("key",)).select(
        "doc_id", "path", "description", "description_source", "applied"
    )


def l6_batch_outcomes(spark, sf_dir):
    return requests.batch_outcomes(fixtures.responses(spark, sf_dir))


def l6_batches_with_code(spark, sf_dir):
    return requests.batches_with_code(_batches(spark, sf_dir))


# --- marked comments ---------------------------------------------------------

def m1_extract_marks(spark, sf_dir):
    return marks.extract_marks(fixtures.files(spark, sf_dir)).select(
        "doc_id", _big("line_no"), "indent", "syntax", "mode", "body"
    )


def m2_detect_modes(spark, sf_dir):
    return marks.detect_modes(fixtures.files(spark, sf_dir)).select("doc_id", _joined("modes"))


def m3_count_marks(spark, sf_dir):
    files = fixtures.files(spark, sf_dir)
    content = F.col("content")
    return files.select(
        "doc_id",
        marks.count_marks_expr(content).alias("marks"),
        marks.count_marks_expr(content, "tutor").alias("tutor_marks"),
    )


def m4_strip_marks(spark, sf_dir):
    return marks.strip_marks(fixtures.files(spark, sf_dir)).select("doc_id", "stripped", "removed")


def m5_strip_marks_by_mode(spark, sf_dir):
    return marks.strip_marks_by_mode(fixtures.files(spark, sf_dir), "non-technical").select(
        "doc_id", "stripped", "removed"
    )


def m6_apply_strategy(spark, sf_dir):
    return marks.apply_strategy(fixtures.files(spark, sf_dir), "replace").select("doc_id", "content")


def m7_annotation_requests(spark, sf_dir):
    return requests.annotation_requests(fixtures.files(spark, sf_dir), "minimal").select(
        "doc_id", "language", "prompt"
    )


def m8_clean_responses(spark, sf_dir):
    return marks.clean_responses(fixtures.responses(spark, sf_dir))


def m9_erase_report(spark, sf_dir):
    return marks.erase_report(fixtures.files(spark, sf_dir))


def _outcomes(spark, sf_dir):
    parsed = requests.batch_outcomes(fixtures.responses(spark, sf_dir))
    failed = F.col("status") == "failed"
    return parsed.select(
        F.concat(F.lit("conversation"), F.col("batch_id").cast("string")).alias("repo"),
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("path"),
        F.when(failed, "failed").otherwise("succeeded").alias("status"),
        F.when(failed, "unparsable response").alias("reason"),
    )


def m10_run_summary(spark, sf_dir):
    return marks.run_summary(_outcomes(spark, sf_dir))


def m10_failures(spark, sf_dir):
    return marks.failures(_outcomes(spark, sf_dir))


# --- releases ----------------------------------------------------------------

def c1_parse_commits(spark, sf_dir):
    return release.parse_commits(fixtures.commits(spark, sf_dir)).select(
        "repo", "event_id", "type", "scope", "breaking", "description"
    )


def c2_commits_since_release(spark, sf_dir):
    return release.commits_since_release(
        fixtures.commits(spark, sf_dir), fixtures.tags(spark, sf_dir)
    ).select("repo", "event_id", "hash")


def c2_last_commits(spark, sf_dir):
    return release.last_commits(fixtures.commits(spark, sf_dir), 5).select("repo", "event_id", "hash")


def c2_commits_since_tag(spark, sf_dir):
    return release.commits_since_tag(*fixtures.commit_graph(spark, sf_dir)).select(
        "repo", "event_id", "hash"
    )


def c5_next_version_by_tag(spark, sf_dir):
    return release.next_versions_by_tag(*fixtures.commit_graph(spark, sf_dir))


def c3_validate_commits(spark, sf_dir):
    return release.validate_commits(fixtures.commits(spark, sf_dir)).select(
        "repo", "event_id", "error", "detail"
    )


def c3_commit_verdicts(spark, sf_dir):
    return release.commit_verdicts(fixtures.commits(spark, sf_dir)).select(
        "repo", "commits", _big("problems"), "valid"
    )


def c4_bump_type(spark, sf_dir):
    return release.bump_type(fixtures.commits(spark, sf_dir))


def c5_next_version(spark, sf_dir):
    return release.next_versions(fixtures.commits(spark, sf_dir), fixtures.tags(spark, sf_dir))


def c6_changelog_entries(spark, sf_dir):
    return release.changelog_entries(fixtures.commits(spark, sf_dir)).select(
        "repo", "section", _big("section_rank"), "entry_rank", "line"
    )


def c6_changelog_text(spark, sf_dir):
    commits, tags = fixtures.commits(spark, sf_dir), fixtures.tags(spark, sf_dir)
    versions = release.latest_tags(tags).select("repo", "version")
    return release.changelog_text(commits, versions, "2024-02-01").select(
        "repo", _big("part"), _big("section_rank"), "line_no", "line"
    )


def c7_breaking_notes(spark, sf_dir):
    return release.breaking_notes(fixtures.commits(spark, sf_dir)).select("repo", "hash", "note")


def c8_whats_new(spark, sf_dir):
    return release.whats_new(fixtures.commits(spark, sf_dir)).select(
        "repo", "hash", "type", "description"
    )


# --- streams -----------------------------------------------------------------

def w1_stream_catalogue(spark, sf_dir):
    source = fixtures.stream(spark, sf_dir, VERSIONED_CATALOGUES, "pages")
    folder = streams.work_folder(spark, "catalogues")
    streams.stream_catalogue(source, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return streams.current_catalogues(spark, f"{folder}/log").select("repo", "version", "body")


def w1_stream_newest(spark, sf_dir):
    source = fixtures.stream(spark, sf_dir, VERSIONED_CATALOGUES, "pages")
    folder = streams.work_folder(spark, "newest")
    streams.stream_newest(source, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return streams.current_catalogues(spark, f"{folder}/log").select("repo", "version", "body")


def w2_stream_marks(spark, sf_dir):
    source = fixtures.stream(spark, sf_dir, fixtures.FILES, "documents")
    folder = streams.work_folder(spark, "marks")
    streams.stream_marks(source, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id", _big("line_no"), "indent", "syntax", "mode", "body"
    )


def w2_watch_tree(spark, sf_dir):
    """Marks of a watched tree: two thirds of the files, then the rest, and half of the others changed."""
    folder = streams.work_folder(spark, "watched")
    place = F.regexp_replace("path", "([^/]+)$", F.concat(F.lit("n"), F.col("doc_id"), F.lit("/$1")))
    files = fixtures.files(spark, sf_dir).withColumn("path", place)
    changed = F.when(F.col("doc_id") % 3 == 1, F.concat("content", F.lit("\n// ᚲ [tutor] changed"))).otherwise(F.col("content"))
    later = files.filter("doc_id % 3 <> 2").withColumn("content", changed)
    for rows in (files.filter("doc_id % 3 <> 0"), later):
        tree_sink.write_files(rows, f"{folder}/corpus")
        stream = watch.watch_tree(spark, f"{folder}/corpus", settle=0)
        streams.stream_marks(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(
        F.regexp_extract("path", "/n(\\d+)/[^/]+$", 1).cast("bigint").alias("doc_id"),
        _big("line_no"), "indent", "syntax", "mode", "body",
    )


def w2_stream_tags(spark, sf_dir):
    source = fixtures.stream(spark, sf_dir, fixtures.FILES, "documents")
    folder = streams.work_folder(spark, "tags")
    streams.stream_tags(source, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", _joined("tags"), "purpose")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        s1_scan_corpus, s1_scan_tree, s1_scan_headers, s2_import_path_list, s2_import_path_lists, s3_import_tree_listing, s4_import_catalogue, s4_import_catalogue_by_level,
        s4_import_manifest, s4_import_snippets, s5_export_catalogue, s5_export_tree,
        s5_export_snippets, s5_export_documents, s6_readme_context, s7_write_rewritten, s7_rewrite_tree,
        f1_exclude_paths, f2_scannable, f3_annotatable, f4_prune_empty_dirs, f4_prune_lists,
        f5_files_with_tag, f6_has_marks,
        p1_describe_files, p2_describe_dirs, p3_name_tags, p4_import_tags, p5_merge_tags,
        p6_header_snippet, p7_language_of, p8_snippet_preview, p9_absolute_path,
        p10_ancestors, p10_ancestors_of_lists, p11_primary_tag,
        t1_all_paths, t1_walk, t2_flatten_items, t3_node_at, t4_subtree_counts, t5_subtree_weight,
        t6_area_share, t7_directory_listing, t8_child_preview, t_trees_of_lists, t8_tag_preview,
        a1_distinct_tags, a2_tag_counts, a3_inferred_tag_count, a4_scan_summary,
        q1_search, q2_search_many, q2_search_index,
        l1_batch_paths, l2_build_requests, l3_parse_responses, l4_merge_descriptions,
        l5_apply_descriptions, l6_batch_outcomes, l6_batches_with_code,
        m1_extract_marks, m2_detect_modes, m3_count_marks, m4_strip_marks,
        m5_strip_marks_by_mode, m6_apply_strategy, m7_annotation_requests,
        m8_clean_responses, m9_erase_report, m10_run_summary, m10_failures,
        c1_parse_commits, c2_commits_since_release, c2_commits_since_tag, c2_last_commits, c3_validate_commits,
        c3_commit_verdicts, c4_bump_type, c5_next_version, c5_next_version_by_tag, c6_changelog_entries, c6_changelog_text,
        c7_breaking_notes, c8_whats_new,
        w1_stream_catalogue, w1_stream_newest, w2_stream_marks, w2_stream_tags, w2_watch_tree,
    )
}
