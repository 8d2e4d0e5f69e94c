"""The physical plans that large data depends on."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from repoloom.operators import search, tree
from repoloom.plans import catalogue, fixtures
from repoloom.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("nodes") / "nodes")
    catalogue.scan(fixtures.files(spark, SMALL)).write.parquet(target)
    return spark.read.parquet(target)


# The queries that list and read files of a file system do so in Python.
NATIVE = [n for n in QUERIES if not n.startswith("w") and n not in ("s1_scan_tree", "s1_scan_headers")]


@pytest.mark.parametrize("name", NATIVE)
def test_no_query_crosses_rows_runs_python_or_gathers_everything(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert bad not in text
    # A single partition appears only where each task has one row left, the part of a sum.
    lines = text.split("\n")
    for line, below in zip(lines, lines[1:], strict=False):
        assert "SinglePartition" not in line or "functions=[partial_" in below, text
    for window in re.findall(r"Window \[.*", text):
        assert "windowspecdefinition(ORDER" not in window


def test_file_facts_need_no_shuffle(spark):
    text = plan(catalogue.tagged_files(fixtures.files(spark, SMALL)))
    assert "Exchange" not in text


def test_directories_never_read_contents(spark):
    files = fixtures.files(spark, SMALL)
    nodes = catalogue.scan(files)
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(nodes))
    assert sorted("text" in s for s in scans) == [False, True]
    assert "text" not in re.findall(r"ReadSchema: (struct<[^>]*>)", plan(QUERIES["f2_scannable"](spark, SMALL)))[0]


def test_rollups_shuffle_once_and_combine_first(stored):
    text = plan(tree.subtree_counts(stored))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text
    assert plan(tree.subtree_weight(stored)).count("Exchange hashpartitioning") == 2
    assert plan(tree.flatten_items(stored)).count("Exchange") == 0


def test_lookup_is_pushed_to_the_table(stored):
    text = plan(tree.node_at(stored, "src3/src"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(path,src3/src\)", text)
    listing = plan(tree.directory_listing(stored, "src3/src"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(parent_path,src3/src\)", listing)


def test_search_exchanges_only_the_best(stored):
    text = plan(search.search(tree.flatten_items(stored), "widget react"))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_tag_rules_are_evaluated_once(spark):
    for name in ("a2_tag_counts", "f5_files_with_tag", "q1_search", "p4_import_tags"):
        assert plan(QUERIES[name](spark, SMALL)).count("regexp_extract_all") == 1, name


# These store ranks, rounds or an index, read or write files, or run a stream.
STORING = (
    "s1_scan_tree", "s1_scan_headers", "s4_import_catalogue_by_level", "s5_", "s7_", "t1_walk", "t7_", "t_trees", "q2_", "l1_", "l2_", "l6_batches", "c2_commits_since_tag",
    "c5_next_version_by_tag", "c6_", "w",
)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(STORING)])
def test_building_a_query_runs_no_job(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", name)
    try:
        QUERIES[name](spark, SMALL)
        jobs = context.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # Reading a parquet schema is a job of its own kind: one per table at most.
    assert len(jobs) <= 4
