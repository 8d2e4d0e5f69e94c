"""Importers, hierarchy roll-ups, ranking, search."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL, values
from repoloom.operators import aggregates, ranking, requests, search, tree
from repoloom.plans import fixtures, queries
from repoloom.sources import catalogue as catalogue_source
from repoloom.sources import path_list, tree_listing


def path_nodes(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "n int, path string")
    return path_list.import_path_list(df, "n")


def test_path_list_of_the_given_tables(spark):
    nodes = path_list.import_path_list(fixtures.paths(spark, "/root/testdata/sf0.01"), "page_id")
    assert {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()} == {"file": 35, "dir": 398}
    root = tree.subtree_counts(nodes).filter("path = 'site'").first()
    assert (root["files"], root["dirs"]) == (35, 397)


def test_path_list(spark):
    nodes = path_nodes(
        spark, "# header", "", "  ./app/src/main.py ", "app/src/main.py", "app/Makefile", "app//lib/", "other/x.js",
        "app/a.txt/", "app", "app/file.toolongextension")
    assert values(nodes, "path", "kind") == sorted([
        ("app", "dir"), ("app/src", "dir"), ("app/src/main.py", "file"), ("app/Makefile", "dir"), ("app/lib", "dir"),
        ("app/other", "dir"), ("app/other/x.js", "file"), ("app/a.txt", "dir"), ("app/file.toolongextension", "dir"),
    ])
    root = nodes.filter("depth = 0").first()
    assert (root["repo"], root["parent_path"], root["description"]) == ("app", None, "Project root")
    assert values(path_nodes(spark, "/usr/x.py"), "path") == [("project",), ("project/usr",), ("project/usr/x.py",)]
    assert values(path_nodes(spark, "a.py"), "path", "kind") == [("a.py", "dir")]


def test_path_lists_side_by_side(spark):
    df = spark.createDataFrame(
        [(1, 0, "a/x.py"), (1, 1, "b/y.py"), (2, 0, "b/y.py"), (2, 1, "a/x.py")], "l int, n int, path string")
    got = values(path_list.import_path_list(df, "n", "l").filter("kind = 'file'"), "repo", "path")
    assert got == [("1", "a/b/y.py"), ("1", "a/x.py"), ("2", "b/a/x.py"), ("2", "b/y.py")]


LISTING = """shop/
├── src
│   ├── api
│   │   └── cart.py
│   ├── main.py
│   └── empty/
├── README.md
└── tests
    └── test_cart.py

4 directories, 3 files"""
LISTED = sorted([
    ("shop", "dir"), ("shop/src", "dir"), ("shop/src/api", "dir"), ("shop/src/api/cart.py", "file"),
    ("shop/src/main.py", "file"), ("shop/src/empty", "dir"), ("shop/README.md", "file"),
    ("shop/tests", "dir"), ("shop/tests/test_cart.py", "file"),
])


@pytest.mark.parametrize("text", [LISTING, LISTING.replace("│   ", "│   "), LISTING.replace("\n", "\r\n"),
                                  LISTING.replace("── ", "─ ")])
def test_tree_listing(spark, text):
    df = spark.createDataFrame([(7, text), (8, "\n  \n"), (9, "solo")], "listing_id int, text string")
    nodes = tree_listing.import_tree_listing(df)
    assert values(nodes.filter("repo = '7'"), "path", "kind") == LISTED
    assert values(nodes.filter("repo <> '7'"), "repo", "path") == [("9", "solo")]


def reference_paths(items):
    """Stack of open items, as drawn."""
    stack, out = [], []
    for depth, name in items:
        while stack and stack[-1][0] >= depth:
            stack.pop()
        out.append("/".join(["root", *[n for _, n in stack], name]))
        stack.append((depth, name))
    return out


def test_random_listings(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for listing in range(60):
        items, depth = [], 0
        for i in range(rng.randrange(1, 25)):
            depth = rng.randrange(0, depth + 2)
            items.append((depth, f"n{i}"))
        text = "root\n" + "\n".join("│   " * d + "├── " + n for d, n in items)
        rows.append((listing, text))
        want |= {(str(listing), p) for p in reference_paths(items)} | {(str(listing), "root")}
    df = spark.createDataFrame(rows, "listing_id int, text string")
    assert set(values(tree_listing.import_tree_listing(df), "repo", "path")) == want


def test_format_detection(spark):
    df = spark.createDataFrame([(LISTING,), ("a/b.py\nc",)], "text string")
    assert [r[0] for r in df.select(tree_listing.is_tree_listing("text")).collect()] == [True, False]


DOCUMENT = {
    "basePath": "/srv/x", "model": "m", "hasSnippets": True, "readme": "hello", "generatedAt": "2024-01-01T00:00:00Z",
    "tree": {"name": "x", "description": "all", "files": [{"name": "a.py", "purpose": "—", "tags": ["python"]}],
             "children": [{"name": "src", "children": [{"name": "deep", "files": [{"name": "b.md", "purpose": "doc"}]}]},
                          {"name": "void"}]},
    "snippets": {"x/a.py": "import os", "x/none": "?"},
}


def test_catalogue_import(spark):
    df = spark.createDataFrame(
        [(1, json.dumps(DOCUMENT)), (2, json.dumps(DOCUMENT["tree"])), (3, "{broken"), (4, "[1]"), (5, "")],
        "repo_id int, body string")
    nodes = catalogue_source.import_catalogue(df)
    wanted = sorted([
        ("x", None, "dir", 0, "all"), ("x/a.py", "x", "file", 1, None), ("x/src", "x", "dir", 1, None),
        ("x/src/deep", "x/src", "dir", 2, None), ("x/src/deep/b.md", "x/src/deep", "file", 3, "doc"),
        ("x/void", "x", "dir", 1, None)], key=repr)
    columns = ("path", "parent_path", "kind", "depth", "description")
    assert values(nodes.filter("repo = '1'"), *columns) == wanted
    assert values(nodes.filter("repo = '2'"), *columns) == wanted
    assert nodes.filter("repo > '2'").count() == 0
    assert nodes.filter("path = 'x/a.py'").first()["tags"] == ["python"]
    assert values(catalogue_source.import_manifest(df), "repo", "basePath", "hasSnippets", "model") == [
        ("1", "/srv/x", True, "m"), ("2", None, None, None)]
    with_code = catalogue_source.attach_snippets(nodes, catalogue_source.import_snippets(df))
    assert values(with_code.filter("snippet is not null"), "repo", "path", "snippet") == [("1", "x/a.py", "import os")]


def nested(rng, depth=0):
    return {
        f"d{i}": nested(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else {}
        for i in range(rng.randrange(3))
    } | {f"f{i}.py": None for i in range(rng.randrange(3))}


def brute_weight(node):
    total = 0
    for child in node.values():
        total += 1 if child is None else max(brute_weight(child), 1)
    return max(total, 1)


def brute_counts(node):
    files = sum(c is None for c in node.values())
    dirs = len(node) - files
    for child in node.values():
        if child is not None:
            f, d = brute_counts(child)
            files, dirs = files + f, dirs + d
    return files, dirs


def test_rollups_equal_recursion_on_random_trees(spark):
    rng = random.Random(11)
    rows, want_weight, want_counts, shares = [], {}, {}, {}

    def walk(repo, path, node):
        parent = path.rpartition("/")[0] or None
        rows.append((repo, path, parent, path.split("/")[-1], "dir", path.count("/")))
        want_weight[repo, path] = brute_weight(node)
        want_counts[repo, path] = brute_counts(node)
        for name, child in node.items():
            inner = f"{path}/{name}"
            value = 1 if child is None else brute_weight(child)
            shares[repo, inner] = value / brute_weight(node)
            if child is None:
                rows.append((repo, inner, path, name, "file", inner.count("/")))
            else:
                walk(repo, inner, child)

    for i in range(40):
        walk(f"r{i}", "root", nested(rng))
    nodes = spark.createDataFrame(
        rows, "repo string, path string, parent_path string, name string, kind string, depth int").cache()
    got = {(r["repo"], r["path"]): r["weight"] for r in tree.subtree_weight(nodes).collect()}
    assert got == want_weight
    got = {(r["repo"], r["path"]): (r["files"], r["dirs"]) for r in tree.subtree_counts(nodes).collect()}
    assert got == want_counts
    area = tree.area_share(nodes)
    got = {(r["repo"], r["path"]): r["area"] for r in area.collect()}
    assert got.keys() == shares.keys() and all(abs(got[k] - shares[k]) < 1e-12 for k in got)
    sums = area.groupBy("repo", "parent_path").agg(F.sum("area").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums)
    assert tree.all_paths(nodes).count() == len(rows)
    assert tree.flatten_items(nodes.withColumn("description", F.lit("")).withColumn("tags", F.array())).count() == len(rows) - 40


def test_listing_preview_and_lookup(spark):
    names = ["b.py", "B.py", "a.md", "Zed/x", "alpha/x", "m1/x", "m2/x", "m3/x", "m4/x", "m5/x", "c1.md", "c2.md", "c3.md", "c4.md"]
    nodes = path_nodes(spark, *[f"p/{n}" for n in names])
    shown = [r["name"] for r in tree.directory_listing(nodes, "p").collect()]
    assert shown == ["alpha", "m1", "m2", "m3", "m4", "m5", "Zed", "a.md", "B.py", "b.py", "c1.md", "c2.md", "c3.md", "c4.md"]
    ranks = tree.listing_ranks(nodes).filter("parent_path = 'p'").orderBy("listing_rank").collect()
    assert [r["name"] for r in ranks] == shown
    preview = tree.child_preview(nodes).filter("path = 'p'").first()
    assert preview["first_dirs"] == shown[:6] and preview["first_files"] == shown[7:12]
    assert tree.node_at(nodes, "p/Zed", "p").count() == 1
    assert tree.node_at(nodes, "p/b.py").count() == tree.node_at(nodes, "p/none").count() == 0


def test_rank_of_large_groups_equals_plain_rank(spark):
    rows = [("hot", i * 7919 % 5000, "x") for i in range(5000)] + [(f"g{i % 50}", i, "y") for i in range(1000)]
    rows += [(None, i, "z") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, w string").repartition(6)
    order = [F.desc("v"), F.col("w")]
    window = Window.partitionBy("k").orderBy(*order)
    plain = values(df.withColumn("rn", F.row_number().over(window)))
    spread = values(ranking.ranked(df, ["k"], order, "rn"))
    assert spread == plain and len(plain) == 9000
    for n in (3, 1500):
        assert values(ranking.first_ranks(df, ["k"], order, n, "rn")) == [r for r in plain if r[3] <= n]
    by_key = {}
    for k, v, _, rn in spread:
        by_key.setdefault(k, []).append((rn, v))
    for pairs in by_key.values():
        assert sorted(p[0] for p in pairs) == list(range(1, len(pairs) + 1))
        assert [v for _, v in sorted(pairs)] == sorted((v for _, v in pairs), reverse=True)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("r", "Widget.tsx", "React component: Widget", ["react", "test"], "r/src/Widget.tsx"),
        ("r", "main.py", "Python module: main", ["python"], "r/src/main.py"),
        ("r", "config.yaml", "YAML config: config", ["config", "yaml"], "r/config.yaml"),
        ("r", "x", None, None, "r/x"),
    ]
    return spark.createDataFrame(rows, "repo string, name string, description string, tags array<string>, path string")


def test_search(items):
    def hits(query, k=15):
        return [(r["path"], r["score"]) for r in search.search(items, query, k).collect()]

    assert hits("  ") == hits("zzz") == []
    assert hits("widget react") == [("r/src/Widget.tsx", 2)]
    assert hits("PYTHON module") == [("r/src/main.py", 2)]
    assert hits(" config  r/ ") == [("r/config.yaml", 2), ("r/src/Widget.tsx", 1), ("r/src/main.py", 1), ("r/x", 1)]
    assert hits("r/ r/", 2) == [("r/config.yaml", 2), ("r/src/Widget.tsx", 2)]


def test_search_many_equals_single_searches(spark, items):
    asked = [(1, "widget react"), (2, " "), (3, "r/"), (4, "zzz"), (5, "config r/"), (6, "R/ r/ x"), (7, "y")]
    table = spark.createDataFrame(asked, "query_id int, query string")
    many = search.search_many(items, table, 2).collect()
    got = {}
    for r in sorted(many, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["path"], r["score"]))
    for qid, query in asked:
        single = [(r["path"], r["score"]) for r in search.search(items, query, 2).collect()]
        assert got.get(qid, []) == single
    assert search.search_many(items, table.limit(0)).count() == 0
    doubled = search.search_many(items.unionByName(items), table, 1500).filter("query_id = 3")
    assert [r["rank"] for r in doubled.orderBy("rank").collect()] == list(range(1, 2 * len(got_all(items, spark)) + 1))


def got_all(items, spark):
    return search.search(items, "r/", 1000).collect()


def test_search_many_reads_the_items_once(spark):
    items = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr(
        "'r' AS repo", "source AS name", "text AS description", "array(lang) AS tags", "source AS path")
    plans = []
    for n in (2, 200):
        asked = spark.createDataFrame([(i, f"word{i} x{i}") for i in range(n)], "query_id int, query string")
        plans.append(search.search_many(items, asked)._jdf.queryExecution().executedPlan().toString())
    # They were read for the index; what is left reads the index, however many queries there are.
    assert plans[0].count("FileScan") == plans[1].count("FileScan")
    for plan in plans:
        assert "documents.parquet" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_search_keeps_the_rank_limit_before_the_shuffle(spark):
    plan = queries.QUERIES["q2_search_many"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    # The results of a query, and the trigrams of a term.
    assert plan.count("WindowGroupLimit") == 4
    plan = queries.QUERIES["q1_search"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_counters(spark):
    nodes = spark.createDataFrame(
        [("r", "file", ["python", "ai", "react"], "s"), ("r", "file", [], None), ("r", "dir", None, None),
         ("q", "dir", None, None)],
        "repo string, kind string, tags array<string>, snippet string")
    assert values(aggregates.scan_summary(nodes)) == [("q", 1, 0, 0), ("r", 3, 1, 1)]
    assert values(aggregates.inferred_tag_count(nodes)) == [("r", 1)]
    assert values(aggregates.tag_counts(nodes)) == [("ai", 1), ("python", 1), ("react", 1)]
    assert [r["tag"] for r in aggregates.distinct_tags(nodes).collect()] == ["ai", "python", "react"]


def test_walk_order(spark):
    """A directory, its files, then its child directories, as a recursive walk gives them."""
    rng = random.Random(3)
    segments = ["a", "B", "b", "a b", "a-b", "a.b", "Z", "é", "0", "ab"]
    tree_rows = set()
    for repo in ("r", "q"):
        for _ in range(150):
            parts = [repo] + [rng.choice(segments) for _ in range(rng.randrange(1, 5))]
            tree_rows |= {(repo, "/".join(parts[:k]), "dir") for k in range(1, len(parts))}
            tree_rows.add((repo, "/".join(parts) + rng.choice(["", ".py"]) + "!", "file"))
    nodes = spark.createDataFrame(sorted(tree_rows), "repo string, path string, kind string")

    def walked(repo, path):
        own = [(p, k) for r, p, k in tree_rows if r == repo and p.rpartition("/")[0] == path]
        key = lambda p: (p.rpartition("/")[2].lower(), p)
        yield path
        yield from sorted((p for p, k in own if k == "file"), key=key)
        for p in sorted((p for p, k in own if k == "dir"), key=key):
            yield from walked(repo, p)

    for repo in ("r", "q"):
        got = tree.walk(nodes).filter(F.col("repo") == repo).orderBy("walk_rank").collect()
        assert [r.path for r in got] == list(walked(repo, repo))
        assert [r.walk_rank for r in got] == list(range(1, len(got) + 1))
    batches = requests.batch_paths(nodes.withColumn("snippet", F.lit(None).cast("string")), 7)
    got = [r.path for r in batches.filter("repo = 'r'").orderBy("batch_id", "position").collect()]
    assert got == list(walked("r", "r"))
