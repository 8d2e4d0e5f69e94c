import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, values
from repoloom.plans import catalogue, fixtures
from repoloom.sources import corpus, tree_sink, tree_source


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("tree") / "project")
    place = F.regexp_replace("path", "([^/]+)$", F.concat(F.lit("n"), F.col("doc_id"), F.lit(" é/$1")))
    tree_sink.write_files(fixtures.files(spark, SMALL).withColumn("path", place), target)
    return target


def test_equals_the_other_scan(spark, folder):
    whole = tree_source.scan_tree(spark, folder)
    other = corpus.scan_corpus(spark, [folder])
    assert values(whole, "repo", "path", "size") == values(other, "repo", "path", "size")
    read = other.filter("content is not null").select("path", "content")
    assert values(whole.join(read.select("path"), "path", "left_semi"), "path", "content") == values(read)


@pytest.mark.parametrize("per_task,tasks", [(20_000, 1), (3, 1), (20_000, 1000)])
def test_every_file_once_however_it_is_cut(folder, monkeypatch, per_task, tasks):
    monkeypatch.setattr(tree_source, "FILES_PER_TASK", per_task)
    reader = tree_source.TreeReader(folder, False, tasks)
    got = sorted(row[1] for part in reader.partitions() for row in reader.read(part))
    want = []
    for at, dirs, names in os.walk(folder):
        dirs[:] = [d for d in dirs if tree_source.wanted(d)]
        want += [os.path.join("project", os.path.relpath(os.path.join(at, n), folder)) for n in names if tree_source.wanted(n)]
    assert got == sorted(want)


def test_headers_are_enough_for_the_catalogue(spark, folder, tmp_path):
    long = {"crlf.py": "import torch\r\n" + "x\r\n" * 9000, "wide.py": "🙂é\n" * 20000, "r.js": "\r\n" * 5000 + "end"}
    big = str(tmp_path / "big")
    tree_sink.write_files(spark.createDataFrame(list(long.items()), "path string, content string"), big)
    for root in (folder, big):
        scans = [catalogue.scan(tree_source.scan_tree(spark, root, headers=h)) for h in (True, False)]
        columns = ["repo", "path", "kind", "description", "tags", "snippet"]
        assert values(scans[0], *columns) == values(scans[1], *columns)
    assert tree_source.scan_tree(spark, big, headers=True).agg(F.max(F.length("content"))).first()[0] <= tree_source.HEADER_BYTES


def test_conditions_on_path_reach_the_tasks(spark, folder):
    every = tree_source.scan_tree(spark, folder)
    paths = [r.path for r in every.select("path").collect()]
    for condition in (
        F.col("path").startswith("project/src1/"), F.col("path").endswith(".py"), F.col("path") == paths[3], F.col("path").isin(paths[:4]),
        F.col("path").startswith(paths[0][:15]) & F.col("path").endswith(".md"), F.col("path").startswith("other/"),
    ):
        got = tree_source.scan_tree(spark, folder).filter(condition)
        assert values(got, "path", "content") == values(every.filter(condition), "path", "content")
    reader = tree_source.TreeReader(folder, False, 1)
    list(reader.pushFilters([tree_source.StringStartsWith(("path",), "project/src1/")]))
    opened = [p.path for p in reader.partitions() if p.path != folder]
    assert opened and all("/src1" in p for p in opened)


def test_an_empty_tree(spark, tmp_path):
    assert tree_source.scan_tree(spark, str(tmp_path)).count() == 0


def test_partitions_depend_on_tasks_and_not_on_directories(tmp_path):
    for i in range(500):
        (tmp_path / "t" / f"n{i}").mkdir(parents=True)
        (tmp_path / "t" / f"n{i}" / "f.py").write_text("x")
    reader = tree_source.TreeReader(str(tmp_path / "t"), False, 2)
    parts = reader.partitions()
    assert len(parts) <= tree_source.SHARES * 2
    assert sorted(row[1] for part in parts for row in reader.read(part)) == sorted(f"t/n{i}/f.py" for i in range(500))


def test_everything_takes_names_that_a_walk_passes_over(spark, tmp_path):
    rows = [("node_modules/a.js", "a"), (".x/b", "bé"), ("_c/.d", ""), ("e.py", "e")]
    tree_sink.write_files(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "t"))
    found = tree_source.scan_tree(spark, str(tmp_path / "t"), everything=True)
    assert values(found, "path", "size", "content") == sorted((f"t/{p}", len(c.encode()), c) for p, c in rows)
    assert values(tree_source.scan_tree(spark, str(tmp_path / "t")), "path") == [("t/e.py",)]
