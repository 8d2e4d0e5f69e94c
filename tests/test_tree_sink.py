"""Files on disk: written whole or not at all, and marks put in, replaced, merged and taken out again."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import values
from repoloom.operators import marks
from repoloom.sources import corpus, tree_sink

FILES = "path string, content string"


def on_disk(folder):
    found = {}
    for at, _, names in os.walk(folder):
        for name in names:
            if not name.endswith(".crc"):
                with open(os.path.join(at, name), encoding="utf-8", newline="") as file:
                    found[os.path.relpath(os.path.join(at, name), folder)] = file.read()
    return found


def leftovers(tmp_path):
    return [x for x in os.listdir(tmp_path) if "staging" in x]


def test_written_replaced_and_left_alone(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"a/{i % 3}/f {i} [é#%].py", f"text {i}\r\n") for i in range(40)] + [("b.txt", None), (None, "x"), ("c/.x", "")]
    assert tree_sink.write_files(spark.createDataFrame(rows, FILES).repartition(7), folder) == 42
    want = {p: c or "" for p, c in rows if p}
    assert on_disk(folder) == want
    more = [("b.txt", "new"), ("d/e", "é🙂")]
    assert tree_sink.write_files(spark.createDataFrame(more, FILES), "file://" + folder) == 2
    assert on_disk(folder) == want | dict(more)
    assert tree_sink.write_files(spark.createDataFrame([], FILES), folder) == 0
    assert on_disk(folder) == want | dict(more) and not leftovers(tmp_path)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    tree_sink.write_files(spark.createDataFrame([("a", "old"), ("b", "old")], FILES), folder)
    rows = spark.range(200).repartition(8).select(
        F.concat(F.lit("a/"), F.col("id")).alias("p"), F.lit("new").alias("content"), "id"
    )
    broken = rows.withColumn("path", F.when(F.col("id") == 150, F.raise_error(F.lit("broken row"))).otherwise(F.col("p")))
    with pytest.raises(Exception, match="broken row"):
        tree_sink.write_files(broken, folder)
    assert on_disk(folder) == {"a": "old", "b": "old"} and not leftovers(tmp_path)


def scanned(spark, folder):
    return corpus.scan_corpus(spark, [folder]).select("repo", "path", "content")


def rewrite(spark, folder, files, column):
    """Writes a column of scanned files back in place."""
    inside = F.regexp_replace("path", "^[^/]*/", "")
    rows = corpus.with_target(files.withColumn("content", F.col(column)).withColumn("path", inside), in_place=True)
    return tree_sink.write_files(rows.select(F.col("target").alias("path"), "content"), folder)


def test_replace_and_merge_cycles(spark, tmp_path):
    """Tutor marks are replaced by minimal ones; other marks are merged in; all go, and the code is as it was."""
    folder = str(tmp_path / "project")
    code = "def run(x):\n    # keep me\n    return x\n"
    marked = "# ᚲ [tutor] one\n" + code.replace("    return", "    # ᚲ [tutor] two\n    return") + "# ᚲ [tutor] three\n# ᚲ [tutor] four\n"
    tree_sink.write_files(spark.createDataFrame([("src/run.py", marked), ("src/plain.py", code)], FILES), folder)
    counted = lambda: values(
        scanned(spark, folder).select("path", marks.count_marks_expr(F.col("content")).alias("n"))
    )
    assert counted() == [("project/src/plain.py", 0), ("project/src/run.py", 4)]

    ready = marks.apply_strategy(scanned(spark, folder), "replace")
    anew = F.when(F.endswith("path", F.lit("run.py")), F.concat(F.lit("# ᚲ [minimal] a\n"), "content", F.lit("# ᚲ [minimal] b\n")))
    rewrite(spark, folder, ready.withColumn("new", F.coalesce(anew, F.col("content"))), "new")
    assert counted() == [("project/src/plain.py", 0), ("project/src/run.py", 2)]

    ready = marks.apply_strategy(scanned(spark, folder), "merge")
    rewrite(spark, folder, ready.withColumn("new", F.concat("content", F.lit("# ᚲ [tutor] more\n"))), "new")
    assert counted() == [("project/src/plain.py", 1), ("project/src/run.py", 3)]
    rewrite(spark, folder, marks.strip_marks_by_mode(scanned(spark, folder), "tutor"), "stripped")
    assert values(marks.detect_modes(scanned(spark, folder)), "path", "modes") == [
        ("project/src/plain.py", []), ("project/src/run.py", ["minimal"])]
    rewrite(spark, folder, marks.strip_marks(scanned(spark, folder)), "stripped")
    assert on_disk(folder) == {"src/run.py": code, "src/plain.py": code}


def test_staging_holds_no_directories_of_the_tree(spark, tmp_path, monkeypatch):
    """What is removed at the end doesn't grow with the tree's directories, one for each file here."""
    left, real = [], tree_sink.remove

    def counted(folder):
        left.extend(os.path.join(at, d) for at, dirs, _ in os.walk(folder) for d in dirs)
        real(folder)

    monkeypatch.setattr(tree_sink, "remove", counted)
    rows = [(f"a/n{i}/f\n{i}", f"text {i}") for i in range(2500)]
    assert tree_sink.write_files(spark.createDataFrame(rows, FILES).coalesce(1), str(tmp_path / "out")) == 2500
    assert on_disk(str(tmp_path / "out")) == dict(rows)
    assert len(left) == 4 and not leftovers(tmp_path)
