"""A watched tree over several snapshots."""

import os
import shutil

from conftest import values
from repoloom.operators import marks
from repoloom.streaming import catalogue as streams
from repoloom.streaming import watch

MARK = "# ᚲ [tutor] {}\n"


def write(folder, path, text):
    target = os.path.join(folder, path)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "w", encoding="utf-8") as file:
        file.write(text)


def test_only_new_and_changed_files(spark, tmp_path):
    folder, target = str(tmp_path / "project"), str(tmp_path / "out")

    def seen(before):
        """Marks that the stream adds for the present tree."""
        stream = watch.watch_tree(spark, folder, settle=0)
        streams.stream_marks(stream, target, str(tmp_path / "checkpoint")).awaitTermination()
        every = values(spark.read.parquet(target), "path", "body")
        return sorted(set(every) - set(before)), every

    os.makedirs(folder)
    write(folder, "top.py", MARK.format("one"))
    write(folder, "src/deep/er/a.py", MARK.format("a") + "x = 1\n" + MARK.format("b"))
    write(folder, "src/plain.py", "x = 1\n")
    write(folder, "node_modules/pkg/m.js", "// ᚲ [tutor] no\n")
    write(folder, ".hidden/h.py", MARK.format("no"))
    write(folder, ".github/w.yaml", MARK.format("kept"))
    fresh, every = seen([])
    assert fresh == [
        ("project/.github/w.yaml", "kept"), ("project/src/deep/er/a.py", "a"), ("project/src/deep/er/a.py", "b"), ("project/top.py", "one"),
    ]
    assert seen(every) == ([], every)

    write(folder, "top.py", MARK.format("changed"))
    write(folder, "lib/new é.py", MARK.format("new"))
    shutil.rmtree(os.path.join(folder, "src"))
    fresh, every = seen(every)
    assert fresh == [("project/lib/new é.py", "new"), ("project/top.py", "changed")]

    write(folder, "lib/sub/last.py", MARK.format("last"))
    write(folder, "node_modules/pkg/m.js", "// ᚲ [tutor] still not\n")
    fresh, every = seen(every)
    assert fresh == [("project/lib/sub/last.py", "last")]
    assert len(every) == 7


def test_a_stream_over_snapshots_is_the_batch_over_their_changes(spark, tmp_path):
    folder = str(tmp_path / "project")
    texts = {}
    want = []
    for step in range(3):
        for i in range(12):
            if i % (step + 1) == 0:
                path = f"d{i % 3}/f{i}.py"
                texts[path] = MARK.format(f"{step}-{i}") + "# plain\n"
                write(folder, path, texts[path])
                want.append(("project", f"project/{path}", texts[path]))
        stream = watch.watch_tree(spark, "file://" + folder, settle=0)
        streams.stream_marks(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    batch = marks.extract_marks(spark.createDataFrame(want, "repo string, path string, content string"))
    columns = ["repo", "path", "line_no", "mode", "body"]
    assert values(spark.read.parquet(str(tmp_path / "out")), *columns) == values(batch, *columns)


def test_an_empty_or_missing_tree(spark, tmp_path):
    stream = watch.watch_tree(spark, str(tmp_path / "nowhere"), settle=0)
    streams.stream_marks(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.schema("path string").parquet(str(tmp_path / "out")).count() == 0
