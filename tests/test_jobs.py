"""Requests and responses, releases, streams, files on disk."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, values
from repoloom.operators import readme, release, requests
from repoloom.plans import catalogue, fixtures, queries
from repoloom.sources import catalogue as catalogue_source
from repoloom.sources import corpus
from repoloom.streaming import catalogue as streams


# --- requests ----------------------------------------------------------------

def some_nodes(spark, n, snippet=None):
    rows = [("r", f"r/f{i:03d}.py", snippet if i == 0 else None) for i in range(n)] + [("q", "q/a", None)]
    return spark.createDataFrame(rows, "repo string, path string, snippet string")


@pytest.mark.parametrize("snippet,size,batches", [(None, 30, 2), ("code", 30, 3), ("code", 10, 5), (None, 7, 8)])
def test_batches(spark, snippet, size, batches):
    got = requests.batch_paths(some_nodes(spark, 50, snippet), size).filter("repo = 'r'")
    per_batch = got.groupBy("batch_id").agg(F.min("path"), F.max("path"), F.count("*").alias("n")).orderBy("batch_id").collect()
    assert len(per_batch) == batches
    effective = min(size, 20) if snippet else size
    assert [r["n"] for r in per_batch[:-1]] == [effective] * (batches - 1)
    assert all(a[2] < b[1] for a, b in zip(per_batch, per_batch[1:]))


def test_prompts(spark):
    nodes = spark.createDataFrame(
        [("r", "r/b.py", "1\n2\n3\n4\n5\n6\n7"), ("r", "r/a", None), ("q", "q/x", None)],
        "repo string, path string, snippet string")
    readmes = spark.createDataFrame([("r", "R" * 2000), ("q", "")], "repo string, readme string")
    rows = {r["repo"]: r for r in requests.build_requests(requests.batch_paths(nodes), readmes, "technical").collect()}
    prompt = rows["r"]["prompt"]
    assert rows["r"]["paths"] == 2
    assert "Paths:\nr/a\nr/b.py\n  | 1\n  | 2\n  | 3\n  | 4\n  | 5\n  | 6\n\n" in prompt and "| 7" not in prompt
    assert " Project context: " + "R" * 1500 + "\n" in prompt
    assert "Project context" not in rows["q"]["prompt"]
    assert rows["q"]["prompt"].startswith(requests.DESCRIBE_STYLES["technical"])
    example = prompt.split("Example: ")[1]
    assert len(json.loads(example)) == 1
    with pytest.raises(ValueError):
        requests.build_requests(requests.batch_paths(nodes), readmes, "poetic")


BODIES = [
    (1, '```json\n{"a": "one", "b": "two"}\n```'), (2, '{"a": "newer", "a": "newest"}'), (3, "{broken"),
    (4, '{"c": "x"} and more'), (5, "[1, 2]"), (6, "{}"), (7, ""), (8, '{"d": "", "e": null, "f": 5}'),
    (9, '{"g": "1"}, {"h": "2"}'),
]


def test_responses(spark):
    df = spark.createDataFrame(BODIES, "batch_id int, body string")
    parsed = requests.parse_responses(df)
    assert values(parsed, "batch_id", "path", "description") == sorted([
        (1, "a", "one"), (1, "b", "two"), (2, "a", "newest"), (8, "d", ""), (8, "e", None), (8, "f", "5"),
    ], key=repr)
    merged = requests.merge_descriptions(parsed)
    assert dict(values(merged))["a"] == "newest"
    assert values(requests.batch_outcomes(df)) == [
        (1, "parsed", 2), (2, "parsed", 1), (3, "failed", 0), (4, "failed", 0), (5, "failed", 0), (6, "parsed", 0),
        (7, "failed", 0), (8, "parsed", 3), (9, "failed", 0)]


def test_apply_descriptions(spark):
    nodes = spark.createDataFrame(
        [("r", "a", "old", "heuristic"), ("r", "b", None, None), ("r", "d", "kept", "heuristic")],
        "repo string, path string, description string, description_source string")
    found = spark.createDataFrame(
        [("r", "a", "new"), ("r", "d", ""), ("r", "zzz", "nobody")], "repo string, path string, description string")
    got = requests.apply_descriptions(nodes, found)
    assert values(got, "path", "description", "description_source", "applied") == [
        ("a", "new", "model", True), ("b", None, None, False), ("d", "kept", "heuristic", False)]


def test_annotation_requests(spark):
    text = "// ᚲ [tutor] old\nlet {language} = '{code}';\n"
    df = spark.createDataFrame(
        [("r", "r/a.ts", text), ("r", "r/b.md", text), ("r", "r/c.ts", "tiny")], "repo string, path string, content string")
    rows = requests.annotation_requests(df, "technical").collect()
    assert [(r["path"], r["language"]) for r in rows] == [("r/a.ts", "TypeScript")]
    prompt = rows[0]["prompt"]
    assert prompt.endswith("File: a.ts\n\nlet {language} = '{code}';\n")
    assert "ᚲ [technical]" in prompt and "ᚲ [tutor]" not in prompt and "TypeScript file" in prompt
    kept = requests.annotation_requests(df, "minimal", "merge").first()["prompt"]
    assert kept.endswith(text)
    with pytest.raises(ValueError):
        requests.annotation_requests(df, "loud")
    for mode in requests.ANNOTATE_ROLES:
        assert f"ᚲ [{mode}]" in requests.annotation_requests(df, mode).first()["prompt"]


def test_readme_choice(spark):
    df = spark.createDataFrame(
        [("r", "r/readme.md", "low"), ("r", "r/README.md", "R" * 4000), ("r", "r/docs/README.md", "no"),
         ("q", "q/Readme.md", "cap"), ("p", "p/x.py", "x")], "repo string, path string, content string")
    assert values(readme.readme_context(df)) == [("p", ""), ("q", "cap"), ("r", "R" * 3000)]


# --- releases ----------------------------------------------------------------

COMMITS = [
    ("a", 1, "h1", "feat: add cart", ""),
    ("a", 2, "h2", "fix(api)!: Drop v1", ""),
    ("a", 3, "h3", "merge branch x", ""),
    ("a", 4, "h4", "wip: later", "BREAKING CHANGE: gone"),
    ("b", 1, "h5", "Chore(a:b): nested scope", ""),
    ("b", 2, "h6", "feat(a:b)!: nested", ""),
    ("c", 1, "h7", "revert: thing again", ""),
    ("c", 2, "h8", "docs():  spaced out ", "x\nBREAKING-CHANGE: hyphen"),
    ("d", 1, "h9", "no type", ""),
    ("e", 1, "h10", "style:ok", None),
]


@pytest.fixture(scope="module")
def commits(spark):
    return spark.createDataFrame(COMMITS, "repo string, ts int, hash string, subject string, body string").cache()


def test_parse_commits(commits):
    assert values(release.parse_commits(commits), "hash", "type", "scope", "breaking", "description") == sorted([
        ("h1", "feat", None, False, "add cart"), ("h2", "fix", "api", True, "Drop v1"), ("h4", "wip", None, False, "later"),
        ("h5", "chore", "a:b", False, "nested scope"), ("h6", "feat", "a:b", True, "nested"),
        ("h7", "revert", None, False, "thing again"), ("h8", "docs", None, False, "spaced out"), ("h10", "style", None, False, "ok"),
    ], key=repr)


def test_validation(commits):
    assert values(release.validate_commits(commits), "hash", "error", "detail") == sorted([
        ("h2", "upper_case", "D"), ("h3", "format", "expected type(scope): description"), ("h4", "unknown_type", "wip"),
        ("h9", "format", "expected type(scope): description"), ("h10", "too_short", "2"),
    ], key=repr)
    verdicts = {r["repo"]: (r["commits"], r["problems"], r["valid"]) for r in release.commit_verdicts(commits).collect()}
    assert verdicts == {"a": (4, 3, False), "b": (2, 0, True), "c": (2, 0, True), "d": (1, 1, False), "e": (1, 1, False)}
    # Text after the first colon, even inside a scope.
    nested = commits.filter("hash = 'h6'").withColumn("subject", F.lit("feat(a:B)!: nested"))
    assert values(release.validate_commits(nested), "error") == [("upper_case",)]


def test_bumps_and_versions(spark, commits):
    assert dict(values(release.bump_type(commits))) == {"a": "major", "b": "major", "c": "major", "d": None, "e": "patch"}
    tags = spark.createDataFrame(
        [("a", "v1.2.3", 2), ("a", "v1.0.0", 1), ("a", "nightly", 9), ("e", "v0.9.9", 0), ("b", "v2.3.4", 1), ("z", "v1.0.0", 1)],
        "repo string, version string, ts int")
    assert {r["hash"] for r in release.commits_since_release(commits, tags).collect()} == {
        "h3", "h4", "h6", "h7", "h8", "h9", "h10"}
    assert values(release.next_versions(commits, tags)) == [
        ("a", "v1.2.3", "major", "2.0.0"), ("b", "v2.3.4", "major", "3.0.0"), ("e", "v0.9.9", "patch", "0.9.10"),
        ("z", "v1.0.0", None, None)]
    df = spark.createDataFrame([("1.2.3", "minor"), ("1.2.3", "patch"), ("1.2.3", None)], "v string, b string")
    got = [r[0] for r in df.select(release.next_version_expr(F.col("v"), F.col("b"))).collect()]
    assert got == ["1.3.0", "1.2.4", None]
    assert values(release.last_commits(commits, 1), "hash") == [("h10",), ("h4",), ("h6",), ("h8",), ("h9",)]


def test_changelog(spark, commits):
    rows = release.changelog_entries(commits)
    assert values(rows.filter("repo = 'a'"), "section", "entry_rank", "line") == [
        ("Features", 1, "- add cart (h1)"), ("Fixes", 1, "- **api**: Drop v1 (h2)"), ("Other", 1, "- later (h4)")]
    assert values(release.breaking_notes(commits), "hash", "note") == [
        ("h2", "Drop v1 (BREAKING)"), ("h4", "BREAKING CHANGE: gone"), ("h6", "nested (BREAKING)")]
    assert values(release.whats_new(commits), "hash") == [("h1",), ("h2",), ("h6",)]
    versions = spark.createDataFrame([("a", "2.0.0")], "repo string, version string")
    text = release.changelog_text(commits.filter("repo = 'a'"), versions, "2024-02-01")
    lines = [r["line"] for r in text.orderBy("repo", "part", "section_rank", "line_no").collect()]
    assert lines == [
        "## 2.0.0 — 2024-02-01", "### BREAKING CHANGES", "- BREAKING CHANGE: gone", "- Drop v1 (BREAKING)",
        "### Features", "- add cart (h1)", "### Fixes", "- **api**: Drop v1 (h2)", "### Other", "- later (h4)"]


# --- streams -----------------------------------------------------------------

def test_streams_equal_batch(spark):
    for stream, batch in (("w2_stream_marks", "m1_extract_marks"), ("w2_stream_tags", "p5_merge_tags")):
        streamed = queries.QUERIES[stream](spark, SMALL)
        columns = [c for c in streamed.columns if c != "purpose"]
        assert values(streamed, *columns) == values(queries.QUERIES[batch](spark, SMALL), *columns)


def test_catalogue_stream_over_several_batches(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "cp"))
    schema = "repo string, version long, body string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        streams.stream_catalogue(df, log, checkpoint).awaitTermination()
        return dict(values(streams.current_catalogues(spark, log), "repo", "version"))

    good = '{"tree": {"name": "x"}}'
    arrive(("a", 1, good), ("b", 1, good), ("c", 1, "{broken"))
    arrive(("a", 2, "{broken"), ("b", 2, good), ("b", 3, good))
    assert run() == {"a": 1, "b": 3}
    arrive(("a", 4, good), ("b", 2, good), ("c", 5, '{"no": "tree"}'))
    assert run() == {"a": 4, "b": 3}
    # Nothing new arrives: the state stays.
    assert run() == {"a": 4, "b": 3}


# --- files on disk -----------------------------------------------------------

def write(root: pathlib.Path, files: dict):
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_scan_of_a_directory(spark, tmp_path):
    root = tmp_path / "shop"
    write(root, {
        "README.md": "# Shop", "src/main.py": "import torch\n", "src/__init__.py": "", "src/__tests__/a.test.js": "x",
        ".github/ci.yml": "on: push", ".env": "SECRET=1", "node_modules/m/index.js": "no", "src/logo.png": b"\x89PNG\xff",
        "bad.py": b"# caf\xe9\n", "a/b/c/d/deep.go": "package d", "tmp/x.py": "y", "empty/.keep": "",
    })
    (root / "src" / "loop").symlink_to(root, target_is_directory=True)
    (root / "link.py").symlink_to(root / "bad.py")
    files = corpus.scan_corpus(spark, [f"file://{root}"], ["tmp"])
    got = {r["path"]: r["content"] for r in files.collect()}
    assert got == {
        "shop/README.md": "# Shop", "shop/src/main.py": "import torch\n", "shop/src/__init__.py": "",
        "shop/src/__tests__/a.test.js": "x", "shop/.github/ci.yml": None, "shop/src/logo.png": None,
        "shop/bad.py": "# caf�\n", "shop/a/b/c/d/deep.go": "package d",
    }
    names_only = corpus.scan_corpus(spark, [f"file://{root}"], ["tmp"], scan_headers=False)
    assert {r["path"] for r in names_only.collect()} == set(got)
    nodes = catalogue.scan(files, ["tmp"])
    found = {r["path"]: r for r in nodes.collect()}
    assert found["shop/src/main.py"]["tags"] == ["python", "ai"]
    assert found["shop"]["description"] == "Project root" and found["shop/src"]["kind"] == "dir"
    assert "shop/empty" not in found


def test_export_and_import_again(spark, tmp_path):
    files = fixtures.files(spark, SMALL).filter("doc_id < 40")
    nodes = catalogue.scan(files)
    manifest = catalogue_source.manifest(nodes, files, "/srv", "2024-01-01T00:00:00Z")
    target = str(tmp_path / "out")
    catalogue_source.export_catalogue(nodes, manifest, target)
    tree = spark.read.json(f"{target}/tree")
    assert "snippet" not in tree.columns
    assert tree.count() == nodes.count()
    assert tree.filter("kind = 'file' and description is null").count() == 0
    snippets = spark.read.json(f"{target}/snippets")
    assert values(snippets, "path", "snippet") == values(nodes.filter("snippet is not null"), "path", "snippet")
    assert spark.read.json(f"{target}/manifest").count() == manifest.count()
    described = nodes.withColumn("description_source", F.lit("model"))
    assert {r["model"] for r in catalogue_source.manifest(described, files, "/srv", "t", "some-model").collect()} == {"some-model"}


def test_rewritten_names_and_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", "r/a/b.test.py", "x"), ("r", "r/Makefile", "y"), ("q", "q/.bashrc", "z")],
        "repo string, path string, content string")
    assert values(corpus.with_target(df), "target") == [("q/.bashrc.annotated",), ("r/Makefile.annotated",), ("r/a/b.test.annotated.py",)]
    assert values(corpus.with_target(df, in_place=True), "target") == values(df, "path")
    target = str(tmp_path / "rewritten")
    corpus.write_rewritten(df, target)
    assert values(spark.read.parquet(target), "path", "content") == values(df, "path", "content")
