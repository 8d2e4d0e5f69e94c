"""Nested catalogue documents: out, back, and as any JSON reader sees them."""

import json
import random

from pyspark.sql import functions as F

from conftest import values
from repoloom.sources import catalogue, documents

KIND = (
    "repo string, path string, parent_path string, name string, kind string, depth int, description string,"
    " tags array<string>, snippet string"
)
MANIFEST = "repo string, basePath string, readme string, hasSnippets boolean"


def some_nodes(rng, repo, n):
    names = ["a", "B", "b", 'quo"te', "back\\slash", "new\nline", "é🙂", "z.py", "\t"]
    kinds = {repo: "dir"}
    for _ in range(n):
        at = repo
        for _ in range(rng.randrange(6)):
            at += "/" + rng.choice(names)
            if kinds.setdefault(at, "dir") == "file":
                break
        else:
            kinds.setdefault(at + "/" + rng.choice(names) + "!", "file")
    rows = []
    for path, kind in kinds.items():
        name = path.rpartition("/")[2]
        parent = path.rpartition("/")[0] or None
        description = rng.choice([None, "what it does", 'says "hi"\n'])
        tags = rng.choice([[], ["x"], ["y", 'q"']]) if kind == "file" else []
        snippet = rng.choice([None, "code\n\tmore"]) if kind == "file" else None
        rows.append((repo, path, parent, name, kind, path.count("/"), description, tags, snippet))
    return rows


def nested(rows):
    """The tree of a repo, built by recursion."""
    kids = {}
    for r in rows:
        kids.setdefault(r[2], []).append(r)

    def build(r):
        out = {"name": r[3]} | ({"description": r[6]} if r[6] is not None else {})
        own = sorted(kids.get(r[1], []), key=lambda x: (x[3].lower(), x[3]))
        files = [{"name": x[3], "purpose": x[6] if x[6] is not None else "—", "tags": x[7]} for x in own if x[4] == "file"]
        dirs = [build(x) for x in own if x[4] == "dir"]
        return out | ({"files": files} if files else {}) | ({"children": dirs} if dirs else {})

    return build(kids[None][0])


def test_documents_and_back(spark, tmp_path):
    rng = random.Random(9)
    by_repo = {f"r{i}": some_nodes(rng, f"r{i}", n) for i, n in enumerate([0, 1, 8, 60])}
    rows = [r for own in by_repo.values() for r in own]
    nodes = spark.createDataFrame(rows, KIND).repartition(4)
    beside = [(r, "/x", 'read "me"\n', i % 2 == 0) for i, r in enumerate(by_repo) if r != "r1"]
    lines = documents.document_lines(nodes, spark.createDataFrame(beside, MANIFEST))
    bodies = {r.repo: json.loads(r.body) for r in documents.documents(lines).collect()}
    for i, (repo, own) in enumerate(by_repo.items()):
        assert bodies[repo]["tree"] == nested(own)
        assert bodies[repo].get("snippets", {}) == {r[1]: r[8] for r in own if r[8] is not None}
        assert ("snippets" in bodies[repo]) == any(r[8] is not None for r in own)
        assert bodies[repo].get("readme") == (None if repo == "r1" else 'read "me"\n')

    documents.write_documents(lines, str(tmp_path / "out"))
    found = documents.read_documents(spark, str(tmp_path / "out"))
    assert {r.repo: json.loads(r.body) for r in found.collect()} == bodies
    back = catalogue.import_catalogue(found, repo="repo")
    back = catalogue.attach_snippets(back, catalogue.import_snippets(found, repo="repo"))
    columns = ["repo", "path", "parent_path", "name", "kind", "depth", "description", "tags", "snippet"]
    assert values(back, *columns) == values(nodes, *columns)


def test_several_roots_repeated_paths_and_numbers_as_names(spark, tmp_path):
    rows = [
        ("007", "a", None, "a", "dir", 0, None, [], None),
        ("007", "a/f.py", "a", "f.py", "file", 1, "one", [], "s1"),
        ("007", "a/f.py", "a", "f.py", "file", 1, "two", ["t"], "s2"),
        ("007", "b", None, "b", "dir", 0, "other", [], None),
    ]
    nodes = spark.createDataFrame(rows, KIND)
    lines = documents.document_lines(nodes, spark.createDataFrame([], MANIFEST))
    documents.write_documents(lines, str(tmp_path / "out"))
    got = documents.read_documents(spark, str(tmp_path / "out")).collect()
    assert {r.repo for r in got} == {"007"}
    bodies = sorted((json.loads(r.body) for r in got), key=lambda x: x["tree"]["name"])
    assert [x["purpose"] for x in bodies[0]["tree"]["files"]] == ["one", "two"]
    assert bodies[0]["snippets"] == {"a/f.py": "s2"}
    assert bodies[1] == {"tree": {"name": "b", "description": "other"}}


def test_no_nodes(spark):
    lines = documents.document_lines(spark.createDataFrame([], KIND), spark.createDataFrame([], MANIFEST))
    assert documents.documents(lines).count() == 0 and lines.filter(F.col("line").isNull()).count() == 0
