"""Sources on inputs of odd shape: deep documents and listings, any file name, strict JSON."""

import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import values
from repoloom.functions import fixed_values as fv
from repoloom.functions import rules
from repoloom.operators import filters, marks, requests
from repoloom.sources import catalogue, corpus, tree_listing


def nested(levels):
    tree = {"name": f"d{levels - 1}", "files": [{"name": "leaf {\"}.md", "purpose": "a \\\" brace {{{"}]}
    for level in reversed(range(levels - 1)):
        tree = {"name": f"d{level}", "children": [tree], "files": [{"name": f"f{level}", "tags": ["x"]}]}
    return tree


@pytest.mark.parametrize("levels", [1, 3, 18, 40, 120])
def test_catalogues_of_any_depth_lose_no_row(spark, levels):
    body = json.dumps({"tree": nested(levels)})
    nodes = catalogue.import_catalogue(spark.createDataFrame([(1, body)], "repo_id int, body string"))
    assert nodes.count() == 2 * levels
    rows = {r["path"]: r for r in nodes.collect()}
    assert len(rows) == 2 * levels
    deepest = "/".join(f"d{i}" for i in range(levels))
    assert rows[f"{deepest}/leaf {{\"}}.md"]["kind"] == "file" and rows[deepest]["depth"] == levels - 1


def test_nameless_entries_are_left_out(spark):
    tree = {"name": "r", "children": [{"files": [{"name": "lost"}]}, {"name": "d"}], "files": [{}, {"name": "f"}]}
    nodes = catalogue.import_catalogue(spark.createDataFrame([(1, json.dumps(tree))], "repo_id int, body string"))
    assert values(nodes, "path") == [("r",), ("r/d",), ("r/f",)]


def drawn(levels):
    return "\n".join(["root", *("    " * i + f"└── d{i}" for i in range(levels))])


@pytest.mark.parametrize("levels", [1, 60, 400, 2000])
def test_listings_of_any_depth(spark, levels):
    df = spark.createDataFrame([(1, drawn(levels)), (2, "top\n└── one.py")], "listing_id int, text string")
    nodes = tree_listing.import_tree_listing(df)
    got = nodes.filter("repo = '1'").agg(F.count("*"), F.max("depth"), F.count_if(F.col("kind") == "file")).first()
    assert tuple(got) == (levels + 1, levels, 1)
    assert values(nodes.filter("repo = '2'"), "path", "kind") == [("top", "dir"), ("top/one.py", "file")]


def test_listing_plans_neither_shuffle_nor_run_jobs(spark):
    df = spark.createDataFrame([(1, drawn(5))], "listing_id int, text string")
    before = jobs(spark)
    plan = tree_listing.import_tree_listing(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and jobs(spark) == before


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


NAMES = ["[id]/page.tsx", "a b/c d.py", "é/ü.js", "p%41/q.go", "h#x/y.rb", "w?z/v.py", "style/main.css", "x.pl"]


def test_scan_takes_any_file_name(spark, tmp_path):
    for root in ("one/shop", "two/shop"):
        for name in NAMES:
            target = tmp_path / root / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(f"/* {fv.MARKER} [tutor] {root} {name} */\nmore than ten bytes\n")
    roots = [f"file://{tmp_path}/one/shop", f"{tmp_path}/two/shop"]
    files = corpus.scan_corpus(spark, roots).cache()
    got = {r["path"]: r["content"] for r in files.collect()}
    assert set(got) == {f"{repo}/{name}" for repo in ("shop", "shop-2") for name in NAMES}
    for path, content in got.items():
        root = "two/shop" if path.startswith("shop-2/") else "one/shop"
        assert content.split("\n")[0] == f"/* {fv.MARKER} [tutor] {root} {path.split('/', 1)[1]} */"
    assert filters.annotatable(files).count() == 2 * len(NAMES)
    assert values(marks.erase_report(files), "repo", "files_cleaned") == [
        ("shop", len(NAMES)), ("shop-2", len(NAMES))]


def test_scan_for_annotation_enters_what_it_walks(spark, tmp_path):
    target = tmp_path / "repo" / "htmlcov" / "a.js"
    target.parent.mkdir(parents=True)
    target.write_text("let a = 1;")
    assert corpus.scan_corpus(spark, [str(tmp_path / "repo")]).count() == 0
    walked = corpus.scan_corpus(spark, [str(tmp_path / "repo")], excludes=fv.ANNOTATION_EXCLUDED_DIRS)
    assert values(walked, "path", "content") == [("repo/htmlcov/a.js", "let a = 1;")]


def test_a_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        corpus.scan_corpus(spark, [f"{tmp_path}/nowhere"]).count()


def counted_jobs(spark, run):
    context = spark.sparkContext
    group = f"counted-{uuid.uuid4().hex}"
    context.setJobGroup(group, group)
    try:
        run()
        return len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_scan_do_not_follow_the_depth(spark, tmp_path):
    found, at = [], tmp_path / "deep"
    for i in range(60):
        at = at / f"d{i}"
        at.mkdir(parents=True)
        (at / "f.py").write_text(f"# {i} more than ten bytes\n")
    number = counted_jobs(spark, lambda: found.append(corpus.scan_corpus(spark, [str(tmp_path / "deep")])))
    assert number <= 10
    want = [("deep/" + "".join(f"d{k}/" for k in range(i + 1)) + "f.py", f"# {i} more than ten bytes\n") for i in range(60)]
    assert values(found[0], "path", "content") == sorted(want, key=repr)


@pytest.mark.parametrize("budget", [1, 3, 1000])
def test_every_file_once_however_far_a_task_walks(spark, tmp_path, monkeypatch, budget):
    monkeypatch.setattr(corpus, "DIRS_PER_TASK", budget)
    want = []
    for i in range(40):
        for below in ("", "a/", "a/b/", "node_modules/", ".git/", ".github/", "a/x+y/", "a/xxy/"):
            target = tmp_path / "t" / f"n{i % 3}" / f"m{i}" / below / "f.py"
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(f"{i} {below}")
            if below not in ("node_modules/", ".git/", "a/x+y/"):
                want.append((f"t/n{i % 3}/m{i}/{below}f.py", f"{i} {below}"))
    scanned = corpus.scan_corpus(spark, [str(tmp_path / "t")], ["x+y"])
    assert values(scanned, "path", "content") == sorted(want, key=repr)


def test_small_directories_share_a_batch(tmp_path):
    for i in range(300):
        (tmp_path / "t" / f"n{i}").mkdir(parents=True)
        (tmp_path / "t" / f"n{i}" / "f.py").write_text("x")
    listing = corpus._listing(rules.excluded_in_tasks(fv.EXCLUDED_NAMES, fv.KEPT_DOT_NAMES), 1)
    root = corpus._batch([("t", "t", str(tmp_path / "t"), None, True, 0)], corpus._ENTRY)
    (level,) = listing(iter([root]))
    assert level.num_rows == 300 and all(r["is_dir"] for r in level.to_pylist())
    (files,) = listing(iter([level]))
    assert sorted(r["path"] for r in files.to_pylist()) == sorted(f"t/n{i}/f.py" for i in range(300))


def test_tasks_leave_out_what_the_rule_on_columns_leaves_out(spark):
    names = ["node_modules", "*.egg-info", "a.b", "\\E(", "x/y", "é"]
    paths = [f"r/{p}" for n in [*names, "axb", "a.bc", ".github", ".githubs", ".env.example", ".x", "_x", "x\ny", "é\n", "x"]
             for p in (n, f"d/{n}", f"{n}/f.py", f"z{n}", f"{n}\n")]
    for kept in (fv.KEPT_DOT_NAMES, []):
        pattern = re.compile(rules.excluded_in_tasks(names, kept))
        frame = spark.createDataFrame([(p,) for p in paths], "path string")
        want = values(frame.select("path", rules.excluded("path", names, kept).alias("out")))
        assert sorted(((p, bool(pattern.search(p))) for p in paths), key=repr) == want


BODIES = [
    ("{'a': 'x'}", None),
    ('{"a": "x", "b": "z", "a": "y"}', {"a": "y", "b": "z"}),
    ('{"a": "x"} trailing', None),
    ('{"a": "x" /* c */}', None),
    ('{"a": 01}', None),
    ('{a: "x"}', None),
    ('["a"]', None),
    ('```json\n{"a": "x\\ny"}\n```', {"a": "x\ny"}),
    ("{}", {}),
]


def test_responses_are_strict_json(spark):
    rows = [(i, body) for i, (body, _) in enumerate(BODIES)]
    df = spark.createDataFrame(rows, "batch_id int, body string")
    parsed = {}
    for r in requests.parse_responses(df).collect():
        assert r["path"] not in parsed.setdefault(r["batch_id"], {})
        parsed[r["batch_id"]][r["path"]] = r["description"]
    outcomes = {r["batch_id"]: r for r in requests.batch_outcomes(df).collect()}
    for i, (_, want) in enumerate(BODIES):
        assert parsed.get(i, {}) == (want or {})
        assert outcomes[i]["status"] == ("failed" if want is None else "parsed")
        assert outcomes[i]["descriptions"] == len(want or {})
