"""Names, headers, import tags, filters."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values
from repoloom.functions import fixed_values as fv
from repoloom.functions import paths
from repoloom.operators import describe, filters
from repoloom.plans import catalogue

FILE = "repo string, path string, content string"


def files(spark, *rows):
    return spark.createDataFrame([("r", p, c) for p, c in rows], FILE)


def named(spark, *names):
    return files(spark, *[(f"r/{n}", "") for n in names])


def test_purposes(spark):
    expected = {
        "package.json": "Project dependencies, scripts, and metadata",
        "cart.test.tsx": "Unit tests for cart",
        "cart.spec.js": "Test spec for cart",
        "Card.stories.jsx": "Storybook stories for Card",
        "card.module.scss": "Scoped styles for card",
        "index.d.ts": "TypeScript type declarations",
        "useCart.ts": "Custom React hook: useCart",
        "useconfig.ts": "Module configuration",
        "useMyconfig.ts": "Custom React hook: useMyconfig",
        "Card.tsx": "React component: Card",
        "Card2.tsx": None,
        "Card.vue": "Vue component: Card",
        "reindex.js": "Module entry point / barrel exports",
        "types.ts": "TypeScript type definitions",
        "main.py": "Python module: main",
        "photo.jpeg": "Image asset",
        "data.json": "JSON data: data",
        "ci.yml": "YAML config: ci",
        "NOTES.md": "Documentation: NOTES",
        "unknown.xyz": None,
        "constructor": None,
    }
    got = describe.describe_files(named(spark, *expected)).select("name", "purpose").collect()
    assert {r["name"]: r["purpose"] for r in got} == expected


def test_listing_purposes_know_more(spark):
    names = ["Card.svelte", "helper.js", "migration1.ts", "seed_a.js", "notes.txt", ".env", "go.sum"]
    got = describe.describe_files(named(spark, *names), listing=True).collect()
    assert {r["name"]: r["purpose"] for r in got} == {
        "Card.svelte": "Svelte component: Card",
        "helper.js": "Helper functions",
        "migration1.ts": "Database migration",
        "seed_a.js": "Database seed data",
        "notes.txt": "Plain text file",
        ".env": "Environment variables (secrets, config values)",
        "go.sum": "Go dependency checksums",
    }


def test_directories(spark):
    df = spark.createDataFrame([("src",), ("src/api",), ("x/other",), ("x",)], "path string")
    got = describe.describe_dirs(df).collect()
    assert {r["path"]: r["description"] for r in got} == {
        "src": "Application source code", "src/api": "API routes or client code",
        "x/other": "Directory", "x": "Project root",
    }


def test_name_tags_keep_their_order(spark):
    expected = {
        "MyCONFIG.test.tsx": "test,react,config",
        "config.yaml": "config,yaml",
        "a.svelte": "svelte",
        "styles.scss": "styles",
        "a.spec.js": "test",
        "README.md": "docs",
        "query.sql": "sql",
        "lib.rs": "rust",
        "main.go": "go",
        "A.vue": "vue",
        "tests.js": "",
    }
    got = describe.name_tags(named(spark, *expected)).collect()
    assert {r["name"]: ",".join(r["name_tags"]) for r in got} == expected


@pytest.mark.parametrize(
    "name,ext",
    [("a.py", ".py"), ("A.PY", ".py"), (".bashrc", ""), ("a.", ""), ("a.b.", ""), ("x.tar.gz", ".gz"),
     ("Makefile", ""), ("..a", ".a"), (".env.example", ".example")],
)
def test_extension(spark, name, ext):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(paths.extension("name").alias("e")).first()["e"] == ext


def test_languages(spark):
    expected = {"a.py": "Python", "b.TSX": "TypeScript (React)", "c.xyz": "xyz", "Makefile": "text",
                "d.h": "C/C++ Header", "e.zsh": "Zsh"}
    got = describe.language_of(named(spark, *expected)).collect()
    assert {r["path"][2:]: r["language"] for r in got} == expected


def test_exclusion(spark):
    kept = ["r/src/a.py", "r/.github/ci.yml", "r/.env.example", "r/builder/x", "r/a/dist.js", "build/x.py"]
    dropped = ["r/node_modules/a.js", "r/a/b/dist/c.js", "r/.env", "r/.git/x", "r/.hidden/a.py", "r/.githubx/a",
               "r/a/.env.example2", "r/vendor", "r/x/Thumbs.db"]
    df = files(spark, *[(p, "") for p in kept + dropped])
    assert {r["path"] for r in filters.exclude_paths(df).collect()} == set(kept)
    more = filters.exclude_paths(df, filters.parse_name_list(" src , *.js,builder"))
    assert {r["path"] for r in more.collect()} == {"r/.github/ci.yml", "r/.env.example", "r/a/dist.js", "build/x.py"}


def test_scannable(spark):
    got = filters.scannable(named(spark, "a.py", "A.R", "yarn.lock", "a.svg", "x.css", "x.md", "README.md",
                                  "package.json", "data.json", "Dockerfile", ".gitignore", "Makefile2"))
    assert {r["path"][2:] for r in got.collect()} == {
        "a.py", "A.R", "README.md", "package.json", "Dockerfile", ".gitignore"}


def test_annotatable(spark):
    ok, small, large = "x" * 11, "x" * 10, "x" * 100000
    got = filters.annotatable(files(
        spark, ("r/a.py", ok), ("r/b.py", small), ("r/c.py", large), ("r/d.css", ok), ("r/e.md", ok),
        ("r/.github/f.py", ok), ("r/out/g.py", ok), ("r/.svn/h.py", ok), ("r/i.json", ok), ("r/out.py", ok),
        ("r/coverage.py", "é" * 6), ("r/.hidden.py", ok)))
    assert {r["path"] for r in got.collect()} == {"r/a.py", "r/d.css", "r/out.py", "r/coverage.py"}


def snippet_of(spark, text, name="a.py"):
    return describe.header_snippet(files(spark, (f"r/{name}", text))).first()["snippet"]


def test_header_snippet(spark):
    assert snippet_of(spark, "\n\n  a\r\nb\rc \n") == "a\nb\nc"
    assert snippet_of(spark, " \t\n ") is None
    assert snippet_of(spark, "x", "a.png") is None
    lines = "\n".join(str(i) for i in range(100))
    assert snippet_of(spark, lines) == "\n".join(str(i) for i in range(40))
    assert snippet_of(spark, "é" * 9000) == "é" * 4096
    # Line ends count as one character each.
    pairs = "\r\n".join(["ab"] * 3000)
    assert snippet_of(spark, pairs + "x") == "\n".join(["ab"] * 40)
    assert snippet_of(spark, "a" + "\r\n" * 5000 + "z") == "a"


def rule_by_rule(snippet):
    """The definition: each rule on its own over the whole header."""
    forms = {"quoted": r"from\s+['\"]", "module": r"from\s+", "named": r"import\s+", "required": r"require\(['\"]"}
    return sorted(
        tag
        for tag, table in fv.IMPORT_TAG_RULES.items()
        if any(re.search(forms[f] + rest, snippet, re.IGNORECASE) for f, rests in table.items() for rest in rests)
    )


def import_tags_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, snippet string")
    return {r["i"]: r["import_tags"] for r in describe.import_tags(df).collect()}


def test_import_tags(spark):
    cases = {
        "import React from 'react'": ["react"],
        "IMPORT torch": ["ai"],
        "from flask import Flask": ["flask"],
        "const x = require('express')": ["api"],
        "import { z } from \"zod\"": ["validation"],
        "import\n\n   pandas as pd": ["data"],
        "from\n'vue-router'": ["routing", "vue"],
        "import a from\nflask": ["flask"],
        "import x, from flask": ["flask"],
        "from 'next'": ["nextjs"],
        "from 'nextra'": [],
        "import nextra": [],
        "from requestsx": [],
        "import requests": ["api"],
        "const w = require('ws')": ["websocket"],
        "const w = require('ws2')": [],
        "import a\nfrom 'x-sentry'": [],
        "import y from 'my-sentry'": ["monitoring"],
        "from 'react-router'": ["react", "routing"],
        "import com.google.cloud.storage": ["gcp"],
        "ımport flask": ["flask"],
        "import paſſport, jeſt": ["test"],
        "from 'some-package-name': import zodpino": [],
        "from 'some-package-name' from requestsé": [],
        "from 'some-package-name' from requests é": ["api"],
        "": [],
        "plain text": [],
    }
    got = import_tags_of(spark, list(cases))
    for i, (text, tags) in enumerate(cases.items()):
        assert got[i] == tags == rule_by_rule(text), text


PARTS = (
    ["from", "import", "require(", "FROM", "Import", " ", " ", "\n", "\t", "'", '"', ")", ";", ",", "{", "x", "é", "_",
     " ", "\r", "\x0b", "ſ"]
    + sorted({re.sub(r"^\.\*|\\b|\\|\[.*?\]|\)$|@", "", rest) for t in fv.IMPORT_TAG_RULES.values()
              for rests in t.values() for rest in rests})
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**9))
def test_import_tags_equal_rule_by_rule_matching(spark, seed):
    rng = random.Random(seed)
    keywords = ["from ", "import ", "require('", "from '", 'from\n"', "import\n", "import {a} from '"]
    texts = []
    for _ in range(1500):
        texts.append("".join(
            rng.choice(keywords) if rng.random() < 0.3 else rng.choice(["@", "", ""]) + rng.choice(PARTS)
            for _ in range(rng.randrange(1, 14))
        ))
    got = import_tags_of(spark, texts)
    for i, text in enumerate(texts):
        assert got[i] == rule_by_rule(text), repr(text)


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "from acme.core import x")], "i int, snippet string")
    table = {"acme": {"module": [r"acme(?:\.\w+)+"]}}
    assert describe.import_tags(df, table).first()["import_tags"] == ["acme"]


def test_tags_are_merged_name_first(spark):
    df = files(spark, ("r/src/App.test.tsx", "import React from 'react'\nimport { z } from 'zod'"))
    row = catalogue.tagged_files(df).first()
    assert row["tags"] == ["test", "react", "validation"]
    assert row["purpose"] == "Unit tests for App"
    bare = catalogue.tagged_files(df, scan_headers=False).first()
    assert bare["tags"] == ["test", "react"] and bare["snippet"] is None


def test_preview_paths_and_primary_tag(spark):
    df = spark.createDataFrame(
        [("site/a/b.py", "1\n2\n3", ["python", "api", "auth"]), ("site", None, ["zzz", "docs"]), ("site/c", "1", ["zzz"])],
        "path string, snippet string, tags array<string>",
    )
    assert values(describe.snippet_preview(df, 2), "path", "preview") == [
        ("site", None), ("site/a/b.py", "1\n2"), ("site/c", "1")]
    assert values(describe.absolute_path(df, "/srv/x/"), "absolute_path", "uri") == [
        ("/srv/x/", "vscode://file//srv/x/"), ("/srv/x/a/b.py", "vscode://file//srv/x/a/b.py"),
        ("/srv/x/c", "vscode://file//srv/x/c")]
    assert all(r["absolute_path"] is None and r["uri"] is None for r in describe.absolute_path(df, None).collect())
    assert values(describe.primary_tag(df), "path", "primary_tag") == [
        ("site", "docs"), ("site/a/b.py", "auth"), ("site/c", None)]
    assert values(describe.ancestors(df).filter("path = 'site/a/b.py'"), "level", "ancestor") == [
        (0, "site"), (1, "site/a"), (2, "site/a/b.py")]


def test_filters_do_not_repeat_the_tag_rules(spark):
    df = files(spark, ("r/a.py", "import torch"))
    nodes = catalogue.file_nodes(catalogue.tagged_files(df))
    plan = filters.files_with_tag(nodes, "ai")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert values(filters.files_with_tag(nodes, "ai"), "path") == [("r/a.py",)]
    assert filters.files_with_tag(nodes, "zz").count() == 0


def test_prune_empty_dirs(spark):
    nodes = spark.createDataFrame(
        [("r", "p", None, "dir", 0), ("r", "p/a", "p", "dir", 1), ("r", "p/a/b", "p/a", "dir", 2),
         ("r", "p/a/b/x.py", "p/a/b", "file", 3), ("r", "p/e", "p", "dir", 1), ("r", "p/e/f", "p/e", "dir", 2),
         ("q", "q", None, "dir", 0)],
        "repo string, path string, parent_path string, kind string, depth int",
    )
    assert values(filters.prune_empty_dirs(nodes), "path") == [("p",), ("p/a",), ("p/a/b",), ("p/a/b/x.py",), ("q",)]
