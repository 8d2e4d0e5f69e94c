"""Marked comments: detection, counting, stripping, extraction."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values
from repoloom.operators import marks

JS = """// ᚲ [tutor] The cart lives in memory until checkout
const cart = new Map();
// my own note
function add(id) {
  // ᚲ [tutor] Counting instead of pushing keeps one row per article
  cart.set(id, (cart.get(id) || 0) + 1);
}
// ᚲ [tutor] Exported for the page
module.exports = { add };"""
PYTHON = """# ᚲ [minimal] settings
import os
# ᚲ [minimal] root folder
ROOT = os.environ["ROOT"]
# keep this
def read(name):
    # ᚲ [minimal] open and read
    with open(os.path.join(ROOT, name)) as f:
        # ᚲ [minimal] whole file
        return f.read()"""
SQL = """-- ᚲ [technical] materialised once
WITH paid AS (SELECT * FROM orders WHERE state = 'paid')
-- ᚲ [technical] hash aggregate
SELECT day, count(*) FROM paid GROUP BY day"""
CSS = """/* ᚲ [non-technical] Makes the page calm */
body { color: #333 }
/* ᚲ [non-technical] Big friendly buttons */
button { padding: 1em }"""
HTML = """<main>
  <!-- ᚲ [tutor] A list of "cards" -->
  <ul></ul>
  <!-- ᚲ [tutor] Closing part -->
</main>"""
MIXED = """// ᚲ [tutor] one
// ᚲ [minimal] two
let x = 1;
// ᚲ [technical] three
// ᚲ [non-technical] four"""
CLEAN = "// usual comment\n# another\nlet y = 2; /* block */\n"
IN_STRINGS = "const a = 'ᚲ [tutor] text';\nconst re = /ᚲ/;\nlog('ᚲ');"
INDENTED = "  // ᚲ [tutor] two\nx\n      # ᚲ [tutor] six\n\t-- ᚲ [tutor] tab\ny"
CRLF = "let a = 1;\r\n// ᚲ [tutor] one\r\nlet b = 2;\r\n# ᚲ [tutor] two\r\n"
ONLY = "// ᚲ [tutor] a\n// ᚲ [minimal] b\n// ᚲ [tutor] c"
SPECIAL = "// ᚲ [tutor] maps a => b²\n// ᚲ [tutor] says \"hi\" & 'bye'\nf();\n// ᚲ [tutor] call (again) [now]"

# case, text, marked lines, valid modes in first-seen order
CASES = [
    ("js", JS, 3, ["tutor"]),
    ("python", PYTHON, 4, ["minimal"]),
    ("sql", SQL, 2, ["technical"]),
    ("css", CSS, 2, ["non-technical"]),
    ("html", HTML, 2, ["tutor"]),
    ("mixed", MIXED, 4, ["tutor", "minimal", "technical", "non-technical"]),
    ("clean", CLEAN, 0, []),
    ("strings", IN_STRINGS, 0, ["tutor"]),
    ("bare", "// a stray ᚲ here\ncode", 0, []),
    ("empty", "", 0, []),
    ("indented", INDENTED, 3, ["tutor"]),
    ("crlf", CRLF, 2, ["tutor"]),
    ("only", ONLY, 3, ["tutor", "minimal"]),
    ("special", SPECIAL, 3, ["tutor"]),
    ("unknown", "// ᚲ [weird] word\ncode", 1, []),
    ("trailing", "x = 1 // ᚲ [tutor] after code", 0, ["tutor"]),
    ("block", " * ᚲ [tutor] inside a block", 0, ["tutor"]),
    ("ends", "code\n// ᚲ [tutor] last\n", 1, ["tutor"]),
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [("r", name, text) for name, text, _, _ in CASES]
    return spark.createDataFrame(rows, "repo string, path string, content string").cache()


def by_path(df, *columns):
    return {r["path"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_counts(files):
    got = by_path(marks.count_marks(files), "mark_count")
    assert got == {name: (n,) for name, _, n, _ in CASES}


def test_modes(files):
    got = by_path(marks.detect_modes(files), "modes")
    assert got == {name: (modes,) for name, _, _, modes in CASES}


def test_has_marks_needs_a_valid_mode_and_a_marked_line(files):
    got = {r["path"] for r in files.filter(marks.has_marks_expr(F.col("content"))).collect()}
    assert got == {name for name, _, n, modes in CASES if n and modes}


def test_strip_removes_whole_lines_and_nothing_else(files):
    got = by_path(marks.strip_marks(files), "stripped", "removed")
    for name, text, n, _ in CASES:
        stripped, removed = got[name]
        kept = [l for l in text.split("\n") if not re.match(r"[ \t]*(//|#|--|/\*|<!--)\s*ᚲ\s*\[", l)]
        assert removed == n, name
        assert stripped == "\n".join(kept), name
    assert got["only"][0] == ""
    assert got["clean"][0] == CLEAN
    assert got["strings"][0] == IN_STRINGS
    assert "// my own note" in got["js"][0] and "# keep this" in got["python"][0]
    assert got["crlf"][0] == "let a = 1;\r\nlet b = 2;\r\n"


def test_strip_is_idempotent(files):
    once = marks.strip_marks(files).select("repo", "path", F.col("stripped").alias("content"))
    assert all(r["removed"] == 0 for r in marks.strip_marks(once).collect())


@pytest.mark.parametrize("mode", ["tutor", "minimal", "technical", "non-technical", "weird"])
def test_strip_by_mode(files, mode):
    got = by_path(marks.strip_marks_by_mode(files, mode), "stripped", "removed")
    counted = by_path(marks.count_marks(files, mode), "mark_count")
    for name, text, _, _ in CASES:
        wanted = re.compile(r"[ \t]*(//|#|--|/\*|<!--)\s*ᚲ\s*\[" + re.escape(mode) + r"\]")
        kept = [l for l in text.split("\n") if not wanted.match(l)]
        assert got[name][0] == "\n".join(kept), name
        assert got[name][1] == counted[name][0] == len(text.split("\n")) - len(kept), name


def test_mode_text_is_literal(files):
    assert all(r["removed"] == 0 for r in marks.strip_marks_by_mode(files, "t.tor").collect())


def test_extract(files):
    got = values(
        marks.extract_marks(files).filter("path in ('html', 'indented', 'crlf', 'css')"),
        "path", "line_no", "indent", "syntax", "mode", "body",
    )
    assert got == sorted(
        [
            ("css", 1, "", "/*", "non-technical", "Makes the page calm"),
            ("css", 3, "", "/*", "non-technical", "Big friendly buttons"),
            ("html", 2, "  ", "<!--", "tutor", 'A list of "cards"'),
            ("html", 4, "  ", "<!--", "tutor", "Closing part"),
            ("indented", 1, "  ", "//", "tutor", "two"),
            ("indented", 3, "      ", "#", "tutor", "six"),
            ("indented", 4, "\t", "--", "tutor", "tab"),
            ("crlf", 2, "", "//", "tutor", "one"),
            ("crlf", 4, "", "#", "tutor", "two"),
        ],
        key=repr,
    )


def test_replace_cycle(spark):
    four = "// ᚲ [tutor] a\nx\n// ᚲ [tutor] b\ny\n// ᚲ [tutor] c\n// ᚲ [tutor] d\nz"
    df = spark.createDataFrame([("r", "p", four)], "repo string, path string, content string")
    fresh = marks.apply_strategy(df, "replace").first()["content"]
    assert fresh == "x\ny\nz"
    again = "// ᚲ [minimal] 1\n" + fresh + "\n// ᚲ [minimal] 2"
    df = spark.createDataFrame([("r", "p", again)], "repo string, path string, content string")
    assert marks.count_marks(df).first()["mark_count"] == 2
    assert marks.apply_strategy(df, "replace").first()["content"] == "x\ny\nz"


def test_merge_cycle(spark):
    text = "// ᚲ [tutor] a\nx\n// ᚲ [tutor] b\n// ᚲ [minimal] c"
    df = spark.createDataFrame([("r", "p", text)], "repo string, path string, content string")
    assert marks.apply_strategy(df, "merge").first()["content"] == text
    assert marks.count_marks(df).first()["mark_count"] == 3
    left = marks.strip_marks_by_mode(df, "tutor").select("repo", "path", F.col("stripped").alias("content"))
    assert marks.detect_modes(left).first()["modes"] == ["minimal"]
    with pytest.raises(ValueError):
        marks.apply_strategy(df, "ask")


def test_other_marker(spark):
    df = spark.createDataFrame([("r", "p", "// @@ [tutor] a\n// ᚲ [tutor] b\nx")],
                               "repo string, path string, content string")
    assert marks.strip_marks(df, marker="@@").first()["stripped"] == "// ᚲ [tutor] b\nx"


def test_erase_report(files):
    assert marks.erase_report(files).count() == 0
    placed = files.withColumn("path", F.concat(F.lit("r/src/"), "path", F.lit(".js")))
    elsewhere = files.withColumn("path", F.concat(F.lit("r/vendor/"), "path", F.lit(".js")))
    assert values(marks.erase_report(placed.unionByName(elsewhere))) == [
        ("r", sum(1 for _, _, n, m in CASES if n and m), sum(n for _, _, n, m in CASES if n and m))
    ]


def test_clean_responses(spark):
    df = spark.createDataFrame(
        [("```python\nx = 1\n```",), ("x = 1",), ("```\na\n```b\n```  \n",), ("```js",)], "body string"
    )
    assert [r["body"] for r in marks.clean_responses(df).collect()] == ["x = 1", "x = 1", "a\n```b", ""]


def test_run_summary_and_failures(spark):
    df = spark.createDataFrame(
        [("r", "a", "succeeded", None), ("r", "b", "failed", "timed out"), ("r", "c", "skipped", None),
         ("r", "d", "succeeded", None)],
        "repo string, path string, status string, reason string",
    )
    assert values(marks.run_summary(df)) == [("failed", 1), ("skipped", 1), ("succeeded", 2)]
    assert values(marks.failures(df)) == [("r", "b", "timed out")]


LINE = re.compile(
    "^([ \\t]*)(//|#|--|/\\*|<!--)[^\\S\\n]*ᚲ[^\\S\\n]*\\[(\\w[\\w-]*)\\][^\\S\\n]*([^\\n\\r]*?)"
    "(?:[^\\S\\n]*\\*/|[^\\S\\n]*-->)?[^\\S\\n]*\\Z", re.ASCII
)
PIECES = ["//", "#", "--", "/*", "*/", "<!--", "-->", "ᚲ", "[tutor]", "[x-y]", "[-]", " ", "\t", "\n", "\r", "a", "b c"]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**9))
def test_random_texts_follow_the_line_definition(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(25))) for _ in range(400)]
    texts += [
        "\n".join(
            rng.choice(["", " ", "\t"]) + rng.choice(PIECES[:7]) + rng.choice(["", " "]) + "ᚲ"
            + rng.choice(["", " "]) + rng.choice(["[tutor]", "[q]", "[]"]) + rng.choice(["", " hi", " hi */", "-->", "\r", " a\rb", "\rb", " a\r*/", "a */\r-->", "a\r*/ -->"])
            for _ in range(rng.randrange(4))
        )
        for _ in range(400)
    ]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)],
                               "repo string, path string, content string")
    got = by_path(marks.strip_marks(df), "stripped", "removed")
    found = {}
    for r in marks.extract_marks(df).collect():
        found.setdefault(r["path"], []).append((r["line_no"], r["indent"], r["syntax"], r["mode"], r["body"]))
    for i, t in enumerate(texts):
        lines = t.split("\n")
        hits = [(n, *m.groups()) for n, l in enumerate(lines, 1) if (m := LINE.match(l))]
        assert got[str(i)] == ("\n".join(l for l in lines if not LINE.match(l)), len(hits)), repr(t)
        assert sorted(found.get(str(i), [])) == hits, repr(t)
