import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from repoloom.operators import search, search_index

KIND = "repo string, name string, description string, tags array<string>, path string, doc_id long"


def some_items(spark, rng, n):
    words = ["cart", "React", "config", "yaml", "été", "a", "ab", "日本語", "x_y", "list-item", "Σ", "aaaa"]
    rows = []
    for i in range(n):
        pick = lambda k: " ".join(rng.choice(words) for _ in range(rng.randrange(k)))
        tags = None if i % 7 == 0 else [rng.choice(words) for _ in range(rng.randrange(3))]
        rows.append((f"r{i % 3}", pick(2), pick(4) or None, tags, f"p/{i % 40}/{pick(2)}", i))
    rows.append((None, None, None, None, None, n))
    rows += rows[:5]
    return spark.createDataFrame(rows, KIND).repartition(3)


QUERIES = [
    (1, "cart react"), (2, "a"), (3, "ab  A"), (4, "日本"), (5, "zzz nothing"), (6, " "), (7, None), (8, "aaa aaaaa aaaa"),
    (9, "été σ"), (10, "list-item list-item x_y p/1"), (11, "%_"), (12, "configyaml"), (13, "p"),
]


@pytest.mark.parametrize("bits,pushed", [(16, 2000), (2, 2000), (16, 0)])
def test_equals_searching_one_by_one(spark, tmp_path, monkeypatch, bits, pushed):
    monkeypatch.setattr(search_index, "BLOCK_BITS", bits)
    monkeypatch.setattr(search_index, "PUSHED_GRAMS", pushed)
    items = some_items(spark, random.Random(bits), 150)
    search_index.build(items, str(tmp_path))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    got = search_index.search(spark, str(tmp_path), asked, 1000).select("query_id", "score", *items.columns)
    want = None
    for i, q in QUERIES:
        own = search.search(items, q or "", 1000).select(F.lit(i).alias("query_id"), "score", *items.columns)
        want = own if want is None else want.union(own)
    assert values(got) == values(want)
    ranked = search_index.search(spark, str(tmp_path), asked, 3)
    assert max(r["count"] for r in ranked.groupBy("query_id").count().collect()) == 3
    assert {r.rank for r in ranked.collect()} == {1, 2, 3}


def test_what_travels(spark, tmp_path):
    """Postings and terms only, until candidates are known; no join of all items with all terms."""
    search_index.build(some_items(spark, random.Random(1), 60), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/postings").columns == ["gram", "block", "places"]
    asked = search_index.asked_terms(spark.createDataFrame(QUERIES, "query_id int, query string"))
    found = search_index.candidates(spark, str(tmp_path), asked.select("term").distinct())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "/items]" not in plan and "description" not in plan and "_hay" not in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")


def test_no_items(spark, tmp_path):
    search_index.build(spark.createDataFrame([], KIND), str(tmp_path))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    assert search_index.search(spark, str(tmp_path), asked).count() == 0


@pytest.mark.parametrize("shared", [0, 5, 40])
def test_shared_terms_rank_as_one_by_one(spark, tmp_path, monkeypatch, shared):
    monkeypatch.setattr(search_index, "SHARED_ITEMS", shared)
    items = some_items(spark, random.Random(shared), 150)
    search_index.build(items, str(tmp_path))
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    for k in (3, 1000):
        got = search_index.search(spark, str(tmp_path), asked, k).select("query_id", "score", "path", "repo", "doc_id")
        want = []
        for i, q in QUERIES:
            own = search.search(items, q or "", k).select("score", "path", "repo", "doc_id")
            want += [(i, *r) for r in own.collect()]
        assert values(got) == sorted(want, key=repr)


def test_terms_that_all_ask_for_are_not_paired_with_all_items(spark):
    """Many queries share a term that many items hold: k items a query and those of its own terms remain."""
    queries, items, k = 300, 400, 5
    held = spark.range(items).selectExpr("'py' AS term", "id AS _row")
    held = held.union(spark.range(queries).selectExpr("concat('own', id) AS term", "id AS _row"))
    asked = spark.range(queries).selectExpr("id AS query_id", "explode(array('py', concat('own', id))) AS term", "1L AS times")
    order = spark.range(items).selectExpr("id AS _row", "concat('p', id) AS path")
    found = search_index.contenders(asked, held, order, ["path"], k)
    assert found.count() <= queries * (k + 1)
    assert found.filter("_row = query_id").agg(F.min("score"), F.count("*")).first() == (2, queries)
