import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from llm.conftest import ODD, sample
from llm.test_dedup import classes_by_hand
from llm.test_filters import hits_by_hand
from repoloom.llm import pieces, secrets
from repoloom.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def source_rows(spark):
    extra = [(i, t, "en", "odd", 1) for i, t in ODD if i is not None]
    extra += [(8000, "the password: x9Kq7vT2wLm4 is here and of the", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return sample(spark).unionByName(spark.createDataFrame(extra, schema))


def test_stages_equal_brute_force(spark):
    docs = source_rows(spark).cache()
    rows = {r.doc_id: r for r in docs.collect()}
    kept = STAGES["language"](spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    kept = kept.cache()
    got = kept.collect()
    assert all(rows[r.doc_id].text == r.text for r in got)
    lost = {i: r for i, r in rows.items() if i not in {x.doc_id for x in got}}
    known = [r for r in lost.values() if r.text and len(re.findall(r"[^\W\d_]{2,}", r.text)) >= 8 and r.doc_id < 9000]
    assert len(known) <= 0.01 * len(rows)

    texts = [(r.doc_id, r.text) for r in got]
    near = STAGES["near_duplicates"](spark, kept, SF)
    want = {r[0] for r in classes_by_hand(texts) if r[3]}
    assert {r.doc_id for r in near.collect()} == want

    items = [(r.item_id, r.text) for r in sample(spark, "benchmark").collect()]
    clean = STAGES["decontamination"](spark, kept, SF)
    want = {r[0] for r in hits_by_hand(texts, items) if not r[5]}
    assert {r.doc_id for r in clean.collect()} == want

    guesses = secrets.Guesses(secrets.corpus_words(docs))
    redacted = STAGES["secrets"](spark, docs, SF).collect()
    for r in redacted:
        text = rows[r.doc_id].text
        assert r.text == (None if text is None else secrets.redact(text, secrets.find_spans(text, guesses)))
        assert r.n_chars == (None if text is None else len(r.text))

    encoded = STAGES["pieces"](spark, docs, SF)
    text = pieces.decode(F.col("ids"), tokenizer_path("piece_bpe_32k.model"))
    for r in encoded.withColumn("text", text).collect():
        assert r.text == (rows[r.doc_id].text or "").replace("▁", " ")
        assert r.n_tokens == len(np.frombuffer(r.ids, "<u4"))


def test_the_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    total = sample(spark).count()
    assert 0.5 * total < out.count() <= total


def test_queries_return_their_columns(spark):
    want = {
        "op1": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op2": ["doc_id", "n_shingles", "component_id", "kept"],
        "op3": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op5": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op6": ["query_id", "rank", "vec_id", "score"],
        "op7": ["doc_id", "n_tokens"],
        "op8": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op9": ["doc_id", "held_out", "lang_pred", "score"],
        "op10": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    }
    rows = sample(spark).count()
    for name, query in QUERIES.items():
        short = name.split("_")[0]
        if short in want:
            got = query(spark, SF)
            assert set(want[short]) <= set(got.columns), name
            if short != "op6":
                assert got.count() == rows, name


def test_repeated_and_missing_ids_are_judged_by_their_text(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, row_key int"
    item = sample(spark, "benchmark").first().text
    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, copy), (2, copy), (2, "other words that have nothing to do with it"), (None, None), (4, ""), (5, "short"),
        (6, item), (6, "clean words under the same number as a passage"), (None, "some text " + item), (None, "clean and without number"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], kind)
    keep = lambda stage: sorted(((r.doc_id, r.text) for r in STAGES[stage](spark, docs, SF).collect()), key=repr)
    near = keep("near_duplicates")
    assert (2, copy) not in near and (2, rows[2][1]) in near and (1, copy) in near and (None, None) in near and (4, "") in near
    assert keep("decontamination") == sorted((r for r in rows if item not in (r[1] or "")), key=repr)
    for stage in STAGES:
        assert STAGES[stage](spark, docs.limit(0), SF).count() == 0
