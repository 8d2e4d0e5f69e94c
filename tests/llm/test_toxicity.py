import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, sample
from repoloom.llm import common, queries, toxicity

def learned():
    return ~toxicity.held_out(F.col("doc_id"))


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(sample(spark, scale="sf0.1"), sample(spark, "labels", "sf0.1"), learned())


def test_held_out_documents(spark, model):
    """Toxic ones score higher than others, and clean ones are left alone."""
    labels = sample(spark, "labels", "sf0.1").filter(~learned())
    rows = toxicity.toxicity(sample(spark, scale="sf0.1").join(labels, "doc_id"), model)
    rows = rows.select("toxic", "score", "predicted").collect()
    scores = np.array([r.score for r in rows])
    toxic = np.array([r.toxic for r in rows]) == 1
    predicted = np.array([r.predicted for r in rows]) == 1
    assert (predicted == (scores >= 0.5)).all()
    ranks = scores.argsort().argsort()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.96
    assert predicted[~toxic].mean() < 0.01
    assert predicted[toxic].mean() > 0.7
    assert len(model.at) < 5000


def test_scores_by_hand(spark, documents, model):
    weights = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    texts = [(r.doc_id, r.text) for r in sample(spark).limit(80).collect()] + ODD
    got = toxicity.toxicity(documents(texts), model)
    assert set(got.columns) == {*documents([]).columns, "score", "predicted"}
    want = []
    for doc_id, text in texts:
        words = [common_hash(w) for w in toxicity._WORDS((text or "").lower())]
        buckets = {h >> (64 - toxicity.WORD_BITS) for h in words}
        for gap in range(1, toxicity.REACH + 1):
            for a, b in zip(words, words[gap:]):
                x = (a * int(toxicity._STEPS[gap]) + b) % 2**64
                mixed = int(common.mix(np.array([x], np.uint64))[0])
                buckets.add((mixed >> (64 - toxicity.PAIR_BITS)) + (1 << toxicity.WORD_BITS))
        margin = model.bias + sum(weights.get(b, 0.0) for b in buckets)
        want.append((repr(doc_id), round(1 / (1 + np.exp(-margin)), 6)))
    assert sorted((repr(r.doc_id), round(r.score, 6)) for r in got.collect()) == sorted(want)


def common_hash(word):
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def test_one_learner_by_hand():
    """The update rule of one bucket, written out."""
    state = toxicity.Ftrl(0.0, np.zeros(toxicity._SIZE + 1), np.zeros(toxicity._SIZE + 1))
    at = np.array([5], np.int32)
    state.learn(at, 1, 1.0)
    assert state.z[5] == -0.5 and state.n[5] == 0.25
    w = 0.5 / ((toxicity.BETA + 0.5) / toxicity.ALPHA + toxicity.L2)
    assert np.isclose(state.weights(at)[0], w)
    bias = state.bias()
    p = 1 / (1 + np.exp(-(w + bias)))
    state.learn(at, 0, 2.0)
    g = 2 * p
    assert np.isclose(state.z[5], -0.5 + g - (np.sqrt(0.25 + g * g) - 0.5) / toxicity.ALPHA * w)


def test_odd_labels(spark, documents):
    docs = documents([(1, "good words here"), (2, "bad words there"), (3, None), (None, "bad")])
    kind = "doc_id long, toxic int"
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, None), (None, 1), (9, 1), (4, 7)], kind)
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(documents([]), model).count() == 0


def test_the_bound_holds_and_weighs(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_LABEL", 50)
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    known, _ = toxicity.learned_labels(labels, F.lit(True))
    rows = known.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
    assert sorted((r.toxic, r.n, round(r.w, 6)) for r in rows) == [(0, 50, 900.0), (1, 50, 100.0)]


def test_query(spark):
    rows = queries.QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == sample(spark).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
