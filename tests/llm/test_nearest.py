import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import sample
from repoloom.llm import nearest

ODD = [
    (20000, None),
    (20050, []),
    (20100, [0.0] * 64),
    (20150, [None] + [1.0] * 63),
    (20200, [float("nan")] + [1.0] * 63),
    (20250, [float("inf")] * 64),
    (20300, [1.0, 2.0]),
    (20301, [2.0, 1.0]),
    (20350, [1.0, 2.0, 3.0]),
]


def by_hand(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good.setdefault(len(v), []).append((i, np.array(v, np.float32).astype(float)))
    out = set()
    for own in good.values():
        ids, m = np.array([i for i, _ in own]), np.stack([v for _, v in own])
        norms = np.sqrt((m * m).sum(1))
        for i, q in own:
            if i % 50 == 0:
                scores = (m * q).sum(1) / (norms * np.sqrt((q * q).sum()))
                ranked = dict.fromkeys(int(ids[x]) for x in np.lexsort((ids, -scores)) if ids[x] != i)
                out |= {(i, x) for x in list(ranked)[:k]}
    return out


@pytest.mark.parametrize("cell_rows", [20_000, 100])
def test_recall_against_brute_force(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell_rows)
    rows = [(r.vec_id, list(r.embedding)) for r in sample(spark, "embeddings", "sf0.01").collect()]
    rows += [(10000 + i, rows[0][1]) for i in range(300)] + ODD + [(None, rows[1][1]), (1, rows[1][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cell int")
    got = nearest.nearest(df.repartition(5), F.col("vec_id") % 50 == 0, 5).collect()
    pairs = {(r.query_id, r.vec_id) for r in got}
    want = by_hand(rows, 5)
    assert len(pairs) == len(got) == len(want)
    assert len(pairs & want) >= 0.98 * len(want)
    first = rows[0][0]
    if first % 50 == 0:
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == first] == [10000 + i for i in range(5)]
    assert {x for x in pairs if x[0] >= 20000} == {(20300, 20301)}


def test_no_vectors_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest(empty, F.lit(True), 5).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert nearest.nearest(some, F.lit(False), 5).count() == 0
