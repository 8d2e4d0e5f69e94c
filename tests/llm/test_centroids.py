import hashlib

import numpy as np
import pytest

from llm.conftest import sample
from repoloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int"


def by_hand(rows, k=8, rounds=10, width=64):
    """Plain integers throughout."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and None not in v and np.isfinite(v).all():
            kept.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    order = sorted(
        kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    )
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for n, vs in own.items():
            centres[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    by = {}
    for _, c, d in found:
        by[c] = by.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted((repr(i), c, d, by[c], sum(by.values()), sha(c)) for i, c, d in found)


def result(df, **options):
    return sorted((repr(r[0]), *r[1:]) for r in centroids.clusters(df, **options).collect())


ODD = [
    (9000, None),
    (9001, []),
    (9002, [1.0] * 63),
    (9003, [1.0] * 65),
    (9004, [None] + [1.0] * 63),
    (9005, [float("nan")] + [1.0] * 63),
    (9006, [float("inf")] + [1.0] * 63),
    (9007, [0.0] * 64),
    (9008, [-1e-9] * 64),
    (9009, [130000.0, -130000.0] * 32),
    (None, [0.5] * 64),
    (None, [0.25] * 64),
]


def test_equals_brute_force(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in sample(spark, "embeddings").limit(150).collect()]
    rows += ODD + [(5000 + i, rows[3][1]) for i in range(60)] + rows[:5]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA).repartition(5)
    got = result(df)
    assert got == by_hand(rows)
    assert len(got) == len(rows) - 7


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(i, [float(i), 1.0]) for i in range(n)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(df, components=2) == by_hand(rows, width=2)


def test_ties_and_a_flat_space(spark):
    rows = [(i, [float(i % 7), 0.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(df, components=3) == by_hand(rows, width=3)


def test_components_too_large_are_left_out(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0**17, 0.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert result(df, components=2) == by_hand(rows[:1], width=2)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9000, 9000, (8, 64))
    rows = centres[rng.integers(0, 8, 2000)] + rng.integers(-900, 900, (2000, 64))
    simplex = centroids.Simplex(rows[:48])
    assert len(simplex.pivots) > 4
    apexes, own = simplex.apexes(rows), simplex.apexes(centres)
    exact = centroids.squared(rows, centres).astype(float)
    lower = ((apexes[:, None] - own[None]) ** 2).sum(2)
    upper = lower + 4 * apexes[:, -1:] * own[None, :, -1]
    assert (lower <= exact * (1 + 1e-9) + 1e-3).all() and (upper >= exact * (1 - 1e-9) - 1e-3).all()
    possible = simplex.possible(apexes, own)
    assert possible[np.arange(2000), exact.argmin(1)].all()
    assert possible.mean() < 0.5
