"""Approximate nearest neighbours by cosine: stable projections, kd-trees, a chi-square stop.

Unit vectors are projected on DIMENSIONS Gaussian directions.  Two vectors at distance d
have a squared projected distance of d*d times a chi-square variable with DIMENSIONS
degrees of freedom.  So once the next projected distance p makes p*p / (d*d), d that
of the k-th best so far, exceed the SURE quantile, a nearer vector would have had to
project that far with probability 1 - SURE, and the search stops.

Rows are dealt to cells of a kd-tree over the projections whose cuts come from a bounded
sample; a cell beyond CELL_ROWS is split by a hash, whatever it holds.  A query first
searches its own cell; the k-th distance there then names the other cells that the stopping test
can't exclude.  Inside a block a small kd-tree's leaves are visited by projected distance,
and every visited vector is verified with its true cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common

DIMENSIONS = 8
SURE = 0.995
#: Rows that the cuts of the cells are fitted on, at most; rows per cell aimed at.
SAMPLE_ROWS = 50_000
CELL_ROWS = 20_000
LEAF_ROWS = 256
_SLACK = 1e-9


def chi_square_quantile(p: float, degrees: int) -> float:
    """For even degrees, by halving on the closed form of the distribution."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return (lo + hi) / 2


_LIMIT = chi_square_quantile(SURE, DIMENSIONS)


def _project(vectors: np.ndarray) -> np.ndarray:
    """Projections of the unit vectors; row by row, so equal rows stay equal."""
    width = vectors.shape[1]
    directions = np.random.default_rng(width).standard_normal((DIMENSIONS, width))
    units = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    return np.stack([(units * d).sum(1) for d in directions], 1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cut(points: np.ndarray, rows: int) -> tuple[list, np.ndarray, np.ndarray]:
    """A kd-tree of leaves of `rows` points at most: (axis, cut, left, right) nodes or leaf
    numbers below zero, each point's leaf, and the points ordered by leaf."""
    nodes: list[tuple[int, float, int, int]] = []
    leaf = np.zeros(len(points), np.int64)
    count = 0

    def grow(own: np.ndarray) -> int:
        nonlocal count
        if len(own) > rows:
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            values = points[own, axis]
            cut = float(np.median(values))
            left = values <= cut
            if left.all():  # the median is the largest value
                left = values < cut
                cut = float(values[left].max()) if left.any() else cut
            if left.any() and not left.all():
                at = len(nodes)
                nodes.append((axis, cut, 0, 0))
                nodes[at] = (axis, cut, grow(own[left]), grow(own[~left]))
                return at
        leaf[own] = count
        count += 1
        return -count

    if len(points):
        grow(np.arange(len(points)))
    return nodes, leaf, np.argsort(leaf, kind="stable")


def _place(nodes: list, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    found = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        at, own = todo.pop()
        axis, cut, left, right = nodes[at]
        low = points[own, axis] <= cut
        for child, part in ((left, own[low]), (right, own[~low])):
            if child < 0:
                found[part] = -child - 1
            elif len(part):
                todo.append((child, part))
    return found


def _boxes(nodes: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the cells, infinite outside."""
    lower: dict[int, np.ndarray] = {}
    upper: dict[int, np.ndarray] = {}
    todo = [(0 if nodes else -1, np.full(width, -np.inf), np.full(width, np.inf))]
    while todo:
        at, lo, hi = todo.pop()
        if at < 0:
            lower[-at - 1], upper[-at - 1] = lo, hi
            continue
        axis, cut, left, right = nodes[at]
        cap, floor = hi.copy(), lo.copy()
        cap[axis] = min(cap[axis], cut)
        floor[axis] = max(floor[axis], cut)
        todo += [(left, lo, cap), (right, floor, hi)]
    order = sorted(lower)
    return np.stack([lower[i] for i in order]), np.stack([upper[i] for i in order])


def _box_distance(points: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes: a row per point."""
    out = np.zeros((len(points), len(lower)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        gap = np.maximum(np.maximum(lower[None, :, axis] - p, p - upper[None, :, axis]), 0)
        out += gap * gap
    return out


def _search(ids, vectors, query_ids, queries, k):
    """Rows (query_id, vec_id, score) of the k best of one block for each query."""
    points = _project(vectors)
    _, leaf, order = _cut(points, LEAF_ROWS)
    ids, vectors, points, leaf = ids[order], vectors[order], points[order], leaf[order]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1])
    end = np.concatenate([begin[1:], [len(leaf)]])
    lower = np.minimum.reduceat(points, begin)
    upper = np.maximum.reduceat(points, begin)
    norms = np.sqrt((vectors * vectors).sum(1))
    found = []
    for lo in range(0, len(queries), 256):
        far = _box_distance(_project(queries[lo : lo + 256]), lower, upper)
        for row, distances in enumerate(far):
            query_id, query = query_ids[lo + row], queries[lo + row]
            norm = math.sqrt((query * query).sum())
            best_ids, best = np.zeros(0, np.int64), np.zeros(0)
            for at in np.argsort(distances, kind="stable"):
                if len(best) == k and distances[at] > _LIMIT * max(2 - 2 * best[-1], 0) + _SLACK:
                    break
                own = slice(begin[at], end[at])
                if len(best) == k:
                    # Matrix products round by position; near the limit the scores decide.
                    rough = (vectors[own] @ query) / (norms[own] * norm)
                    if rough.max() < best[-1] - _SLACK:
                        continue
                scores = (vectors[own] * query).sum(1) / (norms[own] * norm)
                other = ids[own] != query_id
                all_ids = np.concatenate([best_ids, ids[own][other]])
                scores = np.concatenate([best, scores[other]])
                first = np.lexsort((all_ids, -scores))
                _, once = np.unique(all_ids[first], return_index=True)
                first = first[np.sort(once)[:k]]
                best_ids, best = all_ids[first], scores[first]
            found += [(int(query_id), int(i), float(s)) for i, s in zip(best_ids, best, strict=True)]
    return found


_FOUND = "query_id long, vec_id long, score double"


def _block(k: int):
    def search(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]):
        rows, queries = (pa.Table.from_batches(list(x)) if not isinstance(x, pa.Table) else x for x in (left, right))
        found = []
        if rows.num_rows and queries.num_rows:
            side = lambda t: (
                t.column("vec_id").to_numpy(),
                _vectors(t.column("vector").combine_chunks()),
            )
            found = _search(*side(rows), *side(queries), k)
        return pa.table(
            {
                "query_id": pa.array([x[0] for x in found], pa.int64()),
                "vec_id": pa.array([x[1] for x in found], pa.int64()),
                "score": pa.array([x[2] for x in found], pa.float64()),
            }
        )

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The k nearest other rows of each query by cosine.

    In: vec_id long, embedding array; other columns are ignored.  Out: query_id, rank from
    1, vec_id, score (the cosine in double precision), ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows without vec_id.  Vectors of different lengths are not compared; each
    length is searched by itself.  Rows that repeat a vec_id count once in a result.  Fewer than k
    candidates give fewer rows, no query gives none.
    """
    spark = vectors.sparkSession
    whole = (
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = (
        vectors.filter(whole)
        .withColumn("_query", F.coalesce(is_query, F.lit(False)))
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("vector"),
            "_query",
            F.size("embedding").alias("width"),
        )
    )
    sizes = {r.width: r["count"] for r in rows.groupBy("width").count().collect()}
    trees = {}
    for width, n in sizes.items():
        share = min(1.0, SAMPLE_ROWS / n)
        hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share * (1 << 30)
        sample = rows.filter((F.col("width") == width) & hashed).select("vector").limit(2 * SAMPLE_ROWS)
        points = _project(np.array([r.vector for r in sample.collect()], np.float64).reshape(-1, width))
        nodes, _, _ = _cut(points, max(int(CELL_ROWS * len(points) / n), 1)) if len(points) else ([], 0, 0)
        trees[width] = (nodes, *_boxes(nodes, DIMENSIONS))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                points = _project(_vectors(batch.column("vector").take(pa.array(own))))
                cell[own] = _place(trees[int(width)][0], points)
            yield batch.append_column("cell", pa.array(cell))

    placed = common.stored(
        rows.mapInArrow(cells, "vec_id long, vector array<double>, _query boolean, width int, cell long"),
        "cells",
    )
    # A row per cell; splits those that outgrew the sample, as equal vectors do.
    splits = placed.groupBy("width", "cell").agg(
        F.ceil(F.count("*") / (2 * CELL_ROWS)).cast("int").alias("splits")
    )
    splits = F.broadcast(common.stored(splits, "splits"))
    at = ["width", "cell", "split"]
    items = placed.join(splits, ["width", "cell"]).select(
        "vec_id", "vector", "width", "cell", F.pmod(F.xxhash64("vec_id"), "splits").alias("split")
    )
    queries = common.stored(
        placed.filter("_query").select("vec_id", "vector", "width", "cell"), "queries"
    )

    def searched(which: DataFrame) -> DataFrame:
        asked = which.join(splits, ["width", "cell"]).select(
            "vec_id", "vector", "width", "cell", F.explode(F.expr("sequence(0, splits - 1)")).alias("split")
        )
        asked = asked.withColumn("split", F.col("split").cast("long"))
        return (
            items.withColumn("split", F.col("split").cast("long"))
            .groupBy(*at)
            .cogroup(asked.groupBy(*at))
            .applyInArrow(_block(k), _FOUND)
        )

    near = common.stored(_best(searched(queries), k), "near")
    reach = near.groupBy(F.col("query_id").alias("vec_id")).agg(
        F.count("*").alias("n"), F.min("score").alias("last")
    )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query again for every other cell that the stopping test leaves."""
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column("width")[row].as_py()
                n, last = batch.column("n")[row].as_py(), batch.column("last")[row].as_py()
                _, lower, upper = trees[width]
                point = _project(_vectors(batch.column("vector").slice(row, 1)))
                limit = _LIMIT * max(2 - 2 * last, 0) + _SLACK if n == k else np.inf
                left = np.flatnonzero(_box_distance(point, lower, upper)[0] <= limit)
                left = left[left != batch.column("cell")[row].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(c).take(pa.array([row] * len(left), pa.int64()))
                        for c in ("vec_id", "vector", "width")
                    ]
                    + [pa.array(left, pa.int64())],
                    ["vec_id", "vector", "width", "cell"],
                )

    again = (
        queries.join(reach, "vec_id", "left")
        .select("vec_id", "vector", "width", "cell", F.coalesce("n", F.lit(0)).alias("n"), "last")
        .fillna(1.0, ["last"])
        .mapInArrow(others, "vec_id long, vector array<double>, width int, cell long")
    )
    found = near.select("query_id", "vec_id", "score").union(searched(again))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
