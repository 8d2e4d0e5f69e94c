"""Centroid clustering in whole numbers, with n-simplex projection as its filter.

The distances of a vector to m pivots fix the apex of a simplex over the pivots: m
coordinates, found once and kept with the vector.  For two apexes the Euclidean distance is
never above that of the vectors, and with one last coordinate mirrored never below.  In each
round the centroids get apexes too, and a vector is compared exactly, component by
component in whole numbers, only with those centroids whose lower bound doesn't exceed the
least upper bound.  The bounds are widened by their rounding error, so results are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common

#: Pivots at most, and the vectors they are picked from.
PIVOTS = 12
PIVOT_CANDIDATES = 48
#: A pivot stands out of the space of those before it by this share of the longest edge.
LEAST_HEIGHT = 0.1
#: Components are whole numbers of up to this size, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Vectors compared at a time in a task.
STEP = 8192


class Simplex:
    """Pivots, and apex coordinates of vectors over them."""

    def __init__(self, candidates: np.ndarray) -> None:
        """Takes independent pivots from the rows of `candidates`, in their order."""
        self.pivots = candidates[:1]
        self.base = np.zeros((0, 0))
        for row in candidates[1:]:
            if len(self.pivots) == PIVOTS:
                break
            apex = self.apexes(row[None])[0]
            edges = squared(self.pivots, self.pivots).max(initial=0), squared(self.pivots, row[None]).max()
            if apex[-1] > LEAST_HEIGHT * max(edges) ** 0.5:
                grown = np.zeros((len(apex), len(apex)))
                grown[:-1, :-1] = self.base
                grown[-1] = apex
                self.base = grown
                self.pivots = np.concatenate([self.pivots, row[None]])
        spread = np.abs(self.base).sum() * np.abs(self._solved(np.eye(len(self.base)))).sum()
        self.error = 1e-12 * max(spread, 1.0)

    def _solved(self, right: np.ndarray) -> np.ndarray:
        """Solutions x of base x = right for each row of `right`; the base is a lower triangle."""
        found = np.zeros(right.shape)
        for i, row in enumerate(self.base):
            known = (found[:, :i] * row[:i]).sum(1)
            found[:, i] = (right[:, i] - known) / row[i]
        return found

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """A row's coordinates: those below the apex, then its height."""
        if not len(self.pivots):
            return np.zeros((len(rows), 1))
        cached = squared(rows, self.pivots).astype(np.float64)
        flat = np.zeros((len(rows), 0))
        if len(self.base):
            sizes = (self.base * self.base).sum(1)
            flat = self._solved((cached[:, :1] + sizes - cached[:, 1:]) / 2)
        height = np.sqrt(np.maximum(cached[:, 0] - (flat * flat).sum(1), 0))
        return np.concatenate([flat, height[:, None]], 1)

    def possible(self, apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """For each vector's apex, the centroids that its bounds leave."""
        sides = (apexes**2).sum(1)[:, None] + (centres**2).sum(1)
        cross = np.einsum("im,cm->ic", apexes[:, :-1], centres[:, :-1])
        heights = apexes[:, -1:] * centres[:, -1]
        slack = self.error * (sides + 1)
        lower = sides - 2 * cross - 2 * heights - slack
        upper = sides - 2 * cross + 2 * heights + slack
        return lower <= upper.min(1)[:, None]


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of two small sets of whole-number vectors."""
    gap = left[:, None, :] - right[None, :, :]
    return (gap * gap).sum(2)


def assign(
    rows: np.ndarray, apexes: np.ndarray, simplex: Simplex, centroids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, the smaller on ties, and its squared distance."""
    possible = simplex.possible(apexes, simplex.apexes(centroids))
    best = np.full(len(rows), -1, np.int64)
    least = np.full(len(rows), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        own = np.flatnonzero(possible[:, c])
        gap = rows[own] - centroids[c]
        size = np.einsum("ij,ij->i", gap, gap)
        nearer = size < least[own]
        best[own[nearer]] = c
        least[own[nearer]] = size[nearer]
    return best, least


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(column), -1)


def whole_vectors(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, ints) of the vectors that take part, with components as floor(scale * x)."""
    x = F.col("embedding")
    fits = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < LARGEST)
    )
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    whole = F.when((F.size(x) == components) & fits, ints)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("ints")).filter(
        F.col("ints").isNotNull()
    )


def clusters(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, components: int = 64, scale: int = 1024
) -> DataFrame:
    """The cluster of each vector after `rounds` rounds and one more assignment.

    In: vec_id long, embedding array of numbers; other columns are ignored.  Vectors take
    part that have exactly `components` components, none null or non-finite; each becomes
    floor(scale * x).  Centroids start as the k vectors with the smallest lowercase-hex sha256 of
    `seed:vec_id`, a null id being empty; of rows that repeat a vec_id, by components.  A round moves every
    centroid that has vectors to the floor of their mean.

    Out, a row per vector, repeated rows included: vec_id, cluster int, distance long
    (squared), cluster_inertia and inertia long (null where they exceed a long),
    centroid_sha256.  Fewer than k vectors start fewer clusters; an empty table gives an
    empty one.  A vector with a component of LARGEST or more in size is left out, too: its squared
    distances don't fit a long.

    Only k centroids, PIVOT_CANDIDATES vectors and sums by cluster and component reach the driver.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, components, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    order = F.sha2(name, 256)
    first = whole.orderBy(order, "ints").limit(max(k, PIVOT_CANDIDATES)).collect()
    if not first:
        return spark.createDataFrame([], _SCHEMA)
    chosen = np.array([r.ints for r in first], np.int64)
    simplex, centroids = Simplex(chosen[:PIVOT_CANDIDATES]), chosen[:k]

    def cached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                apexes = simplex.apexes(_matrix(part.column("ints"), np.int64))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1])
                yield part.append_column("apex", lists.cast(pa.list_(pa.float64())))

    kept = common.stored(
        whole.mapInArrow(cached, "vec_id long, ints array<int>, apex array<double>"), "vectors"
    )
    for _ in range(rounds):
        moved = _moved(kept, simplex, centroids)
        if (moved == centroids).all():  # and so would be all further rounds
            break
        centroids = moved
    return _named(_assigned(kept, simplex, centroids), centroids)


_SCHEMA = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), STEP):
        yield batch.slice(at, STEP)


def _moved(kept: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; sums are added up in tasks, then in Spark."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for part in _steps(batch):
                rows = _matrix(part.column("ints"), np.int64)
                best, _ = assign(rows, _matrix(part.column("apex"), np.float64), simplex, centroids)
                count += np.bincount(best, minlength=k)
                for c in range(k):
                    total[c] += rows[best == c].sum(0)
        own = np.flatnonzero(count)
        columns = [pa.array(own, pa.int32()), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    partial = kept.select("ints", "apex").mapInArrow(sums, "cluster int, n long, sums array<long>")
    summed = partial.select("cluster", "n", F.posexplode("sums").alias("at", "own")).groupBy("cluster", "at")
    found = summed.agg(F.sum(F.col("own").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    moved = centroids.copy()
    for r in found.collect():  # k times the components
        moved[r.cluster, r["at"]] = int(r.total) // r.n
    return moved


def _assigned(kept: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(batch):
                rows = _matrix(part.column("ints"), np.int64)
                best, size = assign(rows, _matrix(part.column("apex"), np.float64), simplex, centroids)
                columns = [part.column("vec_id"), pa.array(best, pa.int32()), pa.array(size)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return common.stored(kept.mapInArrow(near, "vec_id long, cluster int, distance long"), "clusters")


def _named(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of distances and the centroids' digests, a row per cluster."""
    spark = found.sparkSession
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    totals = {r.cluster: int(r.total) for r in sums.collect()}
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    rows = [(c, fits(n), fits(sum(totals.values())), digest(c)) for c, n in sorted(totals.items())]
    facts = spark.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
