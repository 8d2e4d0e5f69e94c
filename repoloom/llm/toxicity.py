"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of adjacent words and its pairs of words with up
to two others between, each hashed to a bucket.  Follow-the-regularized-leader keeps two sums
per bucket, from which its weight and its own learning rate come; the L1 part leaves most
weights at zero, so that the model is a short list and goes to every task.

Labelled rows are dealt to shards by hash.  In each round every shard learns for itself from
the state of the round before; then the states are mixed bucket by bucket, each shard
counting by what it saw of the bucket.  Buckets that are far from having a weight aren't carried on,
which keeps the states as short as the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common

#: Labelled documents learned from, per label at most; the rest of a label counts by weight.
PER_LABEL = 20_000
SHARDS = 4
ROUNDS = 6
#: Buckets of words and of pairs, as powers of two, and how far the words of a pair stand apart at most.
WORD_BITS = 19
PAIR_BITS = 19
REACH = 3
#: FTRL's learning rate, its smoothing, and the L2 part.
ALPHA = 1.0
BETA = 1.0
L2 = 0.001
#: The L1 part as a share of what the gradients of a bucket that says nothing add up to by
#: chance, and its least value.
NOISE = 0.5
LEAST_L1 = 2.0
#: Buckets whose first sum stays below this share of the L1 part start each round anew.
CARRIED = 0.25
#: Words remembered per worker.
MEMO_WORDS = 200_000

_SIZE = (1 << WORD_BITS) + (1 << PAIR_BITS)
_WORDS = re.compile(r"[^\W\d_]+").findall
_STEPS = np.random.default_rng(11).integers(0, 2**64, REACH + 1, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """The buckets of a text, ascending, each once."""
    words = _WORDS((text or "").lower())
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    found = [hashes >> np.uint64(64 - WORD_BITS)]
    for gap in range(1, REACH + 1):
        pairs = common.mix(hashes[:-gap] * _STEPS[gap] + hashes[gap:])
        found.append((pairs >> np.uint64(64 - PAIR_BITS)) + np.uint64(1 << WORD_BITS))
    return np.unique(np.concatenate(found).astype(np.int32))


class Ftrl:
    """The two sums of every bucket, and of the constant at the end."""

    def __init__(self, l1: float, z: np.ndarray, n: np.ndarray) -> None:
        self.l1, self.z, self.n = l1, z, n
        self.seen = np.zeros(_SIZE + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / rate

    def bias(self) -> float:
        return float(-self.z[-1] / ((BETA + self.n[-1] ** 0.5) / ALPHA))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        own, bias = self.weights(at), self.bias()
        g = weight * (logistic(own.sum() + bias) - label)
        for place, w in ((at, own), (-1, bias)):
            n = self.n[place]
            self.z[place] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
            self.n[place] = n + g * g
            self.seen[place] += g * g


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


@dataclass(frozen=True)
class Weights:
    """The buckets with a weight, and the constant."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(_SIZE, np.float32)
        full[self.at] = self.weight
        return full


def score(at: np.ndarray, table: np.ndarray, bias: float) -> float:
    return logistic(float(table[at].sum(dtype=np.float64)) + bias)


def learned_labels(labels: DataFrame, learn: Column) -> tuple[DataFrame, float]:
    """(doc_id, toxic, weight) of the labels learned from, at most PER_LABEL of each kind, and the L1 part.

    Those with the smallest hash of the doc_id; weight is the number of the label's rows that
    each of them stands for.  A doc_id that is labelled several times is toxic if one row says so.
    """
    known = labels.filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit("toxic"), "doc_id")
    parts, chance = [], 0.0
    total = max(sum(counts.values()), 1)
    for toxic in (0, 1):
        n = counts.get(toxic, 0)
        weight = max(n / PER_LABEL, 1.0)
        own = known.filter(F.col("toxic") == toxic).orderBy(order, "doc_id").limit(PER_LABEL)
        parts.append(own.withColumn("weight", F.lit(weight)))
        chance += n * weight * counts.get(0, 0) * counts.get(1, 0) / total**2
    return parts[0].union(parts[1]), max(NOISE * (chance / SHARDS) ** 0.5, LEAST_L1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Weights:
    """Weights learned from the labels that `learn`, a condition on doc_id, picks.

    In: docs with doc_id and text, labels with doc_id and toxic (0 or 1; other rows are
    passed over).  Null texts are empty.  Without labels every score is one half.
    Only the states of SHARDS shards reach the driver, of a size that the numbers of
    buckets bound.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known, l1 = learned_labels(labels, learn)
    # Two times PER_LABEL rows at most.
    examples = rows.join(F.broadcast(known), "doc_id")
    key = F.xxhash64("doc_id", "text")
    examples = examples.select(
        F.pmod(key, F.lit(SHARDS)).cast("int").alias("shard"), key.alias("key"), "toxic", "weight", "text"
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [common.pack(common.differences(features(t.as_py()))) for t in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("at", pa.array(own, pa.binary()))

    kind = "shard int, key long, toxic int, weight double, at binary"
    hashed_rows = common.stored(
        examples.withColumn("toxic", F.col("toxic").cast("int")).mapInArrow(hashed, kind), "toxic"
    )
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    for number in range(ROUNDS):
        z, n = _round(hashed_rows, l1, z, n, number)
    state = Ftrl(l1, z, n)
    weights = state.weights(slice(0, _SIZE))
    at = np.flatnonzero(weights)
    return Weights(at.astype(np.int32), weights[at].astype(np.float32), state.bias())


def _round(
    rows: DataFrame, l1: float, z: np.ndarray, n: np.ndarray, number: int
) -> tuple[np.ndarray, np.ndarray]:
    """All shards learn from a state; the mixture of what they come to."""
    start = _packed(z, n, np.flatnonzero(n))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None

        def done() -> pa.RecordBatch:
            kept = np.abs(state.z) >= CARRIED * l1
            kept[-1] = True
            body = _packed(state.z, state.n, np.flatnonzero(kept), state.seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([body], pa.binary())], ["shard", "state"]
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if state is not None:
                        yield done()
                    shard, state = r["shard"], Ftrl(l1, *_unpacked(start)[:2])
                at = np.cumsum(common.unpack(r["at"], "i4")[0], dtype=np.int32)
                state.learn(at, r["toxic"], r["weight"])
        if state is not None:
            yield done()

    order = F.xxhash64(F.lit(number), "key")
    dealt = rows.repartitionById(SHARDS, F.col("shard")).sortWithinPartitions("shard", order, "key", "toxic")
    states = dealt.mapInArrow(learned, "shard int, state binary").collect()
    totals = np.zeros((3, _SIZE + 1))
    for r in sorted(states, key=lambda r: r.shard):
        own_z, own_n, seen = _unpacked(r.state)
        totals[0] += seen * own_z
        totals[1] += seen * own_n
        totals[2] += seen
    met = totals[2] > 0
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)
    z[met], n[met] = totals[0][met] / totals[2][met], totals[1][met] / totals[2][met]
    return z, n


def _packed(z: np.ndarray, n: np.ndarray, at: np.ndarray, seen: np.ndarray | None = None) -> bytes:
    seen = n if seen is None else seen
    values = [x[at].astype(np.float32) for x in (z, n, seen)]
    return common.pack(common.differences(at.astype(np.int32)), *values)


def _unpacked(body: bytes) -> list[np.ndarray]:
    steps, *values = common.unpack(body, "i4", "f4", "f4", "f4")
    at = np.cumsum(steps, dtype=np.int32)
    found = []
    for x in values:
        full = np.zeros(_SIZE + 1)
        full[at] = x
        found.append(full)
    return found


def toxicity(docs: DataFrame, model: Weights) -> DataFrame:
    """Adds score (0 to 1, higher: likelier toxic) and predicted (1 from one half on) to each row.

    Only the whole text decides; a null text scores as an empty one, by the constant alone.
    Columns named like the two are replaced.
    """
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            scores = np.array([score(features(t.as_py()), table, model.bias) for t in batch.column("text")])
            new = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *new], [*names, "score", "predicted"]
            )

    rows = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(judged, f"{kinds}, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """The rows that are not learned from: crc32 of the id as text, modulo 5, is 0."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0
