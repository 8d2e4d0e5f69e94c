"""Near-duplicate classes by MinHash with tensored banding, links verified on full sets.

A document's set holds its distinct five-word shingles.  Two collections of PIECES short
minhash tuples are computed, and every pair of a tuple of the first and a tuple of the
second is the key of one of PIECES**2 tables: 256 tables of six minhashes cost 96
minhashes, not 1536.  With PIECES = 16 tuples of three, a pair of similarity 0.75 misses
all tables with probability 3e-4, one of 0.8 with 2e-5, of 0.9 below 1e-8.

1.  Equal sets are one set, named by their smallest doc_id.
2.  In each table every set is compared with the smallest of its key: first inside a
    batch, then among the batches, so that a key of a third of all rows meets as many
    rows as there are batches and gives as many links as it has members.
3.  Pairs whose 96 minhashes agree in fewer than half are no links (five and more
    deviations away from 0.75); the others are verified on full sets made from texts.
4.  A set may be linked to another member of its key than the smallest.  Classes joined by pairs
    that agree in a third of the minhashes or more form clusters.  Inside a cluster the sets
    outside the largest class are compared, on full sets, with all others that share one of
    the rarest shingles of both; no linked pair of a cluster is without one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoloom.llm import common
from repoloom.llm.common import U64
from repoloom.llm.components import components

WORDS = 5
PIECES = 16
PIECE = 3
HASHES = 2 * PIECES * PIECE
#: Agreeing minhashes below which a pair is not verified.
LEAST_AGREEING = HASHES // 2
#: Agreeing minhashes from which sets belong to one cluster, where all pairs across classes are looked at.
LEAST_RELATED = HASHES // 3
#: Sets, and shingles, per block of a cluster on average.
BLOCK_SETS = 512
BLOCK_SHINGLES = 1 << 19
#: Sets that are made rows of shingles at a time.
SPREAD_SETS = 64

#: Bytes per block of the word pass, shingles per block of the minhash pass.
BLOCK = 1 << 20
SHINGLES = 1 << 16

_BYTES = common.byte_values(2)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_WORD_WEIGHTS = np.random.default_rng(5).integers(0, 2**63, WORDS, dtype=U64) * U64(2) + U64(1)
_A = np.random.default_rng(96).integers(0, 2**63, HASHES, dtype=U64) * U64(2) + U64(1)
_X = np.random.default_rng(97).integers(0, 2**64, HASHES, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        factors = np.full(max(n, BLOCK + 1), base, U64)
        factors[0] = 1
        _POWERS[base] = np.cumprod(factors)
    return _POWERS[base][:n]


def word_names(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of the lower-cased words of joined texts, and where each word begins."""
    names, places = [], []
    begins = borders[:-1]
    lo = 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        if hi < len(data):  # end at a space or at a text's end, wherever that is
            spaces = np.flatnonzero(_SPACE[data[lo:hi]])
            ends = begins[np.searchsorted(begins, lo, "right") : np.searchsorted(begins, hi, "right")]
            cut = max(lo + int(spaces[-1]) + 1 if len(spaces) else lo, int(ends[-1]) if len(ends) else lo)
            while cut == lo:
                ahead = np.flatnonzero(_SPACE[data[hi : hi + BLOCK]])
                after = np.searchsorted(begins, hi, "right")
                stop = int(begins[after]) if after < len(begins) else len(data)
                if len(ahead):
                    stop = min(stop, hi + int(ahead[0]) + 1)
                if stop <= hi + BLOCK or hi + BLOCK >= len(data):
                    cut = min(stop, len(data))
                hi += BLOCK
            hi = cut
        block = data[lo:hi]
        blank = _SPACE[block]
        edge = np.ones(hi - lo + 1, bool)
        edge[1:-1] = blank[:-1]
        own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, hi)] - lo
        edge[own] = True
        first = np.flatnonzero(~blank & edge[:-1])
        edge = np.ones(hi - lo, bool)
        edge[:-1] = blank[1:]
        edge[own[own > 0] - 1] = True
        last = np.flatnonzero(~blank & edge) + 1
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTES[_FOLD[block]] * _powers(_BASE, hi - lo), out=total[1:])
        word = (total[last] - total[first]) * _powers(_INVERSE, hi - lo)[first]
        names.append(common.mix(word + (last - first).astype(U64)))
        places.append(first + lo)
        lo = hi
    if not names:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(places)


def shingle_names(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all shingles of joined texts, with repeats, and n + 1 borders by text."""
    names, places = word_names(data, borders)
    cuts = np.searchsorted(places, borders)  # words before each text
    words = np.diff(cuts)
    total = names * _WORD_WEIGHTS[0]
    for k in range(1, WORDS):
        total[:-k] += names[k:] * _WORD_WEIGHTS[k]
    common.mix(total)
    keep = np.zeros(len(names), bool)
    counts = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    step = np.zeros(len(names) + 1, np.int64)
    np.add.at(step, cuts[:-1], 1)
    np.add.at(step, cuts[:-1] + counts, -1)
    keep = np.cumsum(step[:-1]) > 0
    for row in np.flatnonzero((words > 0) & (words < WORDS)):
        own = names[cuts[row] : cuts[row + 1]]
        sequence = own * _WORD_WEIGHTS[: len(own)]
        total[cuts[row]] = common.mix(sequence.sum(keepdims=True) + U64(len(own)))[0]
    return total[keep], np.concatenate([[0], np.cumsum(counts)])


def shingle_set(text: str | None) -> np.ndarray:
    """The set of one text, sorted."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(shingle_names(raw, np.array([0, len(raw)]))[0])


def _set_name(unique: np.ndarray) -> tuple[int, int]:
    if not len(unique):
        return 0, 0
    mixed = common.mix(unique + U64(1))
    return int(unique.sum().astype(np.int64)), int(np.bitwise_xor.reduce(mixed).astype(np.int64))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, cuts = shingle_names(*common.text_buffer(batch.column("text")))
        n = batch.num_rows
        sizes, set_a, set_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        least = np.zeros((n, HASHES), np.uint32)
        for row in range(n):
            unique = np.unique(names[cuts[row] : cuts[row + 1]])
            sizes[row] = len(unique)
            set_a[row], set_b[row] = _set_name(unique)
        filled = np.flatnonzero(sizes)
        at = 0
        while at < len(filled):
            end = max(np.searchsorted(cuts[filled], cuts[filled[at]] + SHINGLES), at + 1)
            rows = filled[at:end]
            # Long texts go in pieces; minima of pieces combine.
            for lo in range(int(cuts[rows[0]]), int(cuts[rows[-1] + 1]), 4 * SHINGLES):
                hi = min(lo + 4 * SHINGLES, int(cuts[rows[-1] + 1]))
                part = names[lo:hi]
                own = rows[(cuts[rows] < hi) & (cuts[rows + 1] > lo)]
                begin = np.maximum(cuts[own] - lo, 0)
                fresh = cuts[own] >= lo
                for k in range(HASHES):
                    values = (np.minimum.reduceat((part ^ _X[k]) * _A[k], begin) >> U64(32)).astype(np.uint32)
                    least[own, k] = np.where(fresh, values, np.minimum(values, least[own, k]))
            at = end
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row_key"),
                pa.array(sizes),
                pa.array(set_a),
                pa.array(set_b),
                pa.array([least[i].tobytes() if sizes[i] else None for i in range(n)], pa.binary()),
            ],
            ["doc_id", "row_key", "n_shingles", "set_a", "set_b", "sketch"],
        )


_SKETCHES = "doc_id long, row_key long, n_shingles long, set_a long, set_b long, sketch binary"


def _tables(sketch: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of all rows, table by table."""
    pieces = sketch.reshape(len(sketch), 2 * PIECES, PIECE)
    names = np.zeros((len(sketch), 2 * PIECES), U64)
    for k in range(PIECE):
        names = common.mix(names * U64(0x2545F4914F6CDD1D) + pieces[:, :, k].astype(U64) + U64(1))
    for i in range(PIECES):
        for j in range(PIECES):
            table = U64((i * PIECES + j + 1) * 0x9E3779B97F4A7C15 % 2**64)
            yield common.mix(names[:, i] * U64(3) + names[:, PIECES + j] + table)


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of a batch of sets, sorted by key, then by id."""
    sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32)
    sketch = sketch.reshape(-1, HASHES)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    by_id = np.argsort(ids, kind="stable")
    keys = np.concatenate(list(_tables(sketch[by_id])))
    rows = np.tile(by_id, PIECES**2)
    order = np.argsort(keys, kind="stable")
    return keys[order], rows[order]


def _bucket_rows(keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Packed (key without its top 16 bits, value) by bucket; the bucket has the top bits."""
    bucket = ((keys >> U64(48)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((values, bucket))
    bucket, keys, values = bucket[order], keys[order], values[order]
    return [
        (
            int(bucket[lo]),
            common.pack(
                keys[lo:hi].astype("<u4"),
                (keys[lo:hi] >> U64(32)).astype("<u4"),
                common.differences(values[lo:hi].astype("<i8")),
            ),
        )
        for lo, hi in common.groups_of([bucket])
    ]


_BUCKETS = "bucket long, body binary"


def _bucket_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
        ["bucket", "body"],
    )


def _unbucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(key, value) of the packed rows of a bucket, sorted."""
    parts = [common.unpack(x.as_py(), "<u4", "<u4", "<i8") for x in table.column("body")]
    keys = np.concatenate([x[0].astype(U64) | (x[1].astype(U64) << U64(32)) for x in parts])
    values = np.concatenate([np.cumsum(x[2]) for x in parts])
    order = np.lexsort((values, keys))
    return keys[order], values[order]


def _stars(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Distinct (smallest id of a key, other id) pairs; input sorted."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    head = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.unique(np.stack([head, ids], 1)[head != ids], axis=0)


def _meet(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Links inside a batch (bucket -1 and below), and the smallest id of each key for the rest."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = _keyed(batch)
        ids = batch.column("id").to_numpy(zero_copy_only=False)[rows]
        links = _stars(keys, ids)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        out = _bucket_rows(keys[new], ids[new], buckets)
        if len(links):
            body = common.pack(
                common.differences(links[:, 0].astype("<i8")), links[:, 1].astype("<i8")
            )
            out.append((-1 - int(links[0, 1]) % buckets, body))
        yield _bucket_batch(out)


def _links_of(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() < 0:
        parts = [common.unpack(x.as_py(), "<i8", "<i8") for x in table.column("body")]
        links = np.concatenate([np.stack([np.cumsum(x[0]), x[1]], 1) for x in parts])
    else:
        links = _stars(*_unbucket(table)) if table.num_rows > 1 else np.zeros((0, 2), np.int64)
    return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})


def _agreements(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links whose sketches agree in LEAST_RELATED values or more, with that number."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_sketch_rows(batch.column(c)) for c in ("sketch_a", "sketch_b"))
                same = (left == right).sum(1)
                found = batch.select(["a", "b", "name_a", "name_b"])
                found = found.append_column("agreeing", pa.array(same.astype(np.int32)))
                yield found.filter(pa.array(same >= LEAST_RELATED))

    side = lambda s: sets.select(
        F.col("id").alias(s),
        F.struct("set_a", "set_b").alias(f"name_{s}"),
        F.col("sketch").alias(f"sketch_{s}"),
    )
    kind = "struct<set_a: long, set_b: long>"
    return (
        links.join(side("a"), "a")
        .join(side("b"), "b")
        .select("a", "b", "name_a", "name_b", "sketch_a", "sketch_b")
        .mapInArrow(agreeing, f"a long, b long, name_a {kind}, name_b {kind}, agreeing int")
    )


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full sets, packed; rows of the same doc_id that hold another set are passed over."""
    for batch in batches:
        own = [shingle_set(x.as_py()) for x in batch.column("text")]
        named = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
        right = pa.array([_set_name(x) == name for x, name in zip(own, named, strict=True)], pa.bool_())
        rows = batch.drop_columns(["text"])
        rows = rows.append_column("shingles", pa.array([x.tobytes() for x in own], pa.binary()))
        yield rows.filter(right)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each set."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SPREAD_SETS):
            part = batch.slice(lo, SPREAD_SETS)
            sets = [np.frombuffer(x.as_py(), np.int64) for x in part.column("shingles")]
            at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            rows = part.drop_columns(["shingles"]).take(pa.array(at))
            yield rows.append_column("shingle", pa.array(np.concatenate(sets)))


def _candidates(placed: DataFrame) -> DataFrame:
    """Pairs of sets of different classes of a cluster, one of them outside its largest class,
    that may be linked: a, set_a and block_a, and b, set_b and block_b.

    Linked sets share at least three quarters of each, so the first quarter of both (and one
    more), in any order of all shingles, has a shingle in common; the first one they share must
    leave room for the rest.  The rarest come first.  A shingle of many sets is dealt by blocks
    of both sides, BLOCK_SETS sets a side.
    """
    rows = placed.withColumn("small", F.col("class") != F.col("largest"))
    rows = rows.select("id", "set_a", "n", "class", "cluster", "small", "blocks", "shingles")
    kinds = "id long, set_a long, n long, class long, cluster long, small boolean, blocks long, shingle long"
    spread = rows.mapInArrow(_spread, kinds)
    counted = spread.groupBy("cluster", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    by_set = Window.partitionBy("id", "set_a").orderBy(F.coalesce("holders", F.lit(1)), "shingle")
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    first = common.stored(
        spread.join(counted, ["cluster", "shingle"], "left")
        .withColumn("place", F.row_number().over(by_set))
        .filter("holders > 1 and place <= n - (3 * n + 3) div 4 + 1")
        .withColumn("parts", F.ceil(F.col("holders") / BLOCK_SETS).cast("long"))
        .withColumns({"part": block(F.col("parts")), "block": block(F.col("blocks"))})
        .select("cluster", "shingle", "id", "set_a", "n", "class", "small", "place", "parts", "part", "block"),
        "first",
    )
    every = F.explode(F.expr("sequence(0L, parts - 1)"))

    def side(df: DataFrame, s: str, own: str, other: str) -> DataFrame:
        named = {"id": s, "set_a": f"set_{s}", "part": own, "block": f"block_{s}"}
        named |= {c: f"{c}_{s}" for c in ("n", "class", "small", "place")}
        return df.withColumn(other, every).drop("parts").withColumnsRenamed(named)

    return (
        side(first.filter("small"), "a", "part_a", "part_b")
        .join(side(first, "b", "part_b", "part_a"), ["cluster", "shingle", "part_a", "part_b"])
        .filter("class_a <> class_b and (a < b or not small_b)")
        .filter("7 * least(n_a - place_a + 1, n_b - place_b + 1) >= 3 * (n_a + n_b)")
        .select("cluster", "a", "set_a", "block_a", "b", "set_b", "block_b")
        .distinct()
    )


def _compared(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The links among pairs of two blocks, but for those between classes that are joined already."""
    named = (sets.column(c).to_pylist() for c in ("id", "set_a", "class", "shingles"))
    full = {(i, name): (own, np.frombuffer(x, U64)) for i, name, own, x in zip(*named, strict=True)}
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    found: list[tuple[int, int]] = []
    for a, set_a, b, set_b in zip(*(pairs.column(c).to_pylist() for c in ("a", "set_a", "b", "set_b")), strict=True):
        (class_a, one), (class_b, two) = full[a, set_a], full[b, set_b]
        class_a, class_b = root(class_a), root(class_b)
        if class_a == class_b:
            continue
        shared = len(np.intersect1d(one, two, assume_unique=True))
        if 100 * shared >= 75 * (len(one) + len(two) - shared):
            above[class_a] = class_b
            found.append((a, b))
    return pa.table({c: pa.array([p[k] for p in found], pa.int64()) for k, c in enumerate("ab")})


def _rest(related: DataFrame, sets: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different classes, inside clusters of classes that are related.

    The pairs to compare come from a join on rare shingles; they are compared on full sets,
    block by block of a cluster, BLOCK_SETS sets a side.
    """
    named = lambda s: classes.select(F.col("id").alias(s), F.col("component").alias(f"class_{s}"))
    cross = (
        related.select("a", "b")
        .join(named("a"), "a", "left")
        .join(named("b"), "b", "left")
        .select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
        .filter("a <> b")
    )
    clusters = components(cross).select(F.col("id").alias("class"), F.col("component").alias("cluster"))
    members = common.stored(
        sets.select("id", "set_a", "set_b", "n")
        .join(classes, "id", "left")
        .select("id", "set_a", "set_b", "n", F.coalesce("component", "id").alias("class"))
        .join(clusters, "class"),
        "members",
    )
    sizes = members.groupBy("cluster", "class").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    full = F.greatest(F.sum("sets") / BLOCK_SETS, F.sum("shingles") / BLOCK_SHINGLES)
    sizes = sizes.groupBy("cluster").agg(
        F.max(F.struct("sets", "class"))["class"].alias("largest"),
        F.ceil(full).cast("long").alias("blocks"),
    )
    columns = ("id", "class", "cluster", "largest", "blocks", "n", "set_a", "set_b")
    kinds = ", ".join(f"{c} long" for c in columns) + ", shingles binary"
    placed = common.stored(
        members.join(sizes, "cluster")
        .join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
        .select(*columns, "text")
        .mapInArrow(_shingled, kinds)
        .dropDuplicates(["id", "set_a", "set_b"]),  # rows that repeat both doc_id and set
        "placed",
    )
    pairs = common.stored(_candidates(placed), "candidates")
    at = ["cluster", "block_a", "block_b"]
    used = pairs.select(*at, F.col("a").alias("id"), "set_a")
    used = used.union(pairs.select(*at, F.col("b").alias("id"), "set_b")).distinct()
    used = common.stored(used, "used").join(placed.select("id", "set_a", "class", "shingles"), ["id", "set_a"])
    links = pairs.groupBy(*at).cogroup(used.groupBy(*at)).applyInArrow(_compared, "a long, b long")
    return common.stored(links.distinct(), "rest")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0, U64))
    for batch in batches:
        found = []
        for r in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
            a, b, name_a, name_b, text_b, text_a = (x.as_py() for x in r)
            if text_a != last[0]:
                last = (text_a, shingle_set(text_a))
            one, two = last[1], shingle_set(text_b)
            names = (tuple(name_a.values()), tuple(name_b.values()))
            if (_set_name(one), _set_name(two)) != names:
                continue  # another row of the same doc_id
            common_ = len(np.intersect1d(one, two, assume_unique=True))
            if 100 * common_ >= 75 * (len(one) + len(two) - common_):
                found.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]
        )


def _verified(links: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """The links that hold on the full sets."""
    texts = docs.select("doc_id", "text")
    with_texts = (
        links.filter(F.col("agreeing") >= LEAST_AGREEING)
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "name_a", "name_b", "text_b", "text_a")
    )
    return common.stored(with_texts.mapInArrow(_confirm, "a long, b long").distinct(), name)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of documents linked by 100 * |A and B| >= 75 * |A or B| on shingle sets.

    In: doc_id long, text string; other columns are ignored.  Out, a row per row: doc_id,
    n_shingles (size of the set), component_id (smallest doc_id reachable), kept
    (doc_id = component_id), and row_key, which tells rows of one doc_id apart by their texts.

    Words are lower-cased (A-Z) runs of anything but blanks; texts of one to four words
    have one shingle; texts without words, and nulls, have none and stay alone.  Equal
    texts are linked.  A doc_id that occurs twice gets a row for each.  Rows without
    doc_id take part under the smallest long and come back with null in both ids.
    """
    spark = docs.sparkSession
    buckets = 2 * common.tasks(spark)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        common.row_key(F.col("text")).alias("row_key"),
        "text",
    )
    sketched = common.stored(rows.mapInArrow(_sketches, _SKETCHES), "sketches")
    sets = common.stored(
        sketched.filter("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(
            F.min("doc_id").alias("id"),
            F.min_by("sketch", "doc_id").alias("sketch"),
            F.max("n_shingles").alias("n"),
        )
        .repartition(common.tasks(spark), "id"),
        "sets",
    )
    links = common.stored(
        sets.select("id", "sketch")
        .mapInArrow(lambda x: _meet(x, buckets), _BUCKETS)
        .groupBy("bucket")
        .applyInArrow(_links_of, "a long, b long")
        .distinct(),
        "links",
    )
    related = common.stored(_agreements(links, sets), "related")
    sure = _verified(related, rows, "sure")
    classes = common.stored(components(sure), "classes")
    more = _rest(related, sets, classes, rows)
    stars = classes.select(F.col("component").alias("a"), F.col("id").alias("b"))
    classes = common.stored(components(stars.union(more)), "classes")
    named = sets.select("set_a", "set_b", "id").join(classes, "id", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "id").alias("component_id"))
    lone = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return (
        sketched.drop("sketch")
        .join(named, ["set_a", "set_b"], "left")
        .withColumn(
            "component_id",
            F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")),
        )
        .select(
            lone.alias("doc_id"),
            "n_shingles",
            F.when(F.col("component_id") != -(2**63), F.col("component_id")).alias("component_id"),
            (F.col("doc_id") == F.col("component_id")).alias("kept"),
            "row_key",
        )
    )
