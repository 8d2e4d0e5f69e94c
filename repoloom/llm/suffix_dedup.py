"""Removal of byte strings that earlier documents hold, by distributed prefix doubling.

A position's rank for a length says which string of that length starts there.
Ranks of 2k bytes are pairs of ranks of k bytes, the second taken at offset k; the
offsets grow 1, 2, 4, 8, 16, 10 (26 bytes), 24 (50 bytes).  Ranks are 64-bit names of
the pairs, so a task doubles its own texts without asking others.  Spark sorts
(rank pair, document) tables and drops the positions whose rank is unique:

1.  Ranks of 26 bytes.  Not every position is sorted: in each 50-byte string the
    26-byte rank that is smallest stands for it, so equal strings share their
    representative at equal offset, and one position in thirteen is enough.
    Neighbouring strings with one representative form a segment; its second rank
    names all its bytes.  A segment that a smaller document holds is removed whole; a
    position whose first rank nobody shares is unique and leaves.
2.  Where the first ranks agree and the second ones differ, the 50-byte ranks of the
    single positions are sorted.

Tables carry packed arrays, one row per batch of texts and bucket of ranks, and a batch
sends each rank once: a passage held by a third of all documents meets as many rows
as there are batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common
from repoloom.llm.common import U64

#: Bytes per block of the numeric passes; bounds their memory.
BLOCK = 1 << 20
HALF = 26
LENGTH = 50
WINDOW = LENGTH - HALF + 1  # ranks of HALF bytes inside LENGTH bytes

_BYTES = common.byte_values(50)
_EMITTED = "kind int, bucket long, batch long, body binary"
_ENTRY = ("<u4", "<u4", "<u2", "<i8", "<u4", "u1")  # rank, second rank (48 bits), doc_id, place, windows
_FOUND = "doc_id long, row_key long, removed binary, open binary"


def _pair(ranks: np.ndarray, offset: int) -> np.ndarray:
    """Ranks of longer strings from pairs of ranks `offset` apart."""
    out = ranks[:-offset] * U64(0x9E3779B97F4A7C15)
    out += ranks[offset:]
    out ^= out >> U64(29)
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(32)
    return out


def _ranks(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of HALF and of LENGTH bytes at every position."""
    ranks = _BYTES[block]
    for offset in (1, 2, 4, 8, HALF - 16):
        ranks = _pair(ranks, offset)
    return ranks, _pair(ranks, LENGTH - HALF)


def _inside(borders: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Whether a string of LENGTH bytes from each position in [lo, hi) ends in its text."""
    fits = np.ones(hi - lo, bool)
    first, last = np.searchsorted(borders, (lo, hi + LENGTH), "right")
    for end in borders[max(first, 1) : last]:
        fits[max(0, end - LENGTH + 1 - lo) : max(0, end - lo)] = False
    return fits


def segments(data: np.ndarray, borders: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: (rank, second rank, place, number of strings) of the segments of joined texts."""
    for lo in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        hi = min(lo + BLOCK, len(data) - LENGTH + 1)
        half, full = _ranks(data[lo : hi + LENGTH - 1])
        least = half & ~U64((1 << 22) - 1)
        least |= np.arange(len(half), dtype=U64)
        for step in (1, 2, 4, 8, WINDOW - 16):
            least = np.minimum(least[:-step], least[step:])
        least &= U64((1 << 22) - 1)
        at = np.flatnonzero(_inside(borders, lo, hi))
        if not len(at):
            continue
        least = least[at].astype(np.int64)
        breaks = np.flatnonzero((least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first = at[np.concatenate([[0], breaks])]
        last = at[np.concatenate([breaks - 1, [len(at) - 1]])]
        anchor = least[np.concatenate([[0], breaks])]
        second = full[first] * U64(0xD6E8FEB86659FD93)
        second ^= full[last]
        second = common.mix(second + (last - first).astype(U64) * U64(0xA0761D6478BD642F))
        second = common.mix(second + (anchor - first).astype(U64))
        yield half[anchor], second, first + lo, last - first + 1


def _sorted_by_rank(rank, second, doc, place):
    return np.lexsort((place, doc, second, rank))


def _entries(rank, second, doc, place, windows) -> bytes:
    order = np.argsort(place, kind="stable")
    rank, second, doc, place, windows = (x[order] for x in (rank, second, doc, place, windows))
    return common.pack(
        rank.astype("<u4"),
        (second & U64(0xFFFFFFFF)).astype("<u4"),
        ((second >> U64(32)) & U64(0xFFFF)).astype("<u2"),
        common.differences(doc.astype("<i8")),
        common.differences(place.astype("<u4")),
        windows.astype("u1"),
    )


def _emit(batches: Iterator[pa.RecordBatch], buckets: int, windows_of=None) -> Iterator[pa.RecordBatch]:
    """Rows for the sort, what the batch settles by itself, and where its documents lie."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys = batch.column("row_key").to_numpy(zero_copy_only=False)
        data, borders = common.text_buffer(batch.column("text"))
        name = hashlib.blake2b(ids.tobytes() + keys.tobytes() + borders.tobytes(), digest_size=8)
        name = int.from_bytes(name.digest(), "little", signed=True)
        if windows_of is None:
            parts = list(segments(data, borders))
        else:
            parts = list(windows_of(batch, data, borders))
        rows = [(2, name % buckets, name, common.pack(ids, keys, borders[:-1].astype("<i8")))]
        if parts:
            rank, second, place, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc = ids[np.searchsorted(borders, place, "right") - 1]
            order = _sorted_by_rank(rank, second, doc, place)
            rank, second, doc, place, windows = (
                x[order] for x in (rank, second, doc, place, windows)
            )
            new = np.ones(len(rank), bool)
            new[1:] = (rank[1:] != rank[:-1]) | (second[1:] != second[:-1])
            smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            later = doc > smallest
            if later.any():
                where = np.argsort(place[later], kind="stable")
                gone = common.pack(
                    common.differences(place[later][where].astype("<u4")),
                    windows[later][where].astype("u1"),
                )
                rows.append((1, name % buckets, name, gone))
            keep = ~later
            rank, second, doc, place, windows = (
                x[keep] for x in (rank, second, doc, place, windows)
            )
            bucket = (rank >> U64(32)) % U64(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            for lo, hi in common.groups_of([bucket]):
                own = order[lo:hi]
                body = _entries(rank[own], second[own], doc[own], place[own], windows[own])
                rows.append((0, int(bucket[lo]), name, body))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.binary()),
            ],
            ["kind", "bucket", "batch", "body"],
        )


def _rerank(table: pa.Table) -> pa.Table:
    """One bucket: which entries a smaller document holds (kind 1), which stay open (kind 3)."""
    kinds = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kinds != 0))
    table = table.filter(pa.array(kinds == 0))
    out = [passed]
    if table.num_rows:
        names = table.column("batch").to_numpy()
        bodies = [common.unpack(x.as_py(), *_ENTRY) for x in table.column("body")]
        size = [len(x[0]) for x in bodies]
        rank = np.concatenate([x[0] for x in bodies])
        second = np.concatenate([x[1].astype(U64) | (x[2].astype(U64) << U64(32)) for x in bodies])
        doc = np.concatenate([np.cumsum(x[3]) for x in bodies])
        place = np.concatenate([np.cumsum(x[4], dtype=np.uint32) for x in bodies])
        windows = np.concatenate([x[5] for x in bodies])
        batch = np.repeat(np.arange(len(bodies)), size)
        del bodies
        # Nothing to do for a rank that one entry alone holds.
        order = np.argsort(rank, kind="stable")
        near = np.zeros(len(rank) + 1, bool)
        near[1:-1] = rank[order][1:] == rank[order][:-1]
        order = order[near[1:] | near[:-1]]
        rank, second, doc, place, windows, batch = (
            x[order] for x in (rank, second, doc, place, windows, batch)
        )
        order = np.lexsort((doc, second, rank))
        rank, second, doc, place, windows, batch = (
            x[order] for x in (rank, second, doc, place, windows, batch)
        )
        new_rank = np.ones(len(rank), bool)
        new_rank[1:] = rank[1:] != rank[:-1]
        new = new_rank.copy()
        new[1:] |= second[1:] != second[:-1]
        later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else np.zeros(0, bool)
        names_of_rank = np.add.reduceat(new, np.flatnonzero(new_rank)) if len(doc) else new
        open_ = ~later & (windows > 0)
        if len(doc):
            open_ &= (names_of_rank > 1)[np.cumsum(new_rank) - 1]
        for kind, which in ((1, later), (3, open_)):
            own = np.flatnonzero(which)
            own = own[np.lexsort((place[own], batch[own]))]
            rows = [
                (
                    names[batch[own[lo]]],
                    common.pack(common.differences(place[own[lo:hi]]), windows[own[lo:hi]]),
                )
                for lo, hi in common.groups_of([batch[own]])
            ]
            out.append(
                pa.table(
                    {
                        "kind": pa.array([kind] * len(rows), pa.int32()),
                        "bucket": pa.array([0] * len(rows), pa.int64()),
                        "batch": pa.array([r[0] for r in rows], pa.int64()),
                        "body": pa.array([r[1] for r in rows], pa.binary()),
                    }
                )
            )
    return pa.concat_tables([x.cast(passed.schema) for x in out])


def _per_document(table: pa.Table) -> pa.Table:
    """One batch: places become (start, strings) pairs of its documents."""
    kinds = table.column("kind").to_numpy()
    bodies = table.column("body")
    ids, keys, begins = common.unpack(
        bodies[int(np.flatnonzero(kinds == 2)[0])].as_py(), "<i8", "<i8", "<i8"
    )
    packed: dict[int, list[bytes | None]] = {}
    for slot, kind in ((0, 1), (1, 3)):
        parts = [
            common.unpack(bodies[int(i)].as_py(), "<u4", "u1") for i in np.flatnonzero(kinds == kind)
        ]
        if not parts:
            continue
        place = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts]).astype(np.int64)
        windows = np.concatenate([x[1] for x in parts])
        order = np.argsort(place, kind="stable")
        place, windows = place[order], windows[order]
        owner = np.searchsorted(begins, place, "right") - 1
        for lo, hi in common.groups_of([owner]):
            at = (place[lo:hi] - begins[owner[lo]]).astype("<i4")
            packed.setdefault(int(owner[lo]), [None, None])[slot] = common.pack(
                common.differences(at), windows[lo:hi]
            )
    owners = sorted(packed)
    return pa.table(
        {
            "doc_id": pa.array(ids[owners], pa.int64()),
            "row_key": pa.array(keys[owners], pa.int64()),
            "removed": pa.array([packed[x][0] for x in owners], pa.binary()),
            "open": pa.array([packed[x][1] for x in owners], pa.binary()),
        }
    )


def _positions(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [common.unpack(x, "<i4", "u1") for x in values]
    start = np.concatenate([np.cumsum(x[0], dtype=np.int32) for x in parts]).astype(np.int64)
    return start, np.concatenate([x[1] for x in parts]).astype(np.int64)


def _open_windows(batch: pa.RecordBatch, data: np.ndarray, borders: np.ndarray):
    """Ranks of LENGTH bytes of the strings that are still open."""
    begin, count = [], []
    for row, value in enumerate(batch.column("open")):
        start, windows = _positions([value.as_py()])
        begin.append(start + borders[row])
        count.append(windows)
    if not begin:
        return
    begin, count = np.concatenate(begin), np.concatenate(count)
    total = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    places = np.unique(total + np.arange(int(count.sum())))
    for lo in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        hi = min(lo + BLOCK, len(data) - LENGTH + 1)
        own = places[np.searchsorted(places, lo) : np.searchsorted(places, hi)]
        if len(own):
            _, full = _ranks(data[lo : hi + LENGTH - 1])
            rank = full[own - lo]
            yield rank, common.mix(rank + U64(1)), own, np.zeros(len(own), np.int64)


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, lists = (batch.column(x) for x in ("doc_id", "text", "removed"))
        rows = []
        for doc_id, text, values in zip(ids, texts, lists, strict=True):
            raw = (text.as_py() or "").encode()
            values = [v for v in (values.as_py() or []) if v is not None]
            spans: list[tuple[int, int]] = []
            kept = raw
            if values:
                start, windows = _positions(values)
                # 0 strings stands for the single one of the last round.
                end = start + np.maximum(windows, 1) + LENGTH - 1
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(end[order])
                fresh = np.ones(len(start), bool)
                fresh[1:] = start[1:] > reach[:-1]
                first = np.flatnonzero(fresh)
                last = np.concatenate([first[1:] - 1, [len(start) - 1]])
                spans = list(zip(start[first].tolist(), reach[last].tolist(), strict=True))
                pieces, at = [], 0
                for lo, hi in spans:
                    pieces.append(raw[at:lo])
                    at = hi
                kept = b"".join([*pieces, raw[at:]])
            rows.append(
                {
                    "doc_id": doc_id.as_py(),
                    "n_bytes": len(raw),
                    "n_removed": len(raw) - len(kept),
                    "n_spans": len(spans),
                    "kept_sha256": hashlib.sha256(kept).hexdigest(),
                    "spans": [{"start": a, "end": b} for a, b in spans],
                    "kept": kept,
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.binary()),
    ]
)
_RESULT_DDL = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "spans array<struct<start: long, end: long>>, kept binary"
)


def _sorted_round(rows: DataFrame) -> DataFrame:
    schema = _EMITTED
    return (
        rows.groupBy("bucket")
        .applyInArrow(_rerank, schema)
        .groupBy("batch")
        .applyInArrow(_per_document, _FOUND)
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes every byte that lies in a 50-byte string which a smaller doc_id also holds.

    In: doc_id long, text string; other columns are ignored.  Out, a row per row:
    doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs, byte offsets,
    end exclusive) and kept (the remaining bytes, which may cut a character).

    Texts are UTF-8 bytes; a null is empty; texts below 50 bytes lose nothing; an empty
    table gives an empty one.  Strings are judged on the input.  Rows with the same
    doc_id don't remove each other's bytes.  A null doc_id comes before all others.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text"
    ).withColumn("row_key", common.row_key(F.col("text")))
    buckets = 2 * common.tasks(spark)
    found = common.stored(
        _sorted_round(rows.mapInArrow(lambda x: _emit(x, buckets), _EMITTED)), "repeats"
    )
    still = found.filter(F.col("open").isNotNull()).select("doc_id", "row_key", "open")
    closed = _sorted_round(
        rows.join(still.distinct(), ["doc_id", "row_key"]).mapInArrow(
            lambda x: _emit(x, buckets, _open_windows), _EMITTED
        )
    )
    removed = (
        found.select("doc_id", "row_key", "removed")
        .unionByName(closed.select("doc_id", "row_key", "removed"))
        .filter(F.col("removed").isNotNull())
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list("removed").alias("removed"))
    )
    return (
        rows.join(removed, ["doc_id", "row_key"], "left")
        .select("doc_id", "text", "removed")
        .mapInArrow(_result, _RESULT_DDL)
        .withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
    )
