"""Alignment of two tokenizers' ids by the bytes they stand for.

Equal texts are tokenized once: the rows are shuffled by their full text, each distinct text
is cut into tokens A and tokens B, and byte offsets where both end cut these into groups.  An A
and a B token of one group are linked.  How many documents hold a pair of ids linked is
counted over the distinct texts, each counting as often as it occurs, and what the counts say of a text
goes back to all its doc_ids.

The counts are looked up by blocks of texts: a block's distinct pairs meet the counts once,
however many of its texts hold them, and come back to the block.  No table of counts is
broadcast or held by a task.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common
from repoloom.llm.token_files import _byte_letters

#: Characters of text per block, but for the last text, which is taken whole.
BLOCK = 4 << 20
#: Characters of text aligned at a time, of so many rows at most.
STEP = 3 << 20
ROWS = 1500
#: Links of a group from which its ids are counted before they are paired.
LARGE_GROUP = 4096

# Both tokenizers end a token where blanks follow other characters: a byte-level one cuts words
# with the blanks before them, and of the pieces none goes on over a blank.  That holds for spaces
# and line feeds; a text with other blanks is one part.
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_OTHER_BLANKS = re.compile(r"[^\S \n]").search

_ALIGNERS: dict[tuple[str, str], Aligner] = {}

class _Decimal(dict):
    """Ids as text; as many as the vocabularies hold."""

    def __missing__(self, i: int) -> str:
        return self.setdefault(i, str(i))


_DECIMAL = _Decimal()
_NO_KEYS = np.zeros(0, np.int64)


class Aligner:
    """Two tokenizers, and the alignment of texts; of texts taken together, each distinct part is aligned once."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        # Tasks share the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in enumerate(_byte_letters())}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = {
            i: bytes(map(letters.__getitem__, name)) if set(name) <= letters.keys() else name.encode()
            for name, i in names.items()
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.space = self.b.piece_to_id("▁")
        # A part is encoded by itself only where no piece goes on over a blank.
        self.cut = not any("▁" in p.lstrip("▁") or ("\n" in p and len(p) > 1) for p in pieces)
        # By id; an id that names nothing has no bytes.
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.sizes_a[i] = len(x)
        self.sizes_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Aligner:
        key = path_a, path_b
        if key not in _ALIGNERS:
            _ALIGNERS[key] = cls(path_a, path_b)
        return _ALIGNERS[key]

    def _parts(self, text: str) -> list[str]:
        return _PARTS(text) if self.cut and not _OTHER_BLANKS(text) else [text]

    def _ids_b(self, parts: list[str]) -> list[list[int]]:
        """B ids of parts, each with a blank in front.  The tokenizer itself puts a space before
        what it gets: a part's first space is left to it, and before a line feed its own is taken off."""
        found = self.b.encode([p[1:] if p[0] == " " else p for p in parts], num_threads=1)
        return [
            ids[1:] if p[0] == "\n" else ids or [self.space] for p, ids in zip(parts, found, strict=True)
        ]

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """For each text, with its space in front: n_a, n_b, n_groups, n_links, the groups' sha256,
        and the distinct pair keys, ascending, with the number of links of each."""
        every = [self._parts(x) for x in texts]
        place = dict.fromkeys(chain.from_iterable(every))
        for k, p in enumerate(place):
            place[p] = k
        flat = np.fromiter(map(place.__getitem__, chain.from_iterable(every)), np.int64, sum(map(len, every)))
        text = np.repeat(np.arange(len(texts)), [len(own) for own in every])
        parts = self._aligned(list(place))
        bad = np.bincount(text, parts.bad[flat], len(texts)) > 0
        totals = [
            np.bincount(text, x[flat], len(texts)).astype(np.int64).tolist() for x in parts.numbers
        ]
        keys, times, borders = parts.links(flat, text, len(texts))
        at = 0
        for i, own in enumerate(every):
            shown = ";".join([parts.shown[k] for k in flat[at : at + len(own)].tolist()])
            at += len(own)
            if bad[i]:
                yield 0, 0, 0, 0, "", _NO_KEYS, _NO_KEYS
                continue
            digest = hashlib.sha256(shown.encode()).hexdigest()
            lo, hi = borders[i : i + 2]
            yield *(x[i] for x in totals), digest, keys[lo:hi], times[lo:hi]

    def _aligned(self, parts: list[str]) -> _Parts:
        lists_a = [x.ids for x in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        lists_b = self._ids_b(parts)
        raw = [p.encode() for p in parts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        side_a, side_b = _Side(lists_a, self.sizes_a), _Side(lists_b, self.sizes_b)
        bad = self._unequal(side_a, lists_a, self.bytes_a, raw, sizes)
        bad |= self._unequal(side_b, lists_b, self.bytes_b, raw, sizes)
        if bad.any():
            for k in np.flatnonzero(bad).tolist():  # stands for nothing; its texts have no tokens
                lists_a[k], lists_b[k], sizes[k] = [], [], 0
            side_a, side_b = _Side(lists_a, self.sizes_a), _Side(lists_b, self.sizes_b)
        return _Parts(bad, sizes, side_a, side_b)

    @staticmethod
    def _unequal(side: _Side, lists: list, names, raw: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """The parts whose tokens' bytes aren't their own."""
        ends = np.concatenate([[0], side.ends])[np.cumsum(side.counts)]
        bad = np.diff(ends, prepend=0) != sizes
        good = np.flatnonzero(~bad).tolist()
        made = b"".join([names[i] for k in good for i in lists[k]])
        if made != b"".join([raw[k] for k in good]):
            for k in good:
                bad[k] = b"".join([names[i] for i in lists[k]]) != raw[k]
        return bad


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about STEP characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= STEP:
            yield texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield texts[first:]


class _Side:
    """One tokenizer's tokens of all parts, one behind the other, and the bytes each ends at."""

    def __init__(self, lists: list[list[int]], sizes: np.ndarray) -> None:
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.fromiter(chain.from_iterable(lists), np.int64, int(self.counts.sum()))
        self.ends = np.cumsum(sizes[self.ids])


class _Parts:
    """Distinct parts, aligned: groups end where tokens of both sides end, as at the end of each part."""

    def __init__(self, bad: np.ndarray, sizes: np.ndarray, a: _Side, b: _Side) -> None:
        self.bad = bad
        ends = np.intersect1d(a.ends, b.ends, assume_unique=True)
        # First tokens of the groups, and one more border.
        self.starts_a = np.concatenate([[0], np.searchsorted(a.ends, ends) + 1])
        self.starts_b = np.concatenate([[0], np.searchsorted(b.ends, ends) + 1])
        p, q = np.diff(self.starts_a), np.diff(self.starts_b)
        part = np.searchsorted(np.cumsum(sizes), ends)
        n = len(bad)
        groups = np.bincount(part, minlength=n)
        links = np.bincount(part, p * q, n).astype(np.int64)
        self.numbers = a.counts, b.counts, groups, links
        self.shown = self._shown(a, b, groups)
        self._link(a.ids, b.ids, p, q, part, n)

    def _shown(self, a: _Side, b: _Side, groups: np.ndarray) -> list[str]:
        names_a = list(map(_DECIMAL.__getitem__, a.ids.tolist()))
        names_b = list(map(_DECIMAL.__getitem__, b.ids.tolist()))
        at_a, at_b = self.starts_a.tolist(), self.starts_b.tolist()
        own = [
            f"{names_a[x]}|{names_b[y]}"
            if x + 1 == xx and y + 1 == yy
            else f"{','.join(names_a[x:xx])}|{','.join(names_b[y:yy])}"
            for x, xx, y, yy in zip(at_a, at_a[1:], at_b, at_b[1:], strict=False)
        ]
        found, at = [], 0
        for n in groups.tolist():
            found.append(own[at] if n == 1 else ";".join(own[at : at + n]))
            at += n
        return found

    def _link(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, part: np.ndarray, n: int) -> None:
        """Pair keys and times of all groups, by part."""
        large = np.flatnonzero(p * q > LARGE_GROUP)
        size = p * q
        size[large] = 0
        group = np.repeat(np.arange(len(p)), size)
        k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        left = a[self.starts_a[group] + k // q[group]]
        keys, owner = left << 32 | b[self.starts_b[group] + k % q[group]], part[group]
        times = np.ones(len(keys), np.int64)
        for g in large.tolist():  # distinct ids, and how often each occurs
            one_a, n_a = np.unique(a[self.starts_a[g] : self.starts_a[g + 1]], return_counts=True)
            one_b, n_b = np.unique(b[self.starts_b[g] : self.starts_b[g + 1]], return_counts=True)
            keys = np.concatenate([keys, (one_a[:, None] << 32 | one_b).ravel()])
            times = np.concatenate([times, (n_a[:, None] * n_b).ravel()])
            owner = np.concatenate([owner, np.full(len(one_a) * len(one_b), part[g])])
        if len(large):
            order = np.argsort(owner, kind="stable")
            keys, times, owner = keys[order], times[order], owner[order]
        self.keys, self.times = keys, times
        self.counts = np.bincount(owner, minlength=n)

    def links(self, flat: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of each text, ascending, their times, and the texts' borders among them."""
        counts = self.counts[flat]
        first = (np.cumsum(self.counts) - self.counts)[flat]
        at = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
        keys, times, owner = self.keys[at], self.times[at], np.repeat(text, counts)
        order = np.lexsort((keys, owner))
        keys, times, owner = keys[order], times[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(fresh)
        summed = np.add.reduceat(times, at) if len(at) else times
        return keys[at], summed, np.searchsorted(owner[at], np.arange(n + 1))


_ALIGNED = (
    "block long, digest binary, n_a long, n_b long, n_groups long, n_links long,"
    " groups_sha256 string, links binary"
)
_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _align(path_a: str, path_b: str):
    """Rows of distinct texts (digest, times, text) to aligned ones, and one more row per block
    with null digest: its distinct pairs and how many documents hold each."""
    schema = pa.schema(
        [("block", pa.int64()), ("digest", pa.binary())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups_sha256", pa.string()), ("links", pa.binary())]
    )

    def packed(keys: np.ndarray, times: np.ndarray) -> bytes:
        return common.pack(common.differences(keys), times)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        keys, weights, size = [], [], 0

        def summed() -> list:
            every, weight = np.concatenate(keys), np.concatenate(weights)
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            fresh = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            body = packed(every[fresh], np.add.reduceat(weight, fresh))
            return [block, None, 0, 0, 0, 0, None, body]

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
            rows = []
            texts = [f" {t}" for t in batch.column("text").to_pylist()]
            facts = zip(batch.column("digest").to_pylist(), batch.column("times").to_pylist(), strict=True)
            found = (x for step in _steps(texts) for x in aligner.align(step))
            for (digest, times), text, own in zip(facts, texts, found, strict=True):
                *numbers, own_keys, own_times = own
                rows.append([block, digest, *numbers, packed(own_keys, own_times)])
                if len(own_keys):
                    keys.append(own_keys)
                    weights.append(np.full(len(own_keys), times))
                size += len(text)
                if size > BLOCK:
                    if keys:
                        rows.append(summed())
                    block, keys, weights, size = block + 1, [], [], 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )
        if keys:
            rows = [summed()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
            )

    return lambda batches: _uncollected(align(batches))


def _uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without garbage collection: there are millions of small values and no cycles among them."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of each block."""
    for batch in batches:
        for block, body in zip(batch.column("block").to_pylist(), batch.column("links").to_pylist(), strict=True):
            steps, weights = common.unpack(body, "i8", "i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(steps), block)), pa.array(np.cumsum(steps)), pa.array(weights)],
                ["block", "pair", "documents"],
            )


def _looked_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's texts, from the counts of its pairs."""
    pair = counts.column("pair").to_numpy()
    order = np.argsort(pair)
    pair = pair[order]
    count = counts.column("documents").to_numpy()[order]
    best = counts.column("best").to_numpy(zero_copy_only=False)[order]
    n_best, count_sum = [], []
    for body in texts.column("links").to_pylist():
        steps, times = common.unpack(body, "i8", "i8")
        at = np.searchsorted(pair, np.cumsum(steps))
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    kept = texts.drop_columns(["block", "links"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64())
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, documents, best): documents that hold a pair, and whether no pair of its A id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("documents").alias("documents"))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))
    return counts.join(most, a == F.col("a")).select(
        "pair", "documents", (F.col("documents") == F.col("most")).alias("best")
    )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    In: doc_id long, text string; other columns are ignored.  A is a byte-level tokenizer of the
    tokenizers library, which gets a space before each text; B a SentencePiece model, which puts it
    there itself.  Strings of special tokens are plain text.  A null or empty text, and one
    whose A or B bytes aren't those of the text, has no tokens: zeros, and an empty digest.
    Rows that repeat a document count and come back once each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = (
        docs.filter(F.col("text") != "")
        .groupBy("text")
        .agg(F.count(F.lit(1)).alias("times"))
        .select(digest.alias("digest"), "times", "text")
    )
    aligned = common.stored(texts.mapInArrow(_align(path_a, path_b), _ALIGNED), "aligned")
    # A row for each block and pair; stored, for the counts and their look-up.
    pairs = common.stored(
        aligned.filter("digest is null").select("block", "links").mapInArrow(
            _pairs, "block long, pair long, documents long"
        ),
        "pairs",
    )
    counts = pairs.select("block", "pair").join(pair_counts(pairs), "pair")
    own = aligned.filter("digest is not null").groupBy("block")
    columns = ", ".join(
        ["digest binary", *(f"{c} long" for c in _MEASURES[:4]), "groups_sha256 string", "n_best long, count_sum long"]
    )
    measured = own.cogroup(counts.groupBy("block")).applyInArrow(lambda t, c: _looked_up(t, c), columns)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    found = rows.join(measured, "digest", "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _MEASURES]
    return found.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
