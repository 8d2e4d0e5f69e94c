"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is the heaviest path from its start to its end through
the lattice of vocabulary pieces.  In the (max, +) algebra a stretch of text is a matrix:
entry (i, j) is the weight of the heaviest path that enters the stretch i characters
after its start and leaves it j characters after its end, pieces reaching over the end
included.  Matrices multiply associatively, so a long text is cut into chunks whose
matrices are made apart and combined in a tree; going back down, each node's entry and exit fix
those of its children, and at last every chunk is traced back for itself.

Weights are whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoloom.llm import common

#: Characters per chunk; texts of up to one chunk are encoded where they lie.
CHUNK = 1 << 16
#: Matrices combined by one task in one step of the tree.
FAN = 64
#: Text parts remembered per worker, some 30 MB of them, and the longest that is.
MEMO_PIECES = 80_000
MEMO_LENGTH = 48
#: Characters encoded together.
STEP = 1 << 20
_UNIT = 1 << 20
_NEVER = -(1 << 60)
_MARK = "▁"

_MODELS: dict[str, Pieces] = {}


_DECODERS: dict[str, Decoder] = {}


class Decoder:
    """The bytes of each id of a SentencePiece model file."""

    def __init__(self, proto) -> None:
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        self.text = [p.piece.replace(_MARK, " ").encode() for p in proto.pieces]
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.text[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 3:
                self.text[i] = b""
            elif p.type == 2:
                self.text[i] = " ⁇ ".encode()

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in _DECODERS:
            _DECODERS[path] = cls(_proto(path))
        return _DECODERS[path]

    def decode(self, ids: bytes) -> str:
        """Text of the ids of a whole text; bytes that are no UTF-8 become U+FFFD."""
        found = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        found = found.removeprefix(self.prefix.encode())
        return found.decode(errors="replace")


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


class Pieces:
    """Vocabulary of a SentencePiece model file, with a weight for each piece.

    Unigram models have weights: log-probabilities.  Merge models only have ranks; their
    pieces get the log-probabilities that Zipf's law gives to ranks, so the segmentation is the likeliest
    under them, not the one that merging in order would give.  Normalization is the
    identity but for the space before a text, if the model asks for one, and for spaces, which are
    written as U+2581; a character in no piece becomes its UTF-8 bytes' pieces, or the
    unknown piece where the model has none.
    """

    def __init__(self, path: str) -> None:
        proto = _proto(path)
        self.decode = Decoder(proto).decode
        normal = [(i, p) for i, p in enumerate(proto.pieces) if p.type in (1, 4)]
        unigram = proto.trainer_spec.model_type == 1
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        scores = [p.score for _, p in normal] if unigram else zipf_scores(len(normal))
        self.weight: dict[str, tuple[int, int]] = {
            p.piece: (round(s * _UNIT), i) for (i, p), s in zip(normal, scores, strict=True)
        }
        #: Every end of a piece, for walks back.
        self.ends: dict[str, tuple[int | None, int]] = {
            p[k:]: (None, -1) for p in self.weight for k in range(1, len(p))
        }
        self.ends.update(self.weight)
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.bytes_ = [bytes_[v] for v in range(256)] if len(bytes_) == 256 else None
        self.unknown = unknown
        self.unknown_weight = min(w for w, _ in self.weight.values() if w > -(10**6) * _UNIT) - 10 * _UNIT
        self.reach = max(map(len, self.weight))
        inside = any(_MARK in p.lstrip(_MARK) for p in self.weight)
        feed = any("\n" in p for p in self.weight)
        # Every path has a node before a run of spaces, and around a line feed that no piece holds.
        pattern = " *[^ ]+| +" if feed else "\n| *[^ \n]+| +"
        self.cut = (lambda x: [x]) if inside else re.compile(pattern).findall
        self.packed = [array("I", [i]).tobytes() for i in range(len(proto.pieces))]
        self.ids = _Memo(self, 2)
        self.weights = _Memo(self, 1)

    @cached_property
    def table(self) -> dict[str, tuple[int | None, int]]:
        """Every beginning of a piece, so that a walk through a text knows when to stop."""
        found: dict[str, tuple[int | None, int]] = {
            p[:k]: (None, -1) for p in self.weight for k in range(1, len(p))
        }
        found.update(self.weight)
        return found

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def edges(self, text: str, at: int) -> Iterator[tuple[int, int, int]]:
        """(end, weight, id) of the pieces that start at a place; id -1 for an unknown character."""
        single = False
        for end in range(at + 1, min(at + self.reach, len(text)) + 1):
            found = self.table.get(text[at:end])
            if found is None:
                break
            if found[0] is not None:
                single = single or end == at + 1
                yield end, *found
        if not single:
            yield at + 1, self.unknown_weight, -1

    def solve(self, texts: list[str]) -> Iterator[tuple[str, int, list[int]]]:
        """(text, weight, ids) of the heaviest path through each text, spaces as U+2581; of equally
        heavy ways to a place, the one whose last piece is longest.

        In alphabetic order, so that a text goes on from where it parts with the one before.
        """
        reach, unknown, table = self.reach, self.unknown_weight, self.ends.get
        best, origin, last = [0], [0], [-1]
        before = ""
        for text in sorted(texts):
            n = len(text)
            shared = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], origin[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                at = end - 1
                found = table(text[at])
                most, where, piece = _NEVER, at, -1
                if found is None or found[0] is None:
                    most = best[at] + unknown
                while found is not None:
                    if found[0] is not None and best[at] + found[0] >= most:
                        most, where, piece = best[at] + found[0], at, found[1]
                    at -= 1
                    if at < 0 or end - at > reach:
                        break
                    found = table(text[at:end])
                best.append(most)
                origin.append(where)
                last.append(piece)
            before = text
            ids: list[int] = []
            end = n
            while end:
                at, piece = origin[end], last[end]
                if piece >= 0:
                    ids.append(piece)
                elif self.bytes_:
                    ids += [self.bytes_[v] for v in reversed(text[at:end].encode())]
                else:
                    ids.append(self.unknown)
                end = at
            yield text, best[n], ids[::-1]

    def _solve_short(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """`solve`, with packed ids; for short texts, as every place keeps the ids up to it."""
        reach, unknown, table, packed = self.reach, self.unknown_weight, self.ends.get, self.packed
        best, ids = [0], [b""]
        before = ""
        for text in sorted(texts):
            n = len(text)
            most = min(n, len(before))
            shared = 0
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, n + 1):
                at = end - 1
                found = table(text[at])
                most, where, piece = _NEVER, at, -1
                if found is None or found[0] is None:
                    most = best[at] + unknown
                least = end - reach
                while found is not None:
                    weight = found[0]
                    if weight is not None and best[at] + weight >= most:
                        most, where, piece = best[at] + weight, at, found[1]
                    at -= 1
                    if at < 0 or at < least:
                        break
                    found = table(text[at:end])
                best.append(most)
                own = packed[piece] if piece >= 0 else self._spelled(text[where:end])
                ids.append(ids[where] + own)
            before = text
            yield text, best[n], ids[n]

    def _spelled(self, character: str) -> bytes:
        """Packed ids of a character that is no piece."""
        values = [self.bytes_[v] for v in character.encode()] if self.bytes_ else [self.unknown]
        return array("I", values).tobytes()

    def prepared(self, text: str) -> str:
        """A whole text as it is encoded: with the space that some models put before it."""
        return self.prefix + text if text else ""

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of prepared texts as little-endian unsigned 32-bit integers."""
        parts = [self.cut(x.replace(_MARK, " ")) for x in texts]
        known = self.ids.of(set(chain.from_iterable(parts)))
        return [b"".join(map(known.__getitem__, own)) for own in parts]

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Transfer matrix of the first `size` characters; `text` goes on for reach - 1 more at most.

        Entry (i, j): enter at character i, leave at character size + j.  Where all paths share
        a node behind the last entry, the stretch up to the last shared node is one weight.
        """
        text = text.replace(_MARK, " ")
        shared, at = [], 0
        parts = self.cut(text[:size])
        for part in parts:
            shared.append(at)
            at += len(part)
        first = next((k for k, x in enumerate(shared) if k and x >= self.reach - 1), None)
        if first is None:
            return self._matrix(text, size)
        # The last part may go on behind the chunk.
        begin, end = shared[first], shared[-1]
        known = self.weights.of(set(parts[first:-1]))
        middle = sum(map(known.__getitem__, parts[first:-1]))
        enter = self._matrix(text[:begin], begin)[:, 0]
        leave = self._matrix(text[end:], size - end)[0]
        return np.maximum(enter[:, None] + middle + leave[None, :], _NEVER)

    def _matrix(self, text: str, size: int) -> np.ndarray:
        marked = text.replace(" ", _MARK)
        best = np.full((self.reach, size + self.reach), _NEVER, np.int64)
        for i in range(min(self.reach, len(marked) + 1)):
            best[i, i] = 0
        for at in range(size):
            for end, weight, _ in self.edges(marked, at):
                np.maximum(best[:, end], best[:, at] + weight, out=best[:, end])
        return np.maximum(best[:, size:], _NEVER)


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


class _Memo:
    """One value of `solve` for text parts, kept for short ones; it starts anew once it is full."""

    def __init__(self, model: Pieces, value: int) -> None:
        self.model, self.value = model, value
        self.found: dict = {}

    def of(self, parts: set[str]) -> dict:
        """Holds all of the parts, at least."""
        if len(self.found) > MEMO_PIECES:
            self.found = {}
        new = [p.replace(" ", _MARK) for p in parts if p not in self.found]
        for row in self.model._solve_short([p for p in new if len(p) <= MEMO_LENGTH]):
            self.found[row[0].replace(_MARK, " ")] = row[self.value]
        long = {}
        for text, weight, ids in self.model.solve([p for p in new if len(p) > MEMO_LENGTH]):
            long[text.replace(_MARK, " ")] = (weight, array("I", ids).tobytes())[self.value - 1]
        return self.found | long if long else self.found


def zipf_scores(n: int) -> list[float]:
    """log(1 / ((rank + 2.7) * log(n))) for ranks from 0."""
    return [-math.log(rank + 2.7) - math.log(math.log(max(n, 3))) for rank in range(n)]


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix product in the (max, +) algebra."""
    return np.maximum((left[:, :, None] + right[None, :, :]).max(1), _NEVER)


def between(matrices: list[np.ndarray], entry: int, leave: int) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the heaviest way through all of them."""
    best = np.full(len(matrices[0]), _NEVER, np.int64)
    best[entry] = 0
    back = []
    for m in matrices:
        total = best[:, None] + m
        back.append(total.argmax(0))
        best = np.maximum(total.max(0), _NEVER)
    states = [leave]
    for origin in reversed(back):
        states.append(int(origin[states[-1]]))
    states.reverse()
    return list(zip(states[:-1], states[1:], strict=True))


_KEY = ["doc_id", "row_key"]


def _int64s(m: np.ndarray) -> bytes:
    return m.astype("<i8").tobytes()


def _chunks(texts: DataFrame, reach: int) -> DataFrame:
    """Long texts in chunks: at (number), size, and text with what may be looked at behind it."""
    n = F.length("text")
    last = ((n - 1) / CHUNK).cast("int")
    return (
        texts.filter(n > CHUNK)
        .select(*_KEY, "text", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select(
            *_KEY,
            "at",
            F.least(F.lit(CHUNK), n - F.col("at") * CHUNK).alias("size"),
            F.expr(f"substring(text, at * {CHUNK} + 1, {CHUNK + reach - 1})").alias("text"),
        )
    )


def _states(chunks: DataFrame, model: str, reach: int, most: int) -> DataFrame:
    """(key, at, entry, leave) of every chunk: up the tree with products, down with ways."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            body = [
                _int64s(pieces.matrix(t.as_py(), s.as_py()))
                for t, s in zip(batch.column("text"), batch.column("size"), strict=True)
            ]
            yield batch.select([*_KEY, "at"]).append_column("matrix", pa.array(body, pa.binary()))

    def read(body) -> np.ndarray:
        return np.frombuffer(body.as_py(), "<i8").reshape(reach, reach)

    def up(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        total = read(table.column("matrix")[0])
        for body in table.column("matrix")[1:]:
            total = product(total, read(body))
        one = table.slice(0, 1)
        return pa.table(
            {
                "doc_id": one.column("doc_id"),
                "row_key": one.column("row_key"),
                "at": pa.array([one.column("at")[0].as_py() // FAN], pa.int32()),
                "matrix": pa.array([_int64s(total)], pa.binary()),
            }
        )

    def down(own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        entry, leave = (above.column(c)[0].as_py() for c in ("entry", "leave"))
        ways = between([read(x) for x in own.column("matrix")], entry, leave)
        return own.select([*_KEY, "at"]).append_column(
            "entry", pa.array([x[0] for x in ways], pa.int32())
        ).append_column("leave", pa.array([x[1] for x in ways], pa.int32()))

    kind = "doc_id long, row_key long, at int"
    group = (F.col("at") / FAN).cast("int").alias("group")
    levels = [common.stored(chunks.mapInArrow(leaves, f"{kind}, matrix binary"), "matrices")]
    while most > FAN:
        levels.append(
            common.stored(
                levels[-1].groupBy(*_KEY, group).applyInArrow(lambda t: up(t), f"{kind}, matrix binary"),
                "matrices",
            )
        )
        most = -(-most // FAN)
    # Above the last level: a whole text is entered at its start and left at its end.
    above = levels[-1].select(
        *_KEY, F.lit(0).alias("at"), F.lit(0).alias("entry"), F.lit(0).alias("leave")
    ).distinct()
    for level in reversed(levels):
        parents = above.select(*_KEY, F.col("at").alias("group"), "entry", "leave")
        children = level.select(*_KEY, group, "at", "matrix").groupBy(*_KEY, "group")
        above = common.stored(
            children.cogroup(parents.groupBy(*_KEY, "group")).applyInArrow(
                down, f"{kind}, entry int, leave int"
            ),
            "ways",
        )
    return above


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Token ids of each text: doc_id, row_key, ids (packed little-endian 32-bit integers).

    In: doc_id long, text string; other columns are ignored; `model` is the path of a
    SentencePiece model file on every executor.  A null text is empty and has no ids; an empty table gives an
    empty one; rows that repeat a document come back once each.  Of segmentations with
    equal weight one is taken; which one may depend on where chunks end.
    """
    return _encoded(docs, model, _IDS, lambda batch, ids: batch.append_column("ids", pa.array(ids, pa.binary())))


def summary(docs: DataFrame, model: str) -> DataFrame:
    """Per row, encoded as by `encode` and decoded again in the same tasks: doc_id, n_tokens, ids_crc32,
    n_chars and text_crc32 of the decoded text."""

    def looked(batch: pa.RecordBatch, ids: list[bytes]) -> pa.RecordBatch:
        decode = Decoder.of(model).decode
        rows = []
        for x in ids:
            text = decode(x)
            rows.append((len(x) // 4, zlib.crc32(x), len(text), zlib.crc32(text.encode())))
        for name, values in zip(_LOOKED, zip(*rows, strict=True) if rows else [()] * 4, strict=True):
            batch = batch.append_column(name, pa.array(values, pa.int64()))
        return batch

    kind = ", ".join(f"{c} long" for c in _LOOKED)
    return _encoded(docs, model, kind, looked).select("doc_id", *_LOOKED)


_IDS = "ids binary"
_LOOKED = ("n_tokens", "ids_crc32", "n_chars", "text_crc32")


def _encoded(docs: DataFrame, model: str, kind: str, made: Callable) -> DataFrame:
    """doc_id, row_key and the columns, of the given kind, that `made` adds for the ids of whole texts."""
    reach, prefix = Pieces.of(model).reach, Pieces.of(model).prefix
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"),
        common.row_key(F.col("text")).alias("row_key"),
        F.when(text != "", F.concat(F.lit(prefix), text)).otherwise("").alias("text"),
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            ids = [x for own in _steps(batch.column("text").to_pylist()) for x in pieces.encode(own)]
            yield made(batch.select(_KEY), ids)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            rows = batch.select(["text", "size", "entry", "leave"]).to_pylist()
            texts = [r["text"][r["entry"] : r["size"] + r["leave"]] for r in rows]
            ids = [x for own in _steps(texts) for x in pieces.encode(own)]
            yield batch.select([*_KEY, "at"]).append_column("ids", pa.array(ids, pa.binary()))

    short = texts.filter(F.length("text") <= CHUNK).mapInArrow(
        whole, f"doc_id long, row_key long, {kind}"
    )
    most = texts.agg(F.max(F.length("text"))).first()[0] or 0
    if most <= CHUNK:
        return _named(short)
    large = texts.filter(F.length("text") > CHUNK)
    single = large.groupBy(*_KEY).agg(F.first("text").alias("text"))
    chunks = _chunks(single, reach).repartition(common.tasks(docs.sparkSession), *_KEY, "at")
    chunks = common.stored(chunks, "chunks")
    ways = _states(chunks, model, reach, -(-most // CHUNK))
    joined = chunks.join(ways, [*_KEY, "at"]).select(*_KEY, "at", "text", "size", "entry", "leave")
    parts = joined.mapInArrow(traced, "doc_id long, row_key long, at int, ids binary")

    def whole_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(x["ids"] for x in own) for own in batch.column("p").to_pylist()]
            yield made(batch.select(_KEY), ids)

    # One text's ids, as its text, are one value.
    long = (
        parts.groupBy(*_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
        .mapInArrow(whole_again, f"doc_id long, row_key long, {kind}")
    )
    return _named(short.union(large.select(*_KEY).join(long, _KEY)))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def decode(ids: Column, model: str) -> Column:
    """The texts of packed ids, as a column."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(values):
        pieces = Decoder.of(model)
        return values.map(lambda x: None if x is None else pieces.decode(x))

    return text(ids)
