"""Token ids of a corpus as flat binary files with 64-bit document offsets.

Each range of doc_ids becomes one part of three files in a shared folder:

* `<part>.ids`    token ids, little-endian unsigned integers of 16 bits where the
  vocabulary allows it, else 32, every document ending with the end id;
* `<part>.off`    n + 1 little-endian unsigned 64-bit offsets, in ids from the part's start;
* `<part>.doc`    n little-endian signed 64-bit doc_ids, ascending.

A manifest table names the files of the task attempts that succeeded, so a part that is
written twice counts once.  The position of a part in the whole corpus is the prefix
sum of the counts of the parts before it.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoloom.llm import common

#: Pieces remembered per worker, twice this many at most, and the longest that is.
MEMO_PIECES = 500_000
MEMO_LENGTH = 40
#: Characters encoded together.
STEP = 1 << 20

# A byte-level tokenizer first cuts a text into words, each with the space before it, numbers,
# and runs of other characters.  So it may be cut before any run of blanks that stands behind something
# else, and where plain letters, digits and other characters meet; but an apostrophe stays
# with the letters behind it.  Only spaces and line feeds count as blanks here, and a text
# with other blanks is encoded in one go, for they may join runs of blanks.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
_FINE = re.compile(rf"[ \n]*(?:'?[{_LETTERS}]+|[0-9]+|[^ \n0-9{_LETTERS}]+)|[ \n]+").findall
_COARSE = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
_NOT_PLAIN = re.compile(rf"[^ -~\n{_LETTERS}]").search
_OTHER_BLANKS = re.compile(r"[^\S \n]").search
# Pieces that are a single word for the tokenizer.
_ONE_WORD = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)").fullmatch

_TOKENIZERS: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids of texts as bytes; pieces of texts are encoded once while remembered."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        described = json.loads(self.tokenizer.to_str())
        before = described["pre_tokenizer"] or {}
        #: Whether texts may be cut, and words be given to the model as they are.
        self.byte_level = (
            described["model"]["type"] == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and described["normalizer"] is None
            and described["post_processor"] is None
        )
        added = [re.escape(x["content"]) for x in described["added_tokens"]]
        self.added = re.compile("|".join(added) or r"(?!)").search
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = cls(path)
        return _TOKENIZERS[path]

    def _packed(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._packed(x.ids) for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, straight from the model."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters.__getitem__
        shown = [
            w.replace(" ", letters(32)) if w.isascii() else "".join(map(letters, w.encode()))
            for w in words
        ]
        return [self._packed([t.id for t in tokenize(w)]) for w in shown]

    def _pieces(self, text: str) -> list[str]:
        if self.added(text) or _OTHER_BLANKS(text):
            return [text]
        return _COARSE(text) if _NOT_PLAIN(text) else _FINE(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.byte_level:
            return self._encode(texts)
        pieces = [self._pieces(x) for x in texts]
        distinct: set[str] = set()
        for own in pieces:
            distinct.update(own)
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        words, others = [], []
        for x in distinct:
            if x in memo:
                continue
            if x in older:
                memo[x] = older[x]
            elif _ONE_WORD(x) and not self.added(x):
                words.append(x)
            else:
                others.append(x)
        made = dict(zip(words, self._words(words), strict=True))
        made.update(zip(others, self._encode(others), strict=True))
        long = {x: ids for x, ids in made.items() if len(x) > MEMO_LENGTH}
        memo.update(made)
        found = [b"".join(map(memo.__getitem__, own)) for own in pieces]
        for x in long:  # in use for these texts only
            del memo[x]
        return found


def _steps(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text)
        if size >= STEP:
            yield own
            own, size = [], 0
    if own:
        yield own


_MANIFEST = "part long, file string, n_docs long, n_tokens long, width int"


def _write(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        name = f"part-{part:07d}-{context.stageId()}-{context.taskAttemptId()}"
        encoder = Encoder.of(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        system, root = common.file_system(folder)
        lengths, ids, stream = [], [], None
        for batch in batches:
            if stream is None:
                stream = system.open_output_stream(f"{root}/{name}.ids")
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for step in _steps(texts):
                for body in encoder.encode(step):
                    stream.write(body + end)
                    lengths.append(len(body) // encoder.kind.itemsize + 1)
            ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False))
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        for suffix, values in (("off", offsets), ("doc", np.concatenate(ids).astype("<i8"))):
            with system.open_output_stream(f"{root}/{name}.{suffix}") as out:
                out.write(values.tobytes())
        row = {"part": part, "file": name, "n_docs": len(lengths)}
        row |= {"n_tokens": int(offsets[-1]), "width": encoder.kind.itemsize}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema(_manifest_fields()))

    return write


def _manifest_fields():
    whole = [("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]
    return [("part", pa.int64()), ("file", pa.string()), *whole]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the token files in ascending doc_id order; returns the manifest with bases.

    In: doc_id long, text string; other columns are ignored.  `folder` is a URI or path
    that all executors reach.  Out, a row per part: part, file, n_docs, n_tokens, width
    (bytes per id), base (ids in the parts before), also stored as `manifest` in the folder.

    A null text is empty and has the end id alone; equal doc_ids stand next to each
    other, by text; a null doc_id is written as the smallest long, first.  An empty
    table gives no part.
    """
    system, root = common.file_system(folder)
    system.create_dir(root, recursive=True)
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text"
    )
    (
        rows.repartitionByRange(common.tasks(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write(folder, tokenizer, end_id), _MANIFEST)
        .write.parquet(f"{folder}/manifest")
    )
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts with their bases; a row per part, so one task may sum them."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spark.read.schema(_MANIFEST)
        .parquet(f"{folder}/manifest")
        .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    )


def _mapped(system, path: str, kind: str) -> np.ndarray:
    """The values of a file, memory-mapped where it is a local one."""
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if system.get_file_info(path).size else np.zeros(0, kind)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


_READ = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32.

    start counts the ids of all documents before; ids_crc32 is the unsigned CRC of the
    ids as little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = common.file_system(folder)
        for batch in batches:
            for part in batch.to_pylist():
                path = f"{root}/{part['file']}"
                ids = _mapped(system, f"{path}.ids", f"<u{part['width']}")
                offsets = _mapped(system, f"{path}.off", "<u8").astype(np.int64)
                doc_ids = np.array(_mapped(system, f"{path}.doc", "<i8"))
                for lo in range(0, len(doc_ids), 4096):
                    hi = min(lo + 4096, len(doc_ids))
                    crc = [
                        zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes())
                        for i in range(lo, hi)
                    ]
                    columns = [
                        pa.array(doc_ids[lo:hi]),
                        pa.array(offsets[lo:hi] + part["base"]),
                        pa.array(np.diff(offsets[lo : hi + 1])),
                        pa.array(crc, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=_READ)

    spread = manifest.repartition(common.tasks(manifest.sparkSession), "part")
    found = spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))
