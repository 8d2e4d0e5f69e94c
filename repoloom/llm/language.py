"""Language identification by compression with per-language dictionaries.

For each language some labelled text becomes a raw-content zstandard dictionary.  A text
belongs to the language whose dictionary makes it smallest; where the runner-up comes
close, the text is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample: labelled documents and bytes of them, per language, and languages.
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 112 * 1024
MOST_LANGUAGES = 1000
#: Texts are compressed in pieces, so that a long one's own repeats don't hide the dictionary.
PIECE_BYTES = 1024
LEVEL = 6
#: Least lead of the smallest size over the next, as a share of it.
MARGIN = 0.005
#: And in bytes, for a byte is a coarse measure of short texts.
LEAST_LEAD = 2

_WORDS = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> str:
    """What is compressed: the lower-cased runs of letters, with single blanks between."""
    return " ".join(_WORDS(text.lower()))


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, the commonest language first."""

    dictionaries: tuple[tuple[str, bytes], ...]


def fit(docs: DataFrame, learn: Column) -> Languages:
    """Dictionaries from the rows that `learn` picks, of at most SAMPLE_DOCS per language.

    Only the words of text, and lang, are learned from.  The documents of a language come in the order of
    a hash of their doc_id, and each gives an equal piece from a place that the hash names.
    Rows without text or language are passed over; more than MOST_LANGUAGES languages
    are an error.
    """
    known = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Languages(())
    order = F.xxhash64(F.lit("language"), F.col("doc_id"))
    # Thin out before ranking; four times the sample leaves enough.
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(4.0 * SAMPLE_DOCS / r["count"]))])
    thin = known.filter(F.pmod(order, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    ranked = thin.select(
        "lang",
        "text",
        order.alias("_order"),
        F.row_number().over(Window.partitionBy("lang").orderBy(order, "text")).alias("_rank"),
    ).filter(F.col("_rank") <= SAMPLE_DOCS)
    width = max(DICTIONARY_BYTES // 100, 1)
    # Characters around the place; cut to bytes below.
    place = F.pmod("_order", F.greatest(F.length("text") - width, F.lit(0)) + 1)
    sample = ranked.select(
        "lang", "_rank", F.substring("text", (place + 1).cast("int"), F.lit(width)).alias("text")
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r.lang, r._rank)):
        texts.setdefault(r.lang, []).append(words(r.text))
    order_of = sorted(sizes, key=lambda r: (-r["count"], r.lang))
    found = []
    for lang in (r.lang for r in order_of if r.lang in texts):
        own = texts[lang]
        each = max(DICTIONARY_BYTES // len(own), 64)
        found.append((lang, b" ".join(x.encode()[:each] for x in own)[:DICTIONARY_BYTES]))
    return Languages(tuple(found))


class _Sizes:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, model: Languages) -> None:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0,
            write_dict_id=0,
            write_checksum=0,
        )
        self.compressors = []
        for _, content in model.dictionaries:
            content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=parameters)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)
            )

    def of(self, text: str) -> list[int]:
        raw = text.encode()
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(c.compress(x)) for x in pieces) for c in self.compressors]


_SCHEMA = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identify(docs: DataFrame, model: Languages, margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score and accepted to each row.

    lang_pred is the language of the smallest size, the commoner one on equal sizes, `und`
    for a null text, one without letters, or a model without languages.  score is
    1 - exp(-d / 2), d the lead over the next language in bytes: 0 on equal sizes, near 1 from
    ten bytes on; 1 where there is one language only.  accepted is false for `und` and where the lead is
    less than LEAST_LEAD bytes or at most `margin` of the next language's size, at every length.
    Columns named like the three are replaced.
    """
    names = [c for c in docs.columns if c not in _SCHEMA.names]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model)
        langs = [x[0] for x in model.dictionaries]
        for batch in batches:
            found, scores, accepted = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                text = words(text or "")
                if not langs or not text:
                    found.append("und"), scores.append(0.0), accepted.append(False)
                    continue
                own = sizes.of(text)
                best = int(np.argmin(own))
                lead = min((x for i, x in enumerate(own) if i != best), default=None)
                found.append(langs[best])
                if lead is None:
                    scores.append(1.0), accepted.append(True)
                    continue
                ahead = lead - own[best]
                scores.append(1 - float(np.exp(-ahead / 2)))
                accepted.append(ahead >= LEAST_LEAD and ahead > margin * lead)
            new = [pa.array(found, pa.string()), pa.array(scores), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *new], [*names, *_SCHEMA.names]
            )

    rows = docs.select(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """The rows that are not learned from: crc32 of the id as text, modulo 4, is 2."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == 2
