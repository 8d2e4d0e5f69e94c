"""Shards that all carry the corpus's mixture of sources, by proportional interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoloom.operators import ranking


def interleaved_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Deals rows into `shards` of equal counts, each with every source's share.

    In: doc_id, text, source; other columns are ignored.  Out, a row per row: doc_id,
    source, size (UTF-8 bytes of the text plus 1), text_crc32, shard (from 0), slot
    (position in the shard, gapless from 0).

    Within each source the rows are put in a seeded random order; the k-th of n rows gets
    the fraction (k - 1/2) / n; all rows are sorted by fraction and cut into runs whose
    lengths differ by at most one.  A run of m rows thus holds, of a source with n of N
    rows, m * n / N of them, give or take the rounding at its two ends.

    The order is that of a hash of (seed, doc_id), then doc_id, then the text's
    checksum and size; rows equal in all are interchangeable.  A null source is a source; a null text
    has size 1 and checksum 0; a null doc_id hashes like any value.  No source is
    handled in one task: both orders are ranked by ranges.
    """
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_random"),
    )
    ties = [F.col(c) for c in ("_random", "doc_id", "text_crc32", "size")]
    totals = rows.groupBy("source").agg(F.count("*").alias("_of"))
    ranked = ranking.ranked(rows, ["source"], ties, "_rank")
    ranked = ranked.join(totals, ranked["source"].eqNullSafe(totals["source"])).select(
        *[ranked[c] for c in ranked.columns],
        ((ranked["_rank"] - 0.5) / totals["_of"]).alias("_fraction"),
    )
    order = [F.col("_fraction"), F.col("source"), *ties, F.col("_rank")]
    placed = ranking.ranked(ranked, [], order, "_at")
    n = placed.count()
    # Whole numbers: position p of n goes to shard floor(p * shards / n).
    shard = f"((_at - 1) * {shards}) div {max(n, 1)}"
    first = f"(({shard}) * {n} + {shards - 1}) div {shards}"
    return placed.select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.expr(f"int({shard})").alias("shard"),
        F.expr(f"_at - 1 - ({first})").alias("slot"),
    )
