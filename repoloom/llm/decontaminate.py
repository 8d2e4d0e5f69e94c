"""Benchmark passages in training texts, through a positional inverted index.

Windows of test words are looked up as phrases:

1.  The training occurrences of every test word are counted.
2.  Each window names its two rarest words.  Their postings (word, document, position) are
    stored, and no others.
3.  A posting of the rarest word, less its offset in the window, is a possible start; it
    stays if the second word's list has the same document and start (or, for proximity, one
    within the slop).
4.  What is left is compared word by word with the texts.

All of it is DataFrame code.  Test-side tables are broadcast where they are counted to be
small; else Spark shuffles both sides and splits frequent words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoloom.functions.evaluation import evaluated_once
from repoloom.llm import common

WINDOW = 10
#: Rows of a test-side table that every executor may hold; a row has at most a window's words.
BROADCAST_ROWS = 100_000

# What stands between lower-cased words, and between words as they are.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["doc_id", "row_key"]


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; null for a null text."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _UPPER.lower()), _BETWEEN), "")


def word_count(text: Column) -> Column:
    """How many words a text has; case doesn't matter for that."""
    count = F.size(F.array_remove(F.split(text, _BETWEEN_RAW), ""))
    return F.when(text.isNull(), 0).otherwise(count).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """The stored table, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _windows(items: DataFrame) -> DataFrame:
    """Distinct word sequences: window (their name), words."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
        .filter(n > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at"), F.lit(WINDOW)).alias("words"))
        .withColumn("window", F.sha2(F.concat_ws(" ", "words"), 256))
    )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), common.row_key(F.col("text")).alias("row_key"), "text")


def matches(docs: DataFrame, items: DataFrame, slop: int = 0, share: float = 0.8) -> DataFrame:
    """Where windows of the items occur: doc_id, row_key, window, start, length, kind.

    kind is `phrase` for the exact words in order from word `start` on.  With slop > 0,
    `proximity` rows follow: the two rarest words of a window stand within `slop` words of
    their places, and at least `share` of its distinct words lie in the stretch that
    starts `slop` before and ends `slop` after.
    """
    texts = _rows(docs)
    windows = common.stored(_windows(items).select("window", "words").distinct(), "windows")
    vocabulary = common.stored(windows.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    counts = common.stored(
        texts.select(F.explode(words(F.col("text"))).alias("word"))
        .join(_small(vocabulary), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n")),
        "counts",
    )
    # The two rarest places of each window; a window with an unseen word can't be a phrase.
    placed = windows.select("window", "words", F.posexplode("words").alias("offset", "word")).join(
        counts, "word", "left"
    )
    ranked = placed.groupBy("window").agg(
        F.first("words").alias("words"),
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))).alias("p"),
    )
    if slop == 0:
        ranked = ranked.filter(F.col("p")[0]["n"] > 0)
    else:
        seen = F.filter("p", lambda x: x["n"] > 0)
        ranked = ranked.withColumn("p", seen).filter(F.size("p") > 0)
    plan = common.stored(
        ranked.select(
            "window",
            "words",
            F.size("words").alias("length"),
            F.col("p")[0]["word"].alias("first"),
            F.col("p")[0]["offset"].alias("first_offset"),
            F.get("p", F.lit(1))["word"].alias("second"),
            F.get("p", F.lit(1))["offset"].alias("second_offset"),
        ),
        "plan",
    )
    chosen = plan.select(F.col("first").alias("word")).union(plan.select("second")).distinct()
    chosen = common.stored(chosen.filter("word is not null"), "chosen")
    postings = common.stored(
        texts.select(*_KEY, F.posexplode(words(F.col("text"))).alias("position", "word")).join(
            _small(chosen), "word"
        ),
        "postings",
    )
    slim = plan.drop("words")
    started = postings.join(_small(slim), F.col("word") == F.col("first")).select(
        *_KEY, "window", "length", "second", "second_offset", (F.col("position") - F.col("first_offset")).alias("start")
    )
    single = started.filter("second is null").select(*_KEY, "window", "length", "start")
    other = postings.select(
        F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), F.col("word").alias("_word"), "position"
    )
    expected = F.col("start") + F.col("second_offset")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key"))
    same = same & (F.col("second") == F.col("_word"))
    near = F.col("position") == expected
    if slop:
        near = F.abs(F.col("position") - expected) <= slop
    double = started.filter("second is not null").join(other, same & near, "left_semi")
    found = common.stored(
        single.unionByName(double.select(*single.columns)).distinct(), "candidates"
    )
    found = found.join(_small(plan.select("window", "words")), "window")
    own = texts.select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_key"), "text")
    # Candidates of one text together, so that its words are made once.
    together = found.groupBy(*_KEY).agg(
        F.collect_set(F.struct("window", "words", "start", "length")).alias("found")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row_key") == F.col("_key"))
    checked = own.join(together, same).select(*_KEY, words(F.col("text")).alias("w"), "found")
    checked = evaluated_once(checked, "w").select(*_KEY, "w", F.explode("found").alias("f"))
    checked = checked.select(*_KEY, "w", "f.*")
    exact = (F.col("start") >= 0) & (
        F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("length")) == F.col("words")
    )
    kind = F.when(exact, F.lit("phrase"))
    if slop:
        lo = F.greatest(F.col("start") - slop, F.lit(0))
        stretch = F.slice("w", lo + 1, F.col("start") + F.col("length") + slop - lo)
        common_ = F.size(F.array_intersect(stretch, "words"))
        kind = kind.when(common_ >= share * F.size(F.array_distinct("words")), F.lit("proximity"))
    return (
        checked.select(*_KEY, "window", F.col("start").cast("long"), F.col("length").cast("long"), kind.alias("kind"))
        .filter("kind is not null")
        .distinct()
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: how many of its words lie in a window of the items.

    In: docs (doc_id, text) and items (item_id, text); other columns are ignored.  A window
    is 10 consecutive words of an item, or all of a shorter one.  Out, a row per row: doc_id,
    n_words, n_hit (words inside an occurrence), n_items (items with an occurring window),
    items_sha256 (of their ids, sorted as strings, comma-joined), contaminated, item_ids, and
    row_key, which tells rows of one doc_id apart by their texts.

    Null and wordless texts have no words and are clean; a null item_id is named by the
    empty string; equal windows of several items count for each; rows that repeat a
    document get a row each; empty tables give no hits or no rows.
    """
    hits = common.stored(matches(docs, items).select(*_KEY, "window", "start", "length"), "hits")
    order = Window.partitionBy(*_KEY).orderBy("start", F.desc("length"))
    before = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(
        F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    )
    stretches = hits.select(*_KEY, "start", "length").distinct()
    covered = stretches.select(*_KEY, fresh.alias("fresh")).groupBy(*_KEY).agg(F.sum("fresh").alias("n_hit"))
    named = _windows(items).select("window", "item").distinct()
    owned = (
        hits.select(*_KEY, "window")
        .distinct()
        .join(named, "window")
        .groupBy(*_KEY)
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    found = covered.join(owned, [covered[c].eqNullSafe(owned[c]) for c in _KEY]).select(
        covered["doc_id"].alias("_doc"), covered["row_key"].alias("_key"), "n_hit", "item_ids"
    )
    rows = _rows(docs).select(*_KEY, word_count(F.col("text")).alias("n_words"))
    same = rows["doc_id"].eqNullSafe(found["_doc"]) & (rows["row_key"] == found["_key"])
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(found, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        ids.alias("item_ids"),
        "row_key",
    )
