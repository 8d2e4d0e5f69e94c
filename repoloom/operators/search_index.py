"""Keyword search for tables of queries over a stored index of character trigrams.

An index is three tables in one folder:

* `items`: the items with a number each, and the text that is searched;
* `postings`: for each trigram and block of item numbers, the sorted places in that block;
* `frequencies`: for each trigram the number of items that hold it.

Postings hold numbers only.  A search reads those of the rarest trigrams of each term,
intersects them block by block, looks at the texts of what is left, and fetches
the items themselves for the ranked results alone.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .ranking import first_ranks
from .rounds import Rounds

GRAM = 3
#: Items per block, as a power of two: the longest list a posting can hold.
BLOCK_BITS = 16
#: Trigrams of a term that are intersected, the rarest first.
RAREST = 3
#: Trigrams of a search up to which they go to the scan as a filter; beyond, a join finds them.
PUSHED_GRAMS = 2000
#: Items that hold a term, up to which they are paired with each query that asks for it.
SHARED_ITEMS = 64


def _grams(text: Column) -> Column:
    """Distinct trigrams; a shorter text is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(GRAM))))


def haystack() -> Column:
    """The text of an item that is searched."""
    name, description, path = (F.coalesce(F.col(p), F.lit("")) for p in ("name", "description", "path"))
    tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")
    # A blank stands where an item has neither purpose nor tags.
    return F.lower(F.concat_ws(" ", name, description, tags, path))


def build(items: DataFrame, folder: str) -> None:
    """Writes the index of items(name, description, tags, path, ...) to a folder that all executors reach."""
    spark = items.sparkSession
    numbered = items.select("*", haystack().alias("_hay"), F.monotonically_increasing_id().alias("_row"))
    numbered.write.mode("overwrite").parquet(f"{folder}/items")
    stored = spark.read.parquet(f"{folder}/items")
    mask = (1 << BLOCK_BITS) - 1
    places = stored.select(
        F.shiftright("_row", BLOCK_BITS).alias("block"),
        F.col("_row").bitwiseAND(F.lit(mask)).cast("int").alias("place"),
        F.explode(_grams(F.col("_hay"))).alias("gram"),
    )
    postings = places.groupBy("gram", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(tasks, "gram", "block").sortWithinPartitions("gram", "block").write.mode(
        "overwrite"
    ).parquet(f"{folder}/postings")
    written = spark.read.parquet(f"{folder}/postings")
    counted = written.groupBy("gram").agg(F.sum(F.size("places").cast("bigint")).alias("items"))
    counted.write.mode("overwrite").parquet(f"{folder}/frequencies")


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries(query_id, query): lower-cased words; blank ones drop out."""
    return (
        queries.select("query_id", F.explode(F.split(F.lower("query"), "(?U)\\s+")).alias("term"))
        .filter(F.col("term") != "")
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def _chosen(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(term, gram, needed): the grams that an item must hold for a term, all `needed` of them or,
    for terms shorter than a gram, any one."""
    long = terms.filter(F.length("term") >= GRAM)
    every = long.select("term", F.explode(_grams(F.col("term"))).alias("gram"))
    counted = every.join(frequencies, "gram", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    rarest = first_ranks(counted, ["term"], [F.col("items"), F.col("gram")], RAREST, "_place")
    needed = F.least(F.size(_grams(F.col("term"))), F.lit(RAREST)).cast("bigint")
    # A short term is part of some gram of each text that holds it.
    starts = F.sequence(F.lit(1), F.length("gram"))
    inside = F.array_distinct(
        F.flatten(F.transform(starts, lambda i: F.array(F.substr(F.col("gram"), i, F.lit(1)), F.substr(F.col("gram"), i, F.lit(2)))))
    )
    parts = frequencies.select("gram", F.explode(inside).alias("term"))
    short = terms.filter(F.length("term") < GRAM).join(parts, "term")
    return rarest.select("term", "gram", needed.alias("needed")).unionByName(
        short.select("term", "gram", F.lit(1).cast("bigint").alias("needed"))
    )


def candidates(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """(term, _row): items that hold the chosen grams of a term."""
    chosen = _chosen(terms, spark.read.parquet(f"{folder}/frequencies"))
    postings = spark.read.parquet(f"{folder}/postings")
    wanted = [r.gram for r in chosen.select("gram").distinct().limit(PUSHED_GRAMS + 1).collect()]
    if len(wanted) <= PUSHED_GRAMS:
        postings = postings.filter(F.col("gram").isin(wanted))
    met = postings.join(chosen, "gram")
    row = F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("place").cast("bigint"))
    # At most RAREST lists, each bounded by its block, are intersected as they are.
    lists = met.filter(F.length("term") >= GRAM).groupBy("term", "block", "needed")
    lists = lists.agg(F.collect_list("places").alias("lists")).filter(F.size("lists") >= F.col("needed"))
    first, others = F.get("lists", F.lit(0)), F.slice("lists", F.lit(2), F.size("lists"))
    common = F.aggregate(others, first, lambda held, own: F.array_intersect(held, own))
    long = lists.select("term", "block", F.explode(common).alias("place"))
    # Short terms need one list.
    short = met.filter(F.length("term") < GRAM).select("term", "block", F.explode("places").alias("place")).distinct()
    return long.unionByName(short).select("term", row.alias("_row"))


def contenders(asked: DataFrame, held: DataFrame, order: DataFrame, ties: list[str], k: int) -> DataFrame:
    """(query_id, _row, score): all that can be among the k best items of a query, each with its whole score.

    asked(query_id, term, times), held(term, _row), order(_row, *ties).  Terms that many items hold are not
    paired item by item with the queries that ask for them.  Items that hold the same of these
    terms are one class, of which k can be best; queries that ask for the same of them share
    one ranking of the classes' items.  An item that holds no other term of a query must be in that ranking;
    one that does comes from the short lists of the other terms.
    """
    many = held.groupBy("term").agg(F.count(F.lit(1)).alias("items")).filter(F.col("items") > SHARED_ITEMS)
    many = many.select("term")
    wide, few = held.join(many, "term", "left_semi"), held.join(many, "term", "left_anti")
    classes = wide.groupBy("_row").agg(F.sort_array(F.collect_list("term")).alias("class"))
    parts = asked.join(many, "term", "left_semi").groupBy("query_id")
    profiles = parts.agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("profile"))

    by = [F.col(c) for c in (*ties, "_row")]
    first = first_ranks(classes.join(order, "_row"), ["class"], by, k, "_place").drop("_place")
    terms = profiles.select("profile").distinct().select("profile", F.explode("profile").alias("part"))
    terms = terms.select("profile", "part.term", "part.times")
    met = first.select("class").distinct().select("class", F.explode("class").alias("term")).join(terms, "term")
    scored = met.groupBy("profile", "class").agg(F.sum("times").alias("score")).join(first, "class")
    best = first_ranks(scored, ["profile"], [F.desc("score"), *by], k, "_place")
    shared = profiles.join(best.select("profile", "_row", "score"), "profile").select("query_id", "_row", "score")

    listed = few.join(asked, "term").groupBy("query_id", "_row").agg(F.sum("times").alias("score"))
    both = listed.join(classes, "_row", "left").join(profiles, "query_id", "left")
    also = F.filter("profile", lambda part: F.array_contains("class", part["term"]))
    more = F.aggregate(also, F.lit(0).cast("bigint"), lambda sum_, part: sum_ + part["times"])
    own = both.select("query_id", "_row", (F.col("score") + F.coalesce(more, F.lit(0))).alias("score"))
    return shared.unionByName(own).groupBy("query_id", "_row").agg(F.max("score").alias("score"))


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = fv.SEARCH_LIMIT) -> DataFrame:
    """The k best items of each of queries(query_id, query): query_id, score, the items' columns, rank.

    Score counts the query's words that an item holds, repeated words again; ties by path,
    repo and doc_id as far as the items have them.
    """
    asked = asked_terms(queries)
    items = spark.read.parquet(f"{folder}/items")
    columns = [c for c in items.columns if c not in ("_hay", "_row")]
    found = candidates(spark, folder, asked.select("term").distinct())
    # A term that is one gram, or part of one, needs no second look.
    sure = found.filter(F.length("term") <= GRAM)
    open_ = found.filter(F.length("term") > GRAM).join(items.select("_row", "_hay"), "_row")
    held = sure.unionByName(open_.filter(F.contains("_hay", F.col("term"))).select("term", "_row"))
    held = Rounds(spark, "held").store(held)
    ties = [c for c in ("path", "repo", "doc_id") if c in columns]
    order = items.select("_row", *ties)
    scored = contenders(asked, held, order, ties, k).withColumn("score", F.col("score").cast("int"))
    placed = scored.join(order, "_row")
    best = first_ranks(placed, ["query_id"], [F.desc("score"), *(F.col(c) for c in (*ties, "_row"))], k, "rank")
    return best.select("query_id", "_row", "score", "rank").join(items, "_row").select(
        "query_id", "score", *columns, "rank"
    )
