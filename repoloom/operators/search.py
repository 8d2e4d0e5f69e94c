"""Ranked keyword search over flattened items."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from . import search_index
from .rounds import Rounds
from .search_index import haystack


def search_terms(query: str) -> list[str]:
    """Lower-cased words; repeated words stay and count again."""
    return query.lower().split()


def _score(terms: Sequence[str]) -> Column:
    score = F.lit(0)
    for term in terms:
        score = score + F.contains(F.col("haystack"), F.lit(term)).cast("int")
    return score


def search(items: DataFrame, query: str, k: int = fv.SEARCH_LIMIT) -> DataFrame:
    """The k best items by number of terms contained; ties by path.

    Each task keeps its own k best, so only k rows per task are exchanged.
    """
    terms = search_terms(query)
    if not terms:
        return items.withColumn("score", F.lit(0)).filter(F.lit(False))
    scored = items.withColumn("haystack", haystack()).withColumn("score", _score(terms))
    ties = [c for c in ("path", "repo", "doc_id") if c in items.columns]
    # Rows without a term sort last, so dropping them from the k best is exact
    # and leaves the score out of a second evaluation in a pushed-down filter.
    best = scored.orderBy(F.desc("score"), *ties).limit(k)
    return best.filter(F.col("score") > 0).drop("haystack")


def search_many(items: DataFrame, queries: DataFrame, k: int = fv.SEARCH_LIMIT) -> DataFrame:
    """`search` for a table queries(query_id, query), ranked per query.

    Builds an index of the items for these queries; to ask again, build one with
    `search_index.build` and search that.
    """
    spark = items.sparkSession
    folder = Rounds(spark, "search").base
    search_index.build(items, folder)
    return search_index.search(spark, folder, queries, k)
