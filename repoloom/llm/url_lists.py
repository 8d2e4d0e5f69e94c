"""URL filters by dated lists: what was listed when a page was fetched.

A list entry says that a pattern was put on a list, or taken off, at some time.  The
entries of one (list, pattern) become validity intervals; a capture looks up every
pattern that could cover its URL and is judged by the intervals that hold its fetch time.

Patterns are a host, which covers its subdomains, or a host with a path, which covers the
paths below it.  Intervals are cut at the borders of fixed periods, so the equi-join is on
(pattern, period): a host with a third of all captures is spread over its periods, and
Spark splits what is still skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds per period of the join key.
PERIOD = 30 * 86400

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _AUTHORITY, 1)), r"\.$", "")


def segments(url: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals: list, pattern, since, until (exclusive, null while it lasts).

    In: list string, pattern string, at timestamp, active boolean; other columns are ignored.  An
    entry holds until the next one of its list and pattern; of entries at one time, an
    active one wins; entries that change nothing are merged.  Entries with a null are ignored.
    """
    by = Window.partitionBy("list", "pattern").orderBy("at")
    return (
        entries.select("list", F.lower("pattern").alias("pattern"), "at", "active")
        .dropna()
        .groupBy("list", "pattern", "at")
        .agg(F.max("active").alias("active"))
        .withColumn("was", F.coalesce(F.lag("active").over(by), F.lit(False)))
        .filter("active <> was")
        .withColumn("until", F.lead("at").over(by))
        .filter("active")
        .select("list", "pattern", F.col("at").alias("since"), "until")
    )


def _period(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / PERIOD)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Evaluates every capture against the entries active when it was fetched.

    In: captures (page_id, url, fetched timestamp); other columns are ignored.  Out, a row per
    row: page_id, url, fetched, n_matches (active entries that cover it), lists (their
    names, sorted, comma-joined), pattern (the longest, of equals the first), blocked.

    A null or hostless url, or a null fetch time, matches nothing.  Captures that repeat are
    judged alike; an empty list blocks nothing; an empty table of captures gives none.
    """
    wanted = captures.select("page_id", "url", "fetched")
    spans = captures.agg(F.min("fetched").alias("first"), F.max("fetched").alias("last")).first()
    valid = intervals(entries)
    # Patterns have paths of some depth; a URL is looked up no deeper.
    depth = valid.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    labels = F.split(host(F.col("url")), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    path = segments(F.col("url"))
    paths = F.transform(
        F.sequence(F.lit(0), F.least(F.size(path), F.lit(depth))),
        lambda i: F.concat_ws("/", host(F.col("url")), F.slice(path, 1, i)),
    )
    keys = (
        wanted.filter(F.col("fetched").isNotNull() & (host(F.col("url")) != ""))
        .distinct()
        .select("*", F.explode(F.array_distinct(F.concat(domains, F.transform(paths, F.lower)))).alias("key"))
        .withColumn("period", _period(F.col("fetched")))
    )
    first, last = F.lit(spans["first"]), F.lit(spans["last"])
    until = F.coalesce("until", F.timestamp_add("DAY", F.lit(1), last))
    cut = valid.filter((F.col("since") <= last) & (until > first)).withColumn(
        "_period",
        F.explode(F.sequence(_period(F.greatest("since", first)), _period(F.least(until, last)))),
    )
    held = (F.col("fetched") >= F.col("since")) & (
        F.col("until").isNull() | (F.col("fetched") < F.col("until"))
    )
    found = (
        keys.join(cut, (F.col("key") == F.col("pattern")) & (F.col("period") == F.col("_period")) & held)
        .groupBy("page_id", "url", "fetched")
        .agg(
            F.count("*").alias("n_matches"),
            F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"),
            F.min(F.struct((-F.length("pattern")).alias("n"), "pattern"))["pattern"].alias("pattern"),
        )
    )
    found = found.withColumnsRenamed({"page_id": "_page", "url": "_url", "fetched": "_fetched"})
    same = (
        F.col("page_id").eqNullSafe(F.col("_page"))
        & (F.col("url") == F.col("_url"))
        & (F.col("fetched") == F.col("_fetched"))
    )
    n = F.coalesce("n_matches", F.lit(0))
    return wanted.join(found, same, "left").select(
        "page_id",
        "url",
        "fetched",
        n.alias("n_matches"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "pattern",
        (n > 0).alias("blocked"),
    )
