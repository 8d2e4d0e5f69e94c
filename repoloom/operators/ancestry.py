"""Reachability in commit histories: commits(repo, hash, parents array<string>).

A history is cut into chains, runs of first parents.  With a commit's chain goes its depth,
the number of first parents below it; what is reachable from a commit, seen in one chain, is always
all that is no deeper than some commit of it.  So the ancestors of any set of commits are
one number per chain, and following them costs a join with the edges between chains,
of which there are as many as branches and merges.

Chains and depths come from pointer doubling: a pointer first names the first parent, and
each round makes it twice as long, so a history of a million commits takes twenty rounds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .rounds import Rounds

_KEY = ["repo", "hash"]


def chains(commits: DataFrame, heads: DataFrame, rounds: Rounds) -> DataFrame:
    """(repo, hash, chain, depth) of every commit.

    The chain is named by the commit it ends in: of all commits that come to this one by first
    parents, a head before others, then the newest, then the largest hash.  A commit's
    first parents down to the root keep their chain until a preferred one joins.  Parents
    that aren't in the table count as absent, as in a shallow clone.
    """
    own = commits.select("repo", "hash", "ts", F.get("parents", F.lit(0)).alias("parent"))
    own = own.dropDuplicates(_KEY)
    tips = heads.select(*_KEY).distinct().withColumn("is_head", F.lit(True))
    own = own.join(tips, _KEY, "left").withColumn("is_head", F.coalesce("is_head", F.lit(False)))
    # Numbered in the order of preference, so that rounds carry whole numbers only and a tip is a maximum.
    numbered = ranked(own, [], [F.col(c) for c in ("is_head", "ts", "hash", "repo")], "id")
    named = rounds.store(numbered.select("id", *_KEY, "parent"))
    known = named.select("repo", F.col("hash").alias("parent"), F.col("id").alias("jump"))
    state = rounds.store(
        named.join(known, ["repo", "parent"], "left").select(
            "id", "jump", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
            F.col("id").alias("tip"),
        )
    )
    while True:
        on = state.filter("jump IS NOT NULL")
        if on.isEmpty():
            break
        # What a pointer's start has seen so far goes to where the pointer ends.
        seen = on.groupBy(F.col("jump").alias("id")).agg(F.max("tip").alias("seen"))
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        longer = on.join(ahead, "jump").select(
            "id", F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"), "tip"
        )
        # Pointers that have come to a root stay as they are.
        both = longer.unionByName(state.filter("jump IS NULL"))
        state = rounds.store(
            both.join(seen, "id", "left").select("id", "jump", "depth", F.greatest("tip", "seen").alias("tip")), state
        )
    names = named.select(F.col("id").alias("tip"), F.col("hash").alias("chain"))
    ends = named.select("id", *_KEY).join(state, "id").join(names, "tip")
    return rounds.store(ends.select(*_KEY, "chain", "depth"), state, named)


def crossings(commits: DataFrame, placed: DataFrame) -> DataFrame:
    """(repo, chain, depth, to_chain, to_depth): parents that lie in another chain."""
    edges = (
        commits.select(*_KEY, F.explode("parents").alias("parent"))
        .join(placed, _KEY)
        .select("repo", F.col("parent").alias("hash"), "chain", "depth")
    )
    there = placed.select(*_KEY, F.col("chain").alias("to_chain"), F.col("depth").alias("to_depth"))
    # A parent in the same chain is below on it, and so reached anyway.
    return edges.join(there, _KEY).filter("chain <> to_chain").select(
        "repo", "chain", "depth", "to_chain", "to_depth"
    )


def ancestors(starts: DataFrame, crossing: DataFrame, rounds: Rounds) -> DataFrame:
    """(source, repo, chain, depth): how far up each chain the ancestors of each source reach.

    starts(source, repo, chain, depth) are commits that count as their own ancestors.  Each
    round follows the crossings that the one before opened; there are as many as the deepest
    nesting of branches.
    """
    key = ["source", "repo", "chain"]
    fresh = rounds.store(
        starts.groupBy(*key).agg(F.max("depth").alias("depth")).withColumn("before", F.lit(-1).cast("bigint"))
    )
    reached = rounds.store(fresh.select(*key, "depth"))
    while not fresh.isEmpty():
        opened = (
            fresh.alias("f")
            .join(crossing.alias("c"), ["repo", "chain"])
            .filter("c.depth <= f.depth AND c.depth > f.before")
            .groupBy("source", "repo", F.col("to_chain").alias("chain"))
            .agg(F.max("to_depth").alias("found"))
        )
        beyond = opened.join(reached, key, "left").filter("depth IS NULL OR found > depth")
        ahead = rounds.store(
            beyond.select(
                *key, F.col("found").alias("depth"), F.coalesce("depth", F.lit(-1)).alias("before")
            )
        )
        both = reached.unionByName(ahead.select(*key, "depth"))
        reached = rounds.store(both.groupBy(*key).agg(F.max("depth").alias("depth")), reached, fresh)
        fresh = ahead
    rounds.drop(fresh)
    return reached


def _held(rows: DataFrame, reach: DataFrame, out: str) -> DataFrame:
    """Rows(repo, chain, depth) with a flag: whether the source's ancestors hold them."""
    bound = reach.select("repo", "chain", F.col("depth").alias("_bound"))
    flag: Column = F.coalesce(F.col("depth") <= F.col("_bound"), F.lit(False))
    return rows.join(bound, ["repo", "chain"], "left").withColumn(out, flag).drop("_bound")


def describe(
    placed: DataFrame, crossing: DataFrame, reach: DataFrame, commits: DataFrame, tags: DataFrame, rounds: Rounds
) -> DataFrame:
    """The nearest tag of each repo, (repo, version, hash): one of the head's ancestors
    with the fewest commits after it; on ties the newest version text.

    A tag that another reachable tag can reach is never nearest, so only the others are
    followed for themselves.
    """
    marked = tags.select("repo", "version", "hash").join(placed, _KEY)
    marked = rounds.store(_held(marked, reach, "held").filter("held").drop("held"))
    parents = marked.join(commits.select(*_KEY, F.explode("parents").alias("parent")), _KEY)
    below = parents.select("repo", F.col("parent").alias("hash")).join(placed, _KEY)
    below = below.select(F.lit("").alias("source"), "repo", "chain", "depth")
    nearest = rounds.store(
        _held(marked, ancestors(below, crossing, rounds), "passed").filter("NOT passed").drop("passed")
    )
    own = ancestors(
        nearest.select(F.col("version").alias("source"), "repo", "chain", "depth"), crossing, rounds
    )
    # A chain's commits have consecutive depths, so its ancestors are counted without looking at them.
    lowest = placed.groupBy("repo", "chain").agg(F.min("depth").alias("_lowest"))
    sizes = (
        own.join(lowest, ["repo", "chain"])
        .groupBy("repo", "source")
        .agg(F.sum(F.col("depth") - F.col("_lowest") + 1).alias("size"))
    )
    best = nearest.join(sizes.withColumnRenamed("source", "version"), ["repo", "version"])
    return best.groupBy("repo").agg(
        F.max(F.struct("size", "version", "hash")).alias("tag")
    ).select("repo", F.col("tag.version").alias("version"), F.col("tag.hash").alias("hash"))


def since_tag(
    commits: DataFrame, tags: DataFrame, heads: DataFrame, prefix: str = "v"
) -> tuple[DataFrame, DataFrame]:
    """Commits that heads reach and their nearest tag doesn't, and (repo, version, hash) of those tags.

    commits(repo, hash, ts, parents, ...), tags(repo, version, hash), heads(repo, hash), one or
    more per repo.  A repo without a reachable tag whose name starts with `prefix` gives all
    that its heads reach; one without heads gives nothing.
    """
    rounds = Rounds(commits.sparkSession, "ancestry")
    links = rounds.store(commits.select("repo", "hash", "ts", "parents"))
    placed = chains(links, heads, rounds)
    crossing = rounds.store(crossings(links, placed))
    starts = heads.select(*_KEY).join(placed, _KEY).select(F.lit("").alias("source"), "repo", "chain", "depth")
    reach = ancestors(starts, crossing, rounds)
    versions = tags.filter(F.startswith("version", F.lit(prefix)))
    nearest = rounds.store(describe(placed, crossing, reach, links, versions, rounds), links)
    tagged = nearest.join(placed, _KEY).select(F.lit("").alias("source"), "repo", "chain", "depth")
    released = ancestors(tagged, crossing, rounds)
    rounds.drop(crossing)
    pending = _held(_held(placed, reach, "head"), released, "old").filter("head AND NOT old")
    return commits.join(pending.select(*_KEY), _KEY, "left_semi"), nearest
