"""Release analytics over commits(repo, ts, hash, subject, body)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import rules
from ..functions.sqltext import text_array, text_list
from ..functions.text import BLANKS, char_class, strip
from .ancestry import since_tag
from .ranking import first_ranks, ranked

_BLANK = char_class(BLANKS)
_SUBJECT = f"^(\\w+)(?:\\(([^)]*)\\))?(!)?{_BLANK}*:{_BLANK}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+)$"


def _formed() -> Column:
    return F.rlike("subject", F.lit(_SUBJECT))


def _with_fields(commits: DataFrame) -> DataFrame:
    """Adds `_fields`: type, scope, '!' and text of a conventional subject.

    One match gives all groups; NUL cannot occur in a subject.  Other subjects
    stay whole, as an array of one.
    """
    groups = "$1\x00$2\x00$3\x00$4"
    return commits.select(
        "*", F.split(F.regexp_replace("subject", _SUBJECT, groups), "\x00").alias("_fields")
    )


def parse_commits(commits: DataFrame) -> DataFrame:
    """Adds type, scope, breaking and description; other subjects drop out."""
    return _with_fields(commits.filter(_formed())).select(
        *commits.columns,
        F.expr("lower(_fields[0])").alias("type"),
        F.expr("nullif(_fields[1], '')").alias("scope"),
        F.expr("_fields[2] = '!'").alias("breaking"),
        strip(F.col("_fields")[3]).alias("description"),
    )


def latest_tags(tags: DataFrame) -> DataFrame:
    """The newest 'v…' tag of each repo."""
    newest = F.max_by(F.struct("version", "ts"), F.struct("ts", "version"))
    return (
        tags.filter(F.startswith("version", F.lit("v")))
        .groupBy("repo")
        .agg(newest.alias("tag"))
        .select("repo", F.col("tag.version").alias("version"), F.col("tag.ts").alias("tag_ts"))
    )


def commits_since_release(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Commits newer than their repo's latest tag; all where there is none.

    For histories without parents: ancestry is approximated by time.  A repo with very many commits is split by AQE, or
    never gathered, where the tags turn out small enough to be broadcast.
    """
    joined = commits.join(latest_tags(tags).select("repo", "tag_ts"), "repo", "left")
    return joined.filter(F.col("tag_ts").isNull() | (F.col("ts") > F.col("tag_ts"))).drop("tag_ts")


def commits_since_tag(commits: DataFrame, tags: DataFrame, heads: DataFrame) -> DataFrame:
    """Commits that their repo's heads reach and its nearest 'v…' tag doesn't; all reachable ones
    where no such tag is reachable.

    commits have `parents`, the first one first; tags(repo, version, hash); heads(repo, hash).
    Timestamps play no part, so commits of side branches count from where they were merged.
    """
    return since_tag(commits, tags, heads)[0]


def last_commits(commits: DataFrame, n: int = 1) -> DataFrame:
    """The n newest commits of each repo; only n per repo and task are exchanged."""
    return first_ranks(commits, ["repo"], [F.desc("ts"), F.desc("hash")], n, "_rank").drop("_rank")


def _with_checks(commits: DataFrame) -> DataFrame:
    """Adds what validation looks at: formed, kind, and the text after the first
    colon that has any."""
    after_colon = f":{_BLANK}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+)$"
    return commits.select(
        "*",
        _formed().alias("_formed"),
        F.lower(F.regexp_extract("subject", "^(\\w+)", 1)).alias("_kind"),
        strip(F.regexp_extract("subject", after_colon, 1)).alias("_text"),
    )


_UNKNOWN = f"_formed AND _kind NOT IN ({text_list(fv.COMMIT_TYPES)})"
_SHORT = f"_formed AND length(_text) < {fv.MIN_DESCRIPTION_CHARS}"
_UPPER = "_formed AND left(_text, 1) = upper(left(_text, 1)) AND left(_text, 1) <> lower(left(_text, 1))"


def validate_commits(commits: DataFrame) -> DataFrame:
    """One row per problem: (…, error, detail)."""
    def problem(when: str, error: str, detail: str) -> str:
        return f"IF({when}, named_struct('error', '{error}', 'detail', {detail}), NULL)"

    problems = ", ".join(
        [
            problem("NOT _formed", "format", "'expected type(scope): description'"),
            problem(_UNKNOWN, "unknown_type", "_kind"),
            problem(_SHORT, "too_short", "CAST(length(_text) AS STRING)"),
            problem(_UPPER, "upper_case", "left(_text, 1)"),
        ]
    )
    kept = [c for c in commits.columns if c != "body"]
    return (
        _with_checks(commits)
        .select(*kept, F.expr(f"inline(array_compact(array({problems})))"))
    )


def commit_verdicts(commits: DataFrame) -> DataFrame:
    """Per repo: commits checked, problems, and whether all are fine."""
    problems = F.expr(
        f"IF(NOT _formed, 1, int({_UNKNOWN}) + int({_SHORT}) + int({_UPPER}))"
    )
    checked = _with_checks(commits).select("repo", problems.alias("_problems"))
    return checked.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("_problems").alias("problems"),
        F.bool_and(F.col("_problems") == 0).alias("valid"),
    )


def bump_type(commits: DataFrame) -> DataFrame:
    """Per repo the largest bump its commits ask for; NULL when none does.

    Other subjects are not filtered out but count as no bump, so repos without
    any conventional commit stay in the result after one pass.
    """
    breaking = (
        (F.get("_fields", F.lit(2)) == "!")
        | F.contains("body", F.lit("BREAKING CHANGE"))
        | F.contains("body", F.lit("BREAKING-CHANGE"))
    )
    kind = F.lower(F.get("_fields", F.lit(0)))
    level = F.when(
        F.size("_fields") == 4,
        F.when(breaking, 3).when(kind.isin(fv.MINOR_TYPES), 2).when(kind.isin(fv.PATCH_TYPES), 1),
    )
    names = F.expr("CASE level WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'patch' END")
    levels = _with_fields(commits).select("repo", level.alias("level"))
    return levels.groupBy("repo").agg(F.max("level").alias("level")).select(
        "repo", names.alias("bump")
    )


def next_version_expr(version, bump) -> Column:
    """'v1.2.3' or '1.2.3' and a bump -> the next version."""
    bare = F.regexp_replace(version, "^v", "")
    major, minor, patch = (
        F.split_part(bare, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3)
    )
    return (
        F.when(bump == "major", F.concat_ws(".", (major + 1).cast("string"), F.lit("0"), F.lit("0")))
        .when(bump == "minor", F.concat_ws(".", major.cast("string"), (minor + 1).cast("string"), F.lit("0")))
        .when(
            bump == "patch",
            F.concat_ws(".", major.cast("string"), minor.cast("string"), (patch + 1).cast("string")),
        )
    )


def next_versions(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Per repo with a release: its version, the bump since then, the next version."""
    bumps = bump_type(commits_since_release(commits, tags))
    released = latest_tags(tags).select("repo", "version")
    return released.join(bumps, "repo", "left").select(
        "repo", "version", "bump",
        next_version_expr(F.col("version"), F.col("bump")).alias("next_version"),
    )


def next_versions_by_tag(commits: DataFrame, tags: DataFrame, heads: DataFrame) -> DataFrame:
    """`next_versions` with releases and pending commits found by ancestry."""
    pending, nearest = since_tag(commits, tags, heads)
    released = nearest.select("repo", "version")
    return released.join(bump_type(pending), "repo", "left").select(
        "repo", "version", "bump",
        next_version_expr(F.col("version"), F.col("bump")).alias("next_version"),
    )


def _entries(commits: DataFrame) -> DataFrame:
    scope = F.coalesce(F.concat(F.lit("**"), F.col("scope"), F.lit("**: ")), F.lit(""))
    section = F.coalesce(rules.lookup("type", fv.CHANGELOG_SECTIONS), F.lit("Other"))
    order = text_array(fv.CHANGELOG_ORDER)
    return parse_commits(commits).withColumn("section", section).select(
        "*",
        F.expr(f"CAST(array_position({order}, section) AS INT)").alias("section_rank"),
        F.concat(
            F.lit("- "), scope, F.col("description"), F.lit(" ("), F.left("hash", F.lit(7)), F.lit(")")
        ).alias("line"),
    )


def changelog_entries(commits: DataFrame) -> DataFrame:
    """Changelog lines by section, newest first.

    A repo's changelog stays rows in order and is never gathered into one value.
    """
    entries = _entries(commits).select("repo", "section", "section_rank", "ts", "hash", "line")
    order = [F.desc("ts"), F.desc("hash")]
    numbered = ranked(entries, ["repo", "section"], order, "entry_rank")
    return numbered.select("repo", "section", "section_rank", "entry_rank", "line")


def breaking_notes(commits: DataFrame) -> DataFrame:
    body = F.coalesce("body", F.lit(""))
    note = F.get(
        F.filter(
            F.split(body, "\n"),
            lambda l: F.startswith(l, F.lit("BREAKING CHANGE:"))
            | F.startswith(l, F.lit("BREAKING-CHANGE:")),
        ),
        F.lit(0),
    )
    parsed = parse_commits(commits)
    return parsed.filter(
        F.col("breaking") | F.contains(body, F.lit("BREAKING CHANGE"))
    ).select(
        "repo", "ts", "hash",
        F.coalesce(note, F.concat("description", F.lit(" (BREAKING)"))).alias("note"),
    )


def whats_new(commits: DataFrame) -> DataFrame:
    """Descriptions of the commits that users notice."""
    parsed = parse_commits(commits)
    return parsed.filter(F.col("type").isin(fv.USER_FACING_TYPES)).select(
        "repo", "ts", "hash", "type", "description"
    )


def changelog_text(
    commits: DataFrame, versions: DataFrame, date: str
) -> DataFrame:
    """Rows (repo, part, section_rank, line_no, line) that, sorted, are the changelog.

    versions(repo, version) names the release.  Write with
    `orderBy('repo', 'part', 'section_rank', 'line_no')`.
    """
    def heading(rows: DataFrame, part: int, rank, line) -> DataFrame:
        return rows.select(
            "repo", F.lit(part).alias("part"), rank.alias("section_rank"),
            F.lit(0).cast("bigint").alias("line_no"), line.alias("line"),
        )

    def lines(rows: DataFrame, part: int, rank, number, line) -> DataFrame:
        return rows.select(
            "repo", F.lit(part).alias("part"), rank.alias("section_rank"),
            number.alias("line_no"), line.alias("line"),
        )

    entries = changelog_entries(commits)
    notes = ranked(
        breaking_notes(commits), ["repo"], [F.desc("ts"), F.desc("hash")], "line_no"
    )
    zero = F.lit(0)
    return (
        heading(versions, 0, zero, F.concat(F.lit("## "), "version", F.lit(f" — {date}")))
        .unionByName(heading(notes.select("repo").distinct(), 1, zero, F.lit("### BREAKING CHANGES")))
        .unionByName(
            lines(notes, 1, zero, F.col("line_no"), F.concat(F.lit("- "), F.col("note")))
        )
        .unionByName(
            heading(
                entries.select("repo", "section", "section_rank").distinct(),
                2, F.col("section_rank"), F.concat(F.lit("### "), F.col("section")),
            )
        )
        .unionByName(
            lines(entries, 2, F.col("section_rank"), F.col("entry_rank"), F.col("line"))
        )
    )
