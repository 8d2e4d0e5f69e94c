"""Requests to a describing or annotating model, and its responses.

The calls themselves are outside: these are tables before and after them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import paths, rules, text
from . import filters, marks
from .ranking import ranked
from .rounds import Rounds

# Wording of the requests.
DESCRIBE_STYLES = {
    "plain": (
        "For every path below write one description of 15 to 25 words in everyday language, "
        "for readers who do not write software. Avoid specialist vocabulary and abbreviations; "
        "say what the file achieves for the people who use the product. "
        "Lines that begin with | show how the file starts; rely on them rather than on the name."
    ),
    "technical": (
        "For every path below write one description of 15 to 25 words for software engineers. "
        "State what it does, with the libraries, patterns and behaviour that matter. "
        "Lines that begin with | show how the file starts; imports, classes and functions "
        "tell more than the name."
    ),
}
DESCRIBE_EXAMPLES = {
    "plain": '{"shop/src/cart.py": "Keeps track of what a visitor wants to buy and adds up the price before they pay"}',
    "technical": '{"shop/src/cart.py": "Cart aggregate with line-item pricing, coupon validation and Redis-backed persistence"}',
}
ANSWER_FORMAT = (
    "Answer with a single JSON object that maps each path to its description, "
    "without code fences and without any other text."
)

ANNOTATE_ROLES = {
    "tutor": "You are a kind programming teacher. Comment the {language} file below so that a learner understands what it does and why.",
    "minimal": "Comment the {language} file below as briefly as possible.",
    "technical": "Comment the {language} file below to the standard of a professional code base.",
    "non-technical": "Comment the {language} file below for a reader who has never programmed.",
}
ANNOTATE_STYLES = {
    "tutor": "Give reasons rather than paraphrases, name patterns, warn of pitfalls, and write about one comment for every three to five lines.",
    "minimal": "Use one line of at most ten words per logical section, and only where the code does not speak for itself.",
    "technical": "Use exact terms, mention complexity, edge cases, side effects and thread safety, and document parameters and results.",
    "non-technical": "Use no technical terms; compare with everyday things and say what the code achieves.",
}
ANNOTATE_RULES = (
    "Rules:\n"
    "- Return the whole file with comments added and no code changed.\n"
    "- No code fences and no text around the file.\n"
    "- Keep formatting, indentation and existing comments as they are.\n"
    "- Put each comment on a line of its own, in the comment syntax of the language."
)


def batch_size_for(has_snippets: bool, size: int = fv.BATCH_SIZE) -> int:
    return min(size, fv.BATCH_SIZE_WITH_SNIPPETS) if has_snippets else size


def batch_paths(nodes: DataFrame, size: int = fv.BATCH_SIZE, snippets: bool = True) -> DataFrame:
    """Consecutive batches per repo in the order of a walk, at most `size` paths each.

    A repo with any snippet gets smaller batches.  Rows carry `has_code` and, unless `snippets`
    is false, the first lines of the snippet, as many as a request shows.  What a row is ranked
    by is found once and stored, so the headers are read once.
    """
    kept = nodes if "kind" in nodes.columns else nodes.withColumn("kind", F.lit("file"))
    ids = ["doc_id"] if "doc_id" in nodes.columns else []
    code = F.col("snippet").isNotNull().alias("has_code")
    shown = [text.first_lines(F.col("snippet"), fv.PROMPT_SNIPPET_LINES).alias("snippet")] if snippets else []
    rounds = Rounds(nodes.sparkSession, "batches")
    keys = rounds.store(kept.select("repo", "path", *ids, code, *shown, paths.walk_key().alias("_walk")))
    repos = keys.groupBy("repo").agg(F.max("has_code").alias("_any_code"))
    order = [F.col(c) for c in ("_walk", *ids)]
    numbered = ranked(keys, ["repo"], order, "position").drop("_walk")
    per_batch = F.when(F.col("_any_code"), F.lit(batch_size_for(True, size))).otherwise(F.lit(size))
    return numbered.join(repos, "repo").select(
        *numbered.columns,
        F.floor((F.col("position") - 1) / per_batch).cast("bigint").alias("batch_id"),
    )


def path_entry(path, snippet) -> Column:
    """The path, followed by the first lines of its snippet, each set off by '|'."""
    preview = text.first_lines(snippet, fv.PROMPT_SNIPPET_LINES)
    quoted = F.concat(F.lit("\n  | "), F.replace(preview, F.lit("\n"), F.lit("\n  | ")))
    return F.concat(path, F.coalesce(quoted, F.lit("")))


def build_requests(batches: DataFrame, readmes: DataFrame, style: str = "plain") -> DataFrame:
    """One prompt per batch; a batch never holds more than its fixed number of paths."""
    if style not in DESCRIBE_STYLES:
        raise ValueError(f"unknown style {style!r}: use one of {sorted(DESCRIBE_STYLES)}")
    entry = F.struct("position", path_entry(F.col("path"), F.col("snippet")).alias("entry"))
    grouped = batches.groupBy("repo", "batch_id").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    readme = F.substring(F.coalesce("readme", F.lit("")), 1, fv.README_STORED_CHARS)
    context = F.when(readme != "", F.concat(F.lit(" Project context: "), readme)).otherwise("")
    contexts = readmes.select("repo", context.alias("_context"))
    return grouped.join(contexts, "repo", "left").select(
        "repo",
        "batch_id",
        F.size("entries").cast("bigint").alias("paths"),
        F.concat(
            F.lit(DESCRIBE_STYLES[style]),
            F.coalesce("_context", F.lit("")),
            F.lit("\n\nPaths:\n"),
            F.array_join(F.transform("entries", lambda e: e["entry"]), "\n"),
            F.lit(f"\n\n{ANSWER_FORMAT}\nExample: {DESCRIBE_EXAMPLES[style]}"),
        ).alias("prompt"),
    )


def _with_parsed(responses: DataFrame) -> DataFrame:
    """`body` replaced by `_entries`: key and value of each description, or null.

    Only a single object of strict JSON is a valid response.  Parsing inside brackets
    makes text after the object invalid instead of ignored.  Of a repeated key the last
    value counts, at the place of the first.
    """
    others = [c for c in responses.columns if c != "body"]
    clean = text.strip(F.regexp_replace("body", "```json|```", ""))
    wrapped = F.from_json(
        F.concat(F.lit("["), clean, F.lit("]")),
        "array<map<string,string>>",
        {"allowSingleQuotes": "false"},
    )
    parsed = responses.select(*others, wrapped.alias("_parsed"))
    single = F.expr("IF(size(_parsed) = 1, map_entries(get(_parsed, 0)), NULL)")
    keys = F.array_distinct(F.transform("_all", lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter("_all", lambda e: e["key"] == k), -1)
    entries = F.transform(keys, last)
    repeated = F.size(keys) < F.size("_all")
    return (
        parsed.select(*others, single.alias("_all"))
        .withColumn("_entries", F.when(repeated, entries).otherwise(F.col("_all")))
        .select(*others, "_entries")
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """(…, path, description, entry_no) rows; unparsable responses give none."""
    others = [c for c in responses.columns if c != "body"]
    return (
        _with_parsed(responses)
        .select(*others, F.posexplode("_entries").alias("entry_no", "entry"))
        .select(
            *others,
            "entry_no",
            F.col("entry.key").alias("path"),
            F.col("entry.value").alias("description"),
        )
    )


def merge_descriptions(
    parsed: DataFrame, keys: tuple[str, ...] = ("path",), order: tuple[str, ...] = ("batch_id", "entry_no")
) -> DataFrame:
    """The description of the last batch that names a path."""
    return parsed.groupBy(*keys).agg(
        F.max_by("description", F.struct(*order)).alias("description")
    )


def apply_descriptions(
    nodes: DataFrame, descriptions: DataFrame, keys: tuple[str, ...] = ("repo", "path")
) -> DataFrame:
    """Nodes with descriptions replaced where a non-empty one exists.

    `applied` tells which; `descriptions` has one row per key.
    """
    usable = descriptions.filter(F.col("description") != "").select(
        *keys, F.col("description").alias("_new")
    )
    applied = F.col("_new").isNotNull()
    return (
        nodes.join(usable, list(keys), "left")
        .withColumn("description", F.coalesce("_new", "description"))
        .withColumn(
            "description_source",
            F.when(applied, F.lit("model")).otherwise(F.col("description_source")),
        )
        .withColumn("applied", applied)
        .drop("_new")
    )


def batch_outcomes(responses: DataFrame) -> DataFrame:
    """Per response: parsed or failed, and the number of descriptions."""
    others = [c for c in responses.columns if c != "body"]
    return _with_parsed(responses).select(
        *others,
        F.expr("IF(_entries IS NULL, 'failed', 'parsed')").alias("status"),
        F.expr("CAST(IF(_entries IS NULL, 0, size(_entries)) AS BIGINT)").alias("descriptions"),
    )


def batches_with_code(batches: DataFrame) -> DataFrame:
    """Per batch: its paths and how many of them carry code."""
    return batches.groupBy("repo", "batch_id").agg(
        F.count(F.lit(1)).alias("paths"), F.count_if("has_code").alias("paths_with_code")
    )


def annotation_requests(
    files: DataFrame,
    mode: str = "tutor",
    strategy: str = "replace",
    extra_excludes: tuple[str, ...] = (),
    marker: str = fv.MARKER,
) -> DataFrame:
    """One prompt per annotatable file, old marks handled by the strategy first."""
    if mode not in fv.MODES:
        raise ValueError(f"unknown mode {mode!r}: use one of {fv.MODES}")
    ready = marks.apply_strategy(filters.annotatable(files, extra_excludes), strategy, marker)
    named = ready.select("*", paths.file_name().alias("_name"))
    named = named.withColumn("_ext", paths.extension("_name"))
    before, after = ANNOTATE_ROLES[mode].split("{language}")
    rest = (
        f"{after}\n\n{ANNOTATE_RULES}\n"
        f"- Begin every comment with \"{marker} [{mode}]\" right after the comment syntax, "
        f"for example // {marker} [{mode}] text or # {marker} [{mode}] text.\n\n"
        f"Style: {ANNOTATE_STYLES[mode]}\n\nFile: "
    )
    return named.select("*", rules.language("_ext").alias("language")).select(
        *[c for c in files.columns if c != "content"],
        "language",
        F.concat(
            F.lit(before), "language", F.lit(rest), "_name", F.lit("\n\n"), "content"
        ).alias("prompt"),
    )
