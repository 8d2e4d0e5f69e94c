"""Rule tables turned into literal column expressions.

Rules become literals inside one projection (CASE, constant maps, constant
patterns compiled once per task), never a join on a regular expression.  Inputs
are given by column name.
"""

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .sqltext import text, text_array, text_list, text_map
from .text import HEADER_BLANKS, char_class

# Name and lower-cased extension of the column `path`.
PATH_NAME = "substring_index(path, '/', -1)"
PATH_EXTENSION = rf"lower(regexp_extract({PATH_NAME}, '(?s)^.+(\\.[^.]+)$', 1))"

_BLANK = char_class(HEADER_BLANKS)
# '.' stops at line feeds only.
_FLAGS = "(?d)"
# All rules begin with from, import or require: one class test rules out most
# positions of a text before any alternative is tried.
_STARTS = "(?=[fir])"
# Letters that equal an ASCII letter when case is ignored but do not become it
# in lower case.
_FOLDED = ("İıſ", "iis")


def is_one_of(key: str, values: Sequence[str]) -> Column:
    return F.expr(f"{key} IN ({text_list(values)})")


def lookup(key: str, table: Mapping[str, str]) -> Column:
    """Value of the key in a constant table, else NULL."""
    return F.expr(f"try_element_at({text_map(table)}, {key})")


def file_description(
    name: str = "name",
    exact: Mapping[str, str] = fv.FILE_DESCRIPTIONS,
    patterns: Sequence[tuple[str, str, str | None]] = tuple(fv.FILE_PATTERNS),
) -> Column:
    """Exact name first, then the first matching pattern, else NULL."""
    cases = []
    for pattern, wording, suffix in patterns:
        value = text(wording)
        if suffix is not None:
            value = f"concat({value}, regexp_replace({name}, {text(suffix)}, ''))"
        cases.append(f"WHEN {name} RLIKE {text(pattern)} THEN {value}")
    return F.expr(
        f"coalesce(try_element_at({text_map(exact)}, {name}), CASE {' '.join(cases)} END)"
    )


def directory_description(
    name: str = "name",
    depth: str = "depth",
    table: Mapping[str, str] = fv.DIRECTORY_DESCRIPTIONS,
) -> Column:
    return F.expr(
        f"coalesce(try_element_at({text_map(table)}, {name}), IF({depth} = 0,"
        f" {text(fv.ROOT_DESCRIPTION)}, {text(fv.OTHER_DIRECTORY_DESCRIPTION)}))"
    )


def language(ext: str = "ext", table: Mapping[str, str] = fv.LANGUAGES) -> Column:
    return F.expr(
        f"coalesce(try_element_at({text_map(table)}, {ext}),"
        f" nullif(ltrim('.', {ext}), ''), 'text')"
    )


def name_tags(
    name: str = "name", patterns: Sequence[tuple[str, str]] = tuple(fv.NAME_TAG_PATTERNS)
) -> Column:
    hits = ", ".join(f"IF({name} RLIKE {text(p)}, {text(tag)}, NULL)" for tag, p in patterns)
    return F.expr(f"array_compact(array({hits}))")


def _reach(rules: Mapping[str, Mapping]) -> str:
    """How far a rule can look after `from` or `require(`.

    Without repetition in the rules no match is longer than its pattern.  The word
    at the cut is completed, so that no word boundary appears there.
    """
    rests = [
        rest
        for forms in rules.values()
        for form in ("quoted", "module", "required")
        for rest in forms.get(form, ())
    ]
    if any(c in rest for rest in rests for c in "*+{"):
        return ".*"
    return f".{{0,{max(map(len, rests), default=0)}}}[\\p{{L}}\\p{{N}}\\p{{M}}_]*"


def import_pieces(
    snippet: str = "snippet", rules: Mapping[str, Mapping] = fv.IMPORT_TAG_RULES
) -> Column:
    """The parts of a header that import rules can match, in lower case.

    Every keyword gives its own piece (the look-ahead lets them overlap), and the
    separator cannot be crossed by any rule, so matching the joined pieces equals
    matching the whole header while most of a text is looked at only once.
    """
    reach = _reach(rules)
    piece = f"{_FLAGS}{_STARTS}(?=(from{_BLANK}+{reach}|import{_BLANK}+.*|require\\({reach}))."
    odd = " OR ".join(f"contains({snippet}, {text(c)})" for c in _FOLDED[0])
    folded = f"lower(translate({snippet}, {text(_FOLDED[0])}, {text(_FOLDED[1])}))"
    low = f"IF({odd}, {folded}, lower({snippet}))"
    return F.expr(
        f"array_join(regexp_extract_all({low}, {text(piece)}, 1), {text(chr(10) + ';' + chr(10))})"
    )


def import_tag_pattern(forms: Mapping[str, Sequence[str]]) -> str:
    """One pattern for all rules of a tag, for lower-cased text."""
    anywhere = [n.removeprefix(".*") for n in forms.get("named", ()) if n.startswith(".*")]
    direct = [n for n in forms.get("named", ()) if not n.startswith(".*")]
    branches = []
    if "quoted" in forms:
        branches.append(f"from{_BLANK}+['\"](?:{'|'.join(forms['quoted'])})")
    if "module" in forms:
        branches.append(f"from{_BLANK}+(?:{'|'.join(forms['module'])})")
    if direct:
        branches.append(f"import{_BLANK}+(?:{'|'.join(direct)})")
    if anywhere:
        branches.append(f"import{_BLANK}+.*(?:{'|'.join(anywhere)})")
    if "required" in forms:
        branches.append(f"require\\(['\"](?:{'|'.join(forms['required'])})")
    return _FLAGS + _STARTS + "(?:" + "|".join(branches) + ")"


def import_tags(
    pieces: str, rules: Mapping[str, Mapping] = fv.IMPORT_TAG_RULES
) -> Column:
    """Sorted tags of the import rules that match; empty without pieces."""
    hits = ", ".join(
        f"IF({pieces} RLIKE {text(import_tag_pattern(rules[tag]))}, {text(tag)}, NULL)"
        for tag in sorted(rules)
    )
    return F.expr(
        f"IF({pieces} <> '', array_compact(array({hits})), {text_array([])})"
    )


def primary_tag(tags: str = "tags") -> Column:
    return F.expr(
        f"coalesce(get(array_intersect({text_array(fv.TAG_PRIORITY)}, {tags}), 0),"
        f" get(filter({tags}, t -> t IN ({text_list(fv.TAGS_WITH_ICON)})), 0))"
    )


def _excluded_pattern(
    names: Sequence[str], kept_dot_names: Sequence[str], literal: Callable[[str], str], end: str
) -> str:
    kept = "|".join(literal(n[1:]) for n in kept_dot_names)
    pattern = f"/(?:\\.(?!(?:{kept})(?:/|{end}))"
    if names:
        pattern += f"|(?:{'|'.join(literal(n) for n in names)})(?:/|{end})"
    return pattern + ")"


def excluded(path: str, names: Sequence[str], kept_dot_names: Sequence[str]) -> Column:
    """True when a segment below the root is in `names` or is a dot name not kept."""
    def literal(name: str) -> str:
        return "\\Q" + name.replace("\\E", "\\E\\\\E\\Q") + "\\E"

    return F.expr(f"{path} RLIKE {text(_excluded_pattern(names, kept_dot_names, literal, '\\z'))}")


def excluded_in_tasks(names: Sequence[str], kept_dot_names: Sequence[str]) -> str:
    """The rule of `excluded` as a pattern of Python's own, for tasks that walk a tree."""
    return _excluded_pattern(names, kept_dot_names, re.escape, "\\Z")


def annotatable_path(extra: Sequence[str] = ()) -> Column:
    """Source files that annotation may touch, by `path` alone."""
    names = fv.ANNOTATION_EXCLUDED_DIRS + list(extra)
    # Names are excluded as directories only; dot names also as files.
    above = "regexp_replace(path, '/[^/]*$', '/')"
    return (
        is_one_of(PATH_EXTENSION, fv.ANNOTATABLE_EXTENSIONS)
        & ~excluded("path", [], fv.ANNOTATION_KEPT_DOT_NAMES)
        & ~excluded(above, names, fv.ANNOTATION_KEPT_DOT_NAMES)
    )
