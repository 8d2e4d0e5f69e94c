"""SQL counterpart of each query, for DuckDB.

Written against the definitions, with other means than the Spark side: tables of
rules joined to rows instead of literal expressions, lists of lines instead of
one pattern over a text, prefix joins instead of exploded ancestors.
"""

from ..functions import fixed_values as fv
from ..operators import requests
from . import fixtures
from .queries import BASE_PATH, GENERATED_AT, VERSIONED_CATALOGUES


def _q(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _values(rows) -> str:
    return "(VALUES " + ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in row) + ")" for row in rows
    ) + ")"


def _base(template: str) -> str:
    return fixtures.for_duckdb(template)


# --- building blocks ---------------------------------------------------------

FILES = f"files AS ({_base(fixtures.FILES)})"
COMMITS = f"commits AS ({_base(fixtures.COMMITS)})"
TAGS = f"tags AS ({_base(fixtures.TAGS)})"
RESPONSES = f"responses AS ({_base(fixtures.RESPONSES)})"

# Walks the parents commit by commit, once from each head and once from each tag that it reaches.
GRAPH = f"""graph AS MATERIALIZED ({_base(fixtures.DAG)}),
edges AS MATERIALIZED (SELECT repo, hash, first_parent AS parent FROM graph WHERE first_parent IS NOT NULL
  UNION ALL SELECT repo, hash, second_parent FROM graph WHERE second_parent IS NOT NULL),
heads AS ({_base(fixtures.DAG_HEADS)}), tags AS ({_base(fixtures.DAG_TAGS)}),
reached AS (SELECT repo, hash FROM heads
  UNION SELECT e.repo, e.parent FROM reached r JOIN edges e USING (repo, hash)),
usable AS MATERIALIZED (SELECT t.* FROM tags t JOIN reached USING (repo, hash) WHERE version LIKE 'v%'),
walked AS (SELECT repo, version, hash FROM usable
  UNION SELECT w.repo, w.version, e.parent FROM walked w JOIN edges e USING (repo, hash)),
sizes AS (SELECT repo, version, count(*) AS size FROM walked GROUP BY ALL),
nearest AS (SELECT repo, arg_max(version, (size, version)) AS version FROM sizes GROUP BY repo),
pending AS (SELECT g.* FROM graph g JOIN reached USING (repo, hash)
  WHERE NOT EXISTS (SELECT 1 FROM walked w JOIN nearest n USING (repo, version) WHERE w.repo = g.repo AND w.hash = g.hash))"""

NAMED = f"""{FILES},
named AS (SELECT *, string_split(path, '/')[-1] AS name,
  CASE WHEN regexp_matches(string_split(path, '/')[-1], '^.+\\.[^.]+$')
       THEN lower('.' || string_split(string_split(path, '/')[-1], '.')[-1]) ELSE '' END AS ext
  FROM files)"""


def _excluded(names, kept) -> str:
    return (
        "len(list_filter(string_split(path, '/')[2:], lambda s: "
        f"s IN {_in(names)} OR (s[1] = '.' AND s NOT IN {_in(kept)}))) > 0"
    )


SCANNABLE = (
    f"(ext NOT IN {_in(fv.BINARY_EXTENSIONS)} AND "
    f"(ext IN {_in(fv.SCANNABLE_EXTENSIONS)} OR name IN {_in(fv.FILE_DESCRIPTIONS)}))"
)
SNIPPET = (
    f"CASE WHEN {SCANNABLE} THEN nullif(trim(array_to_string(string_split(substr("
    "replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 1, 4096), "
    "chr(10))[1:40], chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') END"
)
NAME_TAG_ROWS = _values([(i, t, p) for i, (t, p) in enumerate(fv.NAME_TAG_PATTERNS)])
_FORMS = {
    "quoted": "from\\s+['\"]",
    "module": "from\\s+",
    "named": "import\\s+",
    "required": "require\\(['\"]",
}
IMPORT_RULE_ROWS = _values(
    [
        (tag, _FORMS[form] + rest)
        for tag, forms in fv.IMPORT_TAG_RULES.items()
        for form, rests in forms.items()
        for rest in rests
    ]
)

SNIPPETS = f"{NAMED}, snippets AS (SELECT *, {SNIPPET} AS snippet FROM named)"
TAGGED_ALL = f"""{SNIPPETS},
name_tags AS (SELECT doc_id, list(tag ORDER BY rule) AS l FROM snippets
  JOIN {NAME_TAG_ROWS} r(rule, tag, pattern) ON regexp_matches(name, pattern) GROUP BY doc_id),
import_tags AS (SELECT doc_id, list(DISTINCT tag ORDER BY tag) AS l FROM snippets
  JOIN {IMPORT_RULE_ROWS} r(tag, pattern) ON regexp_matches(snippet, pattern, 'i') GROUP BY doc_id),
exact_names AS (SELECT * FROM {_values(fv.FILE_DESCRIPTIONS.items())} e(name, purpose)),
by_pattern AS (SELECT name, min_by(wording || CASE WHEN suffix IS NULL THEN ''
    ELSE regexp_replace(name, suffix, '') END, rule) AS purpose
  FROM (SELECT DISTINCT name FROM snippets) n
  JOIN {_values([(i, *p) for i, p in enumerate(fv.FILE_PATTERNS)])} r(rule, pattern, wording, suffix)
    ON regexp_matches(name, pattern) GROUP BY name),
everything AS (SELECT s.*, coalesce(n.l, []::VARCHAR[]) AS name_tags, coalesce(i.l, []::VARCHAR[]) AS import_tags,
   coalesce(n.l, []::VARCHAR[]) || list_filter(coalesce(i.l, []::VARCHAR[]),
     lambda t: NOT list_contains(coalesce(n.l, []::VARCHAR[]), t)) AS tags,
   coalesce(e.purpose, b.purpose) AS purpose
  FROM snippets s LEFT JOIN name_tags n USING (doc_id) LEFT JOIN import_tags i USING (doc_id)
  LEFT JOIN exact_names e USING (name) LEFT JOIN by_pattern b USING (name))"""
TAGGED = (
    f"{TAGGED_ALL}, tagged AS (SELECT * FROM everything "
    f"WHERE NOT ({_excluded(fv.EXCLUDED_NAMES, fv.KEPT_DOT_NAMES)}))"
)

DIR_WORDING = _values(fv.DIRECTORY_DESCRIPTIONS.items())


def _dirs_of(table: str) -> str:
    """Distinct directories above the paths of a table."""
    return (
        f"(SELECT DISTINCT repo, array_to_string(parts[1:k], '/') AS path, k - 1 AS depth, parts[k] AS name "
        f"FROM (SELECT repo, string_split(path, '/') AS parts FROM {table}) p, "
        "range(1, len(parts)) r(k))"
    )


# One entry per segment, compared one after the other.
WALK = """list_transform(string_split(path, '/'), lambda s, i: {
  'kind': CASE WHEN kind = 'dir' OR i < len(string_split(path, '/')) THEN 2 ELSE 1 END, 'folded': lower(s), 'name': s})"""

SCAN = f"""{TAGGED},
nodes AS (
  SELECT doc_id, repo, path, array_to_string(string_split(path, '/')[:-2], '/') AS parent_path, name, 'file' AS kind,
    len(string_split(path, '/')) - 1 AS depth, purpose AS description, array_to_string(tags, ',') AS tags, snippet
  FROM tagged
  UNION ALL
  SELECT NULL, d.repo, d.path, CASE WHEN d.depth > 0 THEN array_to_string(string_split(d.path, '/')[:-2], '/') END,
    d.name, 'dir', d.depth,
    coalesce(w.description, CASE WHEN d.depth = 0 THEN 'Project root' ELSE 'Directory' END), '', NULL
  FROM {_dirs_of('tagged')} d LEFT JOIN {DIR_WORDING} w(name, description) USING (name))"""

LISTING_FILE_WORDING = _values(fv.LISTING_FILE_DESCRIPTIONS.items())
LISTING_DIR_WORDING = _values(fv.LISTING_DIRECTORY_DESCRIPTIONS.items())
LISTING_PATTERN_ROWS = _values([(i, *p) for i, p in enumerate(fv.LISTING_FILE_PATTERNS)])


def _described_listing(placed: str) -> str:
    """nodes from placed(repo, path, kind), with the wording of imported listings."""
    return f"""
shaped AS (SELECT repo, path, kind, string_split(path, '/')[-1] AS name,
  len(string_split(path, '/')) - 1 AS depth,
  CASE WHEN contains(path, '/') THEN array_to_string(string_split(path, '/')[:-2], '/') END AS parent_path
  FROM {placed}),
worded AS (SELECT n.name, coalesce(min(e.purpose), min_by(p.wording || CASE WHEN p.suffix IS NULL THEN ''
    ELSE regexp_replace(n.name, p.suffix, '') END, p.rule)) AS purpose
  FROM (SELECT DISTINCT name FROM shaped WHERE kind = 'file') n
  LEFT JOIN {LISTING_FILE_WORDING} e(name, purpose) ON e.name = n.name
  LEFT JOIN {LISTING_PATTERN_ROWS} p(rule, pattern, wording, suffix) ON regexp_matches(n.name, p.pattern)
  GROUP BY n.name),
marked AS (SELECT n.name, list(t.tag ORDER BY t.rule) AS tags
  FROM (SELECT DISTINCT name FROM shaped WHERE kind = 'file') n
  JOIN {NAME_TAG_ROWS} t(rule, tag, pattern) ON regexp_matches(n.name, t.pattern) GROUP BY n.name),
nodes AS (SELECT repo, path, parent_path, name, kind, depth,
  CASE WHEN kind = 'file' THEN w.purpose ELSE coalesce(d.description,
    CASE WHEN depth = 0 THEN 'Project root' ELSE 'Directory' END) END AS description,
  CASE WHEN kind = 'file' THEN coalesce(array_to_string(m.tags, ','), '') ELSE '' END AS tags
  FROM shaped LEFT JOIN worded w USING (name) LEFT JOIN marked m USING (name)
  LEFT JOIN {LISTING_DIR_WORDING} d(name, description) USING (name))"""


PATH_NODES = f"""
listed AS (SELECT page_id, CASE WHEN starts_with(trim(path), './') THEN substr(trim(path), 3) ELSE trim(path) END AS path
  FROM ({_base(fixtures.PATHS)}) p),
kept AS (SELECT * FROM listed WHERE path <> '' AND path[1] <> '#'),
root AS (SELECT coalesce(nullif(string_split(min_by(path, page_id), '/')[1], ''), 'project') AS root FROM kept),
split_up AS (SELECT regexp_matches(string_split(path, '/')[-1], '\\.\\w{{1,10}}$') AS is_file,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM kept),
rooted AS (SELECT root AS repo, is_file, CASE WHEN parts[1] = root THEN parts ELSE [root] || parts END AS parts
  FROM split_up, root),
placed AS (SELECT DISTINCT repo, array_to_string(parts[1:k], '/') AS path,
  CASE WHEN is_file AND k = len(parts) AND k > 1 THEN 'file' ELSE 'dir' END AS kind
  FROM rooted, range(1, len(parts) + 1) r(k)),
{_described_listing('placed')}"""

LIST_NODES = f"""
listed AS (SELECT list_id, page_id, CASE WHEN starts_with(trim(path), './') THEN substr(trim(path), 3) ELSE trim(path) END AS path
  FROM ({_base(fixtures.PATH_LISTS)}) p),
kept AS (SELECT * FROM listed WHERE path <> '' AND path[1] <> '#'),
roots AS (SELECT list_id, coalesce(nullif(string_split(min_by(path, page_id), '/')[1], ''), 'project') AS root FROM kept GROUP BY 1),
split_up AS (SELECT list_id, regexp_matches(string_split(path, '/')[-1], '\\.\\w{{1,10}}$') AS is_file,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS parts FROM kept),
rooted AS (SELECT cast(list_id AS VARCHAR) AS repo, is_file, CASE WHEN parts[1] = root THEN parts ELSE [root] || parts END AS parts
  FROM split_up JOIN roots USING (list_id)),
placed AS (SELECT DISTINCT repo, array_to_string(parts[1:k], '/') AS path,
  CASE WHEN is_file AND k = len(parts) AND k > 1 THEN 'file' ELSE 'dir' END AS kind
  FROM rooted, range(1, len(parts) + 1) r(k)),
{_described_listing('placed')}"""

NODE_COLUMNS = "repo, path, parent_path, name, kind, depth, description, tags"

MARK = fv.MARKER
LINE = f"[ \\t]*(?://|#|--|/\\*|<!--)\\s*{MARK}\\s*\\[\\w[\\w-]*\\].*"
LINES_OF = "string_split(content, chr(10))"


def _is_mark(line: str, mode: str | None = None) -> str:
    pattern = LINE if mode is None else LINE.replace("\\w[\\w-]*", mode)
    return f"regexp_full_match({line}, {_q(pattern)})"


HAS_MARKS = (
    f"(regexp_matches(content, '{MARK}\\s*\\[(?:tutor|minimal|technical|non-technical)\\]') AND "
    f"len(list_filter({LINES_OF}, lambda l: {_is_mark('l')})) > 0)"
)


def _stripped(mode: str | None = None) -> str:
    return (
        f"coalesce(array_to_string(list_filter({LINES_OF}, lambda l: NOT {_is_mark('l', mode)}), "
        "chr(10)), '')"
    )


def _counted(mode: str | None = None) -> str:
    return f"len(list_filter({LINES_OF}, lambda l: {_is_mark('l', mode)}))"


SUBJECT = "^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$"
PARSED = f"""{COMMITS},
parsed AS (SELECT *, lower(regexp_extract(subject, '{SUBJECT}', 1)) AS type,
  nullif(regexp_extract(subject, '{SUBJECT}', 2), '') AS scope,
  regexp_extract(subject, '{SUBJECT}', 3) = '!' AS breaking,
  trim(regexp_extract(subject, '{SUBJECT}', 4)) AS description
  FROM commits WHERE regexp_matches(subject, '{SUBJECT}'))"""
LATEST = f"""{TAGS}, latest AS (SELECT repo, arg_max(version, (ts, version)) AS version, max(ts) AS tag_ts
  FROM tags WHERE starts_with(version, 'v') GROUP BY repo)"""
BUMPS = f"""CASE max(CASE WHEN breaking OR contains(body, 'BREAKING CHANGE') OR contains(body, 'BREAKING-CHANGE') THEN 3
  WHEN type = 'feat' THEN 2 WHEN type IN {_in(fv.PATCH_TYPES)} THEN 1 END)
  WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'patch' END"""

CLEAN = "trim(replace(replace(body, '```json', ''), '```', ''), ' ' || chr(9) || chr(10) || chr(13))"
ENTRIES = f"""{RESPONSES},
good AS (SELECT *, CASE WHEN json_valid({CLEAN}) AND json_type(CASE WHEN json_valid({CLEAN}) THEN {CLEAN} END) = 'OBJECT'
  THEN {CLEAN} END AS doc FROM responses),
entries AS (SELECT batch_id, turn, e.key AS path, arg_max(json_extract_string(e.value, '$'), e.id) AS description
  FROM good, json_each(doc) e WHERE doc IS NOT NULL GROUP BY ALL)"""
MERGED = f"""{ENTRIES},
merged AS (SELECT cast(cast(path AS BIGINT) // 16 AS VARCHAR) AS path,
  arg_max(description, (batch_id, turn)) AS description FROM entries GROUP BY 1)"""

BATCHES = f"""{SCAN},
numbered AS (SELECT repo, doc_id, path, snippet,
  row_number() OVER (PARTITION BY repo ORDER BY {WALK}, doc_id NULLS FIRST) AS position,
  bool_or(snippet IS NOT NULL) OVER (PARTITION BY repo) AS any_snippet FROM nodes),
batches AS (SELECT repo, doc_id, path, snippet, position,
  cast(floor((position - 1) / CASE WHEN any_snippet THEN 20 ELSE 30 END) AS BIGINT) AS batch_id FROM numbered)"""
READMES = """
readmes AS (SELECT f.repo, coalesce(any_value(b.readme), '') AS readme
  FROM (SELECT DISTINCT repo FROM files) f LEFT JOIN (
    SELECT repo, arg_min(substr(content, 1, 3000), (CASE string_split(path, '/')[2]
      WHEN 'README.md' THEN 1 WHEN 'readme.md' THEN 2 ELSE 3 END, doc_id)) AS readme
    FROM files WHERE len(string_split(path, '/')) = 2
      AND string_split(path, '/')[2] IN ('README.md', 'readme.md', 'Readme.md') GROUP BY repo) b USING (repo)
  GROUP BY f.repo)"""

HAYSTACK = "lower(concat_ws(' ', name, coalesce(description, ''), replace(tags, ',', ' '), path))"
SECTION_ROWS = _values(fv.CHANGELOG_SECTIONS.items())
ORDER_ROWS = _values([(s, i + 1) for i, s in enumerate(fv.CHANGELOG_ORDER)])
LANGUAGE_ROWS = _values(fv.LANGUAGES.items())
LANGUAGE = "coalesce(l.language, nullif(ltrim(ext, '.'), ''), 'text')"
ANNOTATABLE_PATH = (
    f"ext IN {_in(fv.ANNOTATABLE_EXTENSIONS)} AND len(list_filter(string_split(path, '/')[2:], lambda s: s[1] = '.' AND s <> '.env.example')) = 0 "
    f"AND len(list_filter(string_split(path, '/')[2:-2], lambda s: s IN {_in(fv.ANNOTATION_EXCLUDED_DIRS)})) = 0"
)
ANNOTATABLE = f"{ANNOTATABLE_PATH} AND strlen(content) > 10 AND strlen(content) < 100000"


def _annotation_prompt(mode: str) -> str:
    before, after = requests.ANNOTATE_ROLES[mode].split("{language}")
    rest = (
        f"{after}\n\n{requests.ANNOTATE_RULES}\n"
        f"- Begin every comment with \"{MARK} [{mode}]\" right after the comment syntax, "
        f"for example // {MARK} [{mode}] text or # {MARK} [{mode}] text.\n\n"
        f"Style: {requests.ANNOTATE_STYLES[mode]}\n\nFile: "
    )
    code = f"CASE WHEN {HAS_MARKS} THEN {_stripped()} ELSE content END"
    return f"{_q(before)} || {LANGUAGE} || {_q(rest)} || name || chr(10) || chr(10) || {code}"


def _marks_query(files: str = FILES) -> str:
    part = f"^([ \\t]*)(//|#|--|/\\*|<!--)\\s*{MARK}\\s*\\[(\\w[\\w-]*)\\]\\s*(.*?)(?:\\s*\\*/|\\s*-->)?\\s*$"
    return f"""WITH {files}, numbered AS (
  SELECT doc_id, k AS line_no, {LINES_OF}[k] AS line FROM files, range(1, len({LINES_OF}) + 1) r(k))
SELECT doc_id, line_no, regexp_extract(line, '{part}', 1) AS indent, regexp_extract(line, '{part}', 2) AS syntax,
  regexp_extract(line, '{part}', 3) AS mode, regexp_extract(line, '{part}', 4) AS body
FROM numbered WHERE regexp_matches(line, '{part}')"""


def _search_rows(terms: list[str]) -> str:
    score = " + ".join(f"CASE WHEN contains(hay, {_q(t)}) THEN 1 ELSE 0 END" for t in terms)
    return f"SELECT repo, path, type, {score} AS score FROM hays"


HAYS = f"""{SCAN}, hays AS (SELECT repo, path, CASE kind WHEN 'dir' THEN 'folder' ELSE 'file' END AS type,
  {HAYSTACK} AS hay FROM nodes WHERE depth > 0)"""
ASKED = [(i, q.lower().split()) for i, q in fixtures.QUERY_TEXTS]

NEWEST = f"""WITH versions AS ({_base(VERSIONED_CATALOGUES)})
SELECT repo, max(version) AS version, arg_max(body, version) AS body FROM versions
WHERE json_valid(body) AND json_extract(CASE WHEN json_valid(body) THEN body END, '$.tree') IS NOT NULL GROUP BY repo"""

# --- one statement per query -------------------------------------------------

ORACLE_SQL: dict[str, str] = {
    "s1_scan_corpus": f"WITH {SCAN} SELECT snippet, {NODE_COLUMNS} FROM nodes",
    "s1_scan_tree": f"""WITH {NAMED}, kept AS (SELECT * FROM named
  WHERE NOT ({_excluded(fv.EXCLUDED_NAMES, fv.KEPT_DOT_NAMES)}))
SELECT 'corpus/' || array_to_string(string_split(path, '/')[:-2], '/') || '/n' || doc_id || ' [é#%41]/' || name AS path,
  strlen(content) AS size,
  CASE WHEN {SCANNABLE} OR name IN {_in(fv.README_NAMES)} OR ext IN {_in(fv.ANNOTATABLE_EXTENSIONS)}
    THEN md5(content) END AS content_md5 FROM kept""",
    "s1_scan_headers": f"WITH {TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags, purpose, snippet FROM tagged",
    "s2_import_path_list": f"WITH {PATH_NODES} SELECT {NODE_COLUMNS} FROM nodes",
    "s2_import_path_lists": f"WITH {LIST_NODES} SELECT {NODE_COLUMNS} FROM nodes",
    "f4_prune_lists": f"""WITH {LIST_NODES} SELECT repo, path, kind FROM nodes n
WHERE kind = 'file' OR depth = 0 OR EXISTS (SELECT 1 FROM nodes f WHERE f.repo = n.repo AND f.kind = 'file'
  AND starts_with(f.path, n.path || '/'))""",
    "p10_ancestors_of_lists": f"""WITH {LIST_NODES} SELECT repo, path, kind, k - 1 AS level,
  array_to_string(string_split(path, '/')[1:k], '/') AS ancestor
FROM nodes, range(1, len(string_split(path, '/')) + 1) r(k)""",
    "t_trees_of_lists": f"""WITH {LIST_NODES}, units AS (
  SELECT repo, path FROM nodes WHERE kind = 'file' UNION ALL
  SELECT repo, path || '/' FROM nodes d WHERE kind = 'dir'
    AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.repo = d.repo AND c.parent_path = d.path)),
valued AS (SELECT *, CASE WHEN kind = 'file' THEN 1 ELSE
    (SELECT count(*) FROM units u WHERE u.repo = n.repo AND starts_with(u.path, n.path || '/')) END AS value FROM nodes n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {WALK}) AS walk_rank,
  value / sum(value) OVER (PARTITION BY repo, parent_path) AS share,
  row_number() OVER (PARTITION BY repo, parent_path ORDER BY kind = 'file', lower(name), name) AS place FROM valued),
lists AS (SELECT repo, parent_path AS path,
  coalesce(list(name ORDER BY lower(name), name) FILTER (WHERE kind = 'dir'), []::VARCHAR[]) AS d,
  coalesce(list(name ORDER BY lower(name), name) FILTER (WHERE kind = 'file'), []::VARCHAR[]) AS f
  FROM nodes WHERE depth > 0 GROUP BY repo, parent_path)
SELECT n.repo, n.path, n.kind, walk_rank,
  CASE WHEN kind = 'dir' THEN (SELECT count(*) FROM nodes x WHERE x.repo = n.repo AND x.kind = 'file' AND starts_with(x.path, n.path || '/')) END AS files,
  CASE WHEN kind = 'dir' THEN (SELECT count(*) FROM nodes x WHERE x.repo = n.repo AND x.kind = 'dir' AND starts_with(x.path, n.path || '/')) END AS dirs,
  CASE WHEN kind = 'dir' THEN value END AS weight, CASE WHEN depth > 0 THEN round(share, 9) END AS area,
  CASE WHEN depth > 0 THEN place END AS listing_rank,
  array_to_string(d[1:6], ',') AS first_dirs, array_to_string(f[1:5], ',') AS first_files
FROM ranked n LEFT JOIN lists l ON l.repo = n.repo AND l.path = n.path""",
    "s3_import_tree_listing": f"""WITH RECURSIVE source AS ({_base(fixtures.LISTINGS)}),
rows AS (SELECT listing_id, k, string_split(text, chr(10))[k] AS line
  FROM source, range(1, len(string_split(text, chr(10))) + 1) r(k)),
items AS (SELECT listing_id, k, regexp_extract(line, '^(.*?)[├└]\\s*─+\\s*(.+)$', 1) AS prefix,
    trim(regexp_extract(line, '^(.*?)[├└]\\s*─+\\s*(.+)$', 2)) AS label
  FROM rows WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^\\d+ director')
    AND regexp_matches(line, '^(.*?)[├└]\\s*─+\\s*(.+)$')),
deep AS (SELECT listing_id, k, label, regexp_replace(label, '/$', '') AS name,
  CASE WHEN round(length(regexp_replace(prefix, '[^\\s│]', '', 'g')) / 3.0) > 0
    THEN round(length(regexp_replace(prefix, '[^\\s│]', '', 'g')) / 3.0)
    ELSE floor(length(prefix) / 4.0 + 0.5) END AS lvl FROM items),
kinds AS (SELECT *, ends_with(label, '/') OR coalesce(lead(lvl) OVER (PARTITION BY listing_id ORDER BY k) > lvl, false)
  AS is_dir FROM deep),
parents AS (SELECT c.listing_id, c.k, c.name, c.is_dir,
  (SELECT max(p.k) FROM kinds p WHERE p.listing_id = c.listing_id AND p.k < c.k AND p.lvl < c.lvl) AS parent_k
  FROM kinds c),
chains AS (
  SELECT listing_id, k, is_dir, name AS path, parent_k FROM parents
  UNION ALL
  SELECT c.listing_id, c.k, c.is_dir, p.name || '/' || c.path, p.parent_k
  FROM chains c JOIN parents p ON p.listing_id = c.listing_id AND p.k = c.parent_k),
placed AS (SELECT cast(listing_id AS VARCHAR) AS repo, 'site/' || path AS path,
    CASE WHEN is_dir THEN 'dir' ELSE 'file' END AS kind
  FROM chains WHERE parent_k IS NULL
  UNION ALL SELECT cast(listing_id AS VARCHAR), 'site', 'dir' FROM source),
{_described_listing('placed')} SELECT {NODE_COLUMNS} FROM nodes""",
    "s4_import_catalogue": f"""WITH RECURSIVE dirs AS (
  SELECT cast(repo_id AS VARCHAR) AS repo, cast(NULL AS VARCHAR) AS up, json_extract(body, '$.tree') AS node
  FROM ({_base(fixtures.CATALOGUES)}) c
  UNION ALL
  SELECT repo, concat_ws('/', up, json_extract_string(node, '$.name')),
    unnest(cast(json_extract(node, '$.children') AS JSON[])) FROM dirs),
every AS (
  SELECT *, 'dir' AS kind FROM dirs
  UNION ALL
  SELECT repo, concat_ws('/', up, json_extract_string(node, '$.name')),
    unnest(cast(json_extract(node, '$.files') AS JSON[])), 'file' FROM dirs)
SELECT repo, concat_ws('/', up, json_extract_string(node, '$.name')) AS path, up AS parent_path,
  json_extract_string(node, '$.name') AS name, kind,
  CASE WHEN up IS NULL THEN 0 ELSE len(string_split(up, '/')) END AS depth,
  nullif(coalesce(json_extract_string(node, '$.description'), json_extract_string(node, '$.purpose')), '—') AS description,
  coalesce(array_to_string(cast(json_extract(node, '$.tags') AS VARCHAR[]), ','), '') AS tags FROM every""",
    "s4_import_manifest": f"""SELECT cast(repo_id AS VARCHAR) AS repo,
  json_extract_string(body, '$.basePath') AS base_path, json_extract_string(body, '$.readme') AS readme,
  json_extract_string(body, '$.generatedAt') AS generated_at, json_extract_string(body, '$.model') AS model,
  cast(json_extract_string(body, '$.hasSnippets') AS BOOLEAN) AS has_snippets
FROM ({_base(fixtures.CATALOGUES)}) c WHERE json_valid(body)""",
    "s4_import_snippets": f"""SELECT cast(repo_id AS VARCHAR) AS repo, 'site/a.md' AS path,
  json_extract_string(body, '$.snippets."site/a.md"') AS snippet
FROM ({_base(fixtures.CATALOGUES)}) c WHERE json_extract(body, '$.snippets') IS NOT NULL""",
    "s5_export_catalogue": f"""WITH {TAGGED}, {READMES}
SELECT t.repo, '{BASE_PATH}' || t.repo AS base_path, substr(any_value(r.readme), 1, 1500) AS readme,
  '{GENERATED_AT}' AS generated_at, 'heuristics-only' AS model, bool_or(snippet IS NOT NULL) AS has_snippets
FROM tagged t JOIN readmes r USING (repo) GROUP BY t.repo""",
    "s5_export_tree": f"""WITH {SCAN} SELECT repo, path, parent_path, name, kind, depth,
  CASE WHEN kind = 'file' THEN coalesce(description, '—') ELSE description END AS description, tags,
  CASE WHEN kind = 'dir' OR description IS NOT NULL THEN 'heuristic' END AS description_source FROM nodes""",
    "s5_export_snippets": f"WITH {SCAN} SELECT repo, path, snippet FROM nodes WHERE snippet IS NOT NULL",
    "s5_export_documents": f"""WITH {SCAN} SELECT {NODE_COLUMNS},
  CASE WHEN kind = 'file' THEN max(snippet) OVER (PARTITION BY repo, path, kind) END AS snippet FROM nodes""",
    "s6_readme_context": f"WITH {FILES}, {READMES} SELECT repo, readme FROM readmes",
    "s7_write_rewritten": f"""WITH {NAMED} SELECT repo, path, array_to_string(string_split(path, '/')[:-2], '/') || '/' ||
  array_to_string(string_split(name, '.')[:-2], '.') || '.annotated.' || string_split(name, '.')[-1] AS target,
  md5(content) AS content_md5 FROM named""",
    "s7_rewrite_tree": f"""WITH {NAMED}, placed AS (SELECT *,
  array_to_string(string_split(path, '/')[:-2], '/') || '/n' || doc_id || '/' AS up FROM named
  WHERE NOT contains(path, '/.')),
out AS (SELECT up || name AS path, content FROM placed UNION ALL
  SELECT up || array_to_string(string_split(name, '.')[:-2], '.') || '.annotated.' || string_split(name, '.')[-1],
    {_stripped()} FROM placed WHERE {ANNOTATABLE})
SELECT path, strlen(content) AS size, md5(content) AS content_md5 FROM out""",
    "f1_exclude_paths": f"WITH {FILES} SELECT doc_id, path FROM files WHERE NOT "
    f"({_excluded([*fv.EXCLUDED_NAMES, 'tests', 'd7'], fv.KEPT_DOT_NAMES)})",
    "f2_scannable": f"WITH {NAMED} SELECT doc_id, path FROM named WHERE {SCANNABLE}",
    "f3_annotatable": f"WITH {NAMED} SELECT doc_id, path FROM named WHERE {ANNOTATABLE}",
    "f4_prune_empty_dirs": f"""WITH {PATH_NODES} SELECT path, kind FROM nodes n
WHERE kind = 'file' OR depth = 0 OR EXISTS (
  SELECT 1 FROM nodes f WHERE f.kind = 'file' AND starts_with(f.path, n.path || '/'))""",
    "f5_files_with_tag": f"WITH {TAGGED} SELECT repo, name, purpose, path FROM tagged WHERE list_contains(tags, 'api')",
    "f6_has_marks": f"WITH {FILES} SELECT doc_id FROM files WHERE {HAS_MARKS}",
    "p1_describe_files": f"WITH {TAGGED_ALL} SELECT doc_id, name, purpose FROM everything",
    "p2_describe_dirs": f"""WITH {FILES} SELECT d.path, coalesce(w.description,
  CASE WHEN d.depth = 0 THEN 'Project root' ELSE 'Directory' END) AS description
FROM {_dirs_of('files')} d LEFT JOIN {DIR_WORDING} w(name, description) USING (name)""",
    "p3_name_tags": f"WITH {TAGGED_ALL} SELECT doc_id, array_to_string(name_tags, ',') AS name_tags FROM everything",
    "p4_import_tags": f"WITH {TAGGED_ALL} SELECT doc_id, array_to_string(import_tags, ',') AS import_tags FROM everything",
    "p5_merge_tags": f"WITH {TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags FROM tagged",
    "p6_header_snippet": f"WITH {SNIPPETS} SELECT doc_id, snippet FROM snippets",
    "p7_language_of": f"""WITH {NAMED} SELECT doc_id, {LANGUAGE} AS language FROM named
LEFT JOIN {LANGUAGE_ROWS} l(ext, language) USING (ext)""",
    "p8_snippet_preview": f"""WITH {TAGGED} SELECT doc_id,
  array_to_string(string_split(snippet, chr(10))[1:6], chr(10)) AS preview FROM tagged""",
    "p9_absolute_path": f"""WITH {FILES} SELECT doc_id,
  '{BASE_PATH}' || array_to_string(string_split(path, '/')[2:], '/') AS absolute_path,
  'vscode://file/{BASE_PATH}' || array_to_string(string_split(path, '/')[2:], '/') AS uri FROM files""",
    "p10_ancestors": f"""WITH {PATH_NODES} SELECT path, kind, k - 1 AS level,
  array_to_string(string_split(path, '/')[1:k], '/') AS ancestor
FROM nodes, range(1, len(string_split(path, '/')) + 1) r(k)""",
    "p11_primary_tag": f"""WITH {TAGGED} SELECT doc_id,
  coalesce(list_filter({_list(fv.TAG_PRIORITY)}, lambda p: list_contains(tags, p))[1],
    list_filter(tags, lambda t: t IN {_in(fv.TAGS_WITH_ICON)})[1]) AS primary_tag FROM tagged""",
    "t1_all_paths": f"WITH {PATH_NODES} SELECT path, kind FROM nodes",
    "t1_walk": f"""WITH {PATH_NODES} SELECT path, kind,
  row_number() OVER (PARTITION BY repo ORDER BY {WALK}) AS walk_rank FROM nodes""",
    "t2_flatten_items": f"""WITH {PATH_NODES} SELECT name, description, tags, path, parent_path,
  CASE WHEN kind = 'dir' THEN 'folder' ELSE 'file' END AS type FROM nodes WHERE depth > 0""",
    "t3_node_at": f"""WITH {SCAN} SELECT path, name, description FROM nodes
WHERE path = 'src3/src/components' AND kind = 'dir'""",
    "t4_subtree_counts": f"""WITH {PATH_NODES} SELECT d.path,
  count(*) FILTER (WHERE n.kind = 'file') AS files, count(*) FILTER (WHERE n.kind = 'dir') AS dirs
FROM nodes d LEFT JOIN nodes n ON starts_with(n.path, d.path || '/') WHERE d.kind = 'dir' GROUP BY d.path""",
    "t5_subtree_weight": f"""WITH {PATH_NODES}, units AS (
  SELECT path FROM nodes WHERE kind = 'file' UNION ALL
  SELECT path || '/' FROM nodes d WHERE kind = 'dir'
    AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_path = d.path))
SELECT d.path, count(*) AS weight FROM nodes d JOIN units u ON starts_with(u.path, d.path || '/')
WHERE d.kind = 'dir' GROUP BY d.path""",
    "t6_area_share": f"""WITH {PATH_NODES}, units AS (
  SELECT path FROM nodes WHERE kind = 'file' UNION ALL
  SELECT path || '/' FROM nodes d WHERE kind = 'dir'
    AND NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent_path = d.path)),
valued AS (SELECT n.parent_path, n.path, n.kind, CASE WHEN n.kind = 'file' THEN 1 ELSE
    (SELECT count(*) FROM units u WHERE starts_with(u.path, n.path || '/')) END AS value
  FROM nodes n WHERE n.depth > 0)
SELECT parent_path, path, kind, value, round(value / sum(value) OVER (PARTITION BY parent_path), 9) AS area FROM valued""",
    "t7_directory_listing": f"""WITH {PATH_NODES} SELECT path, kind, row_number() OVER (PARTITION BY parent_path
  ORDER BY kind = 'file', lower(name), name) AS listing_rank FROM nodes WHERE depth > 0""",
    "t8_child_preview": f"""WITH {PATH_NODES}, l AS (SELECT parent_path AS path,
  coalesce(list(name ORDER BY lower(name), name) FILTER (WHERE kind = 'dir'), []::VARCHAR[]) AS d,
  coalesce(list(name ORDER BY lower(name), name) FILTER (WHERE kind = 'file'), []::VARCHAR[]) AS f
  FROM nodes WHERE depth > 0 GROUP BY parent_path)
SELECT path, array_to_string(d[1:6], ',') AS first_dirs, array_to_string(f[1:5], ',') AS first_files FROM l""",
    "t8_tag_preview": f"WITH {TAGGED} SELECT doc_id, array_to_string(tags[1:3], ',') AS first_tags FROM tagged",
    "a1_distinct_tags": f"WITH {TAGGED} SELECT DISTINCT unnest(tags) AS tag FROM tagged",
    "a2_tag_counts": f"""WITH {TAGGED} SELECT tag, count(*) AS files
FROM (SELECT unnest(tags) AS tag FROM tagged) t GROUP BY tag""",
    "a3_inferred_tag_count": f"""WITH {TAGGED} SELECT repo, cast(sum(len(list_filter(tags,
  lambda t: t NOT IN {_in([t for t, _ in fv.NAME_TAG_PATTERNS])}))) AS BIGINT) AS inferred_tags FROM tagged GROUP BY repo""",
    "a4_scan_summary": f"""WITH {SCAN},
inferred AS (SELECT repo, sum(len(list_filter(tags,
  lambda t: t NOT IN {_in([t for t, _ in fv.NAME_TAG_PATTERNS])}))) AS n FROM tagged GROUP BY repo)
SELECT repo, count(*) AS items, count(snippet) AS files_with_snippet,
  cast(coalesce(any_value(i.n), 0) AS BIGINT) AS inferred_tags
FROM nodes LEFT JOIN inferred i USING (repo) GROUP BY repo""",
    "q1_search": f"""WITH {HAYS}, scored AS ({_search_rows(['widget', 'react'])})
SELECT path, type, score FROM scored WHERE score > 0 ORDER BY score DESC, path, repo LIMIT 15""",
    "q2_search_many": f"WITH {HAYS}, scored AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS query_id, * FROM ({_search_rows(terms)}) s{i}" for i, terms in ASKED if terms
    )
    + """), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, repo) AS rank
  FROM scored WHERE score > 0)
SELECT query_id, rank, path, type, score FROM placed WHERE rank <= 15""",
    "q2_search_index": f"WITH {HAYS}, scored AS ("
    + " UNION ALL ".join(
        f"SELECT 'fixed' AS set, {i} AS query_id, * FROM ({_search_rows(terms)}) s{i}" for i, terms in ASKED if terms
    )
    + f""" UNION ALL SELECT 'pages', page_id, repo, h.path, type, cast(contains(hay, lower('d' || page_id % 40)) AS INT)
    + cast(contains(hay, 'py') AS INT) + CASE WHEN last <> '' THEN cast(contains(hay, lower(last)) AS INT) ELSE 0 END
  FROM hays h, (SELECT page_id, string_split(path, '/')[-1] AS last FROM ({_base(fixtures.PATHS)}) u) p),
placed AS (SELECT *, row_number() OVER (PARTITION BY set, query_id ORDER BY score DESC, path, repo) AS rank
  FROM scored WHERE score > 0)
SELECT set, query_id, rank, path, type, score FROM placed WHERE rank <= CASE set WHEN 'fixed' THEN 15 ELSE 5 END""",
    "l1_batch_paths": f"WITH {BATCHES} SELECT repo, doc_id, path, position, batch_id FROM batches",
    "l2_build_requests": f"""WITH {BATCHES}, {READMES}
SELECT b.repo, b.batch_id, count(*) AS paths, {_q(requests.DESCRIBE_STYLES['plain'])}
  || CASE WHEN any_value(r.readme) <> '' THEN ' Project context: ' || substr(any_value(r.readme), 1, 1500) ELSE '' END
  || {_q(chr(10) * 2 + 'Paths:' + chr(10))}
  || string_agg(path || CASE WHEN snippet IS NULL THEN '' ELSE chr(10) || array_to_string(list_transform(
       string_split(snippet, chr(10))[1:6], lambda l: '  | ' || l), chr(10)) END, chr(10) ORDER BY position)
  || {_q(chr(10) * 2 + requests.ANSWER_FORMAT + chr(10) + 'Example: ' + requests.DESCRIBE_EXAMPLES['plain'])} AS prompt
FROM batches b JOIN readmes r USING (repo) GROUP BY b.repo, b.batch_id""",
    "l3_parse_responses": f"WITH {ENTRIES} SELECT batch_id, turn, path, description FROM entries",
    "l4_merge_descriptions": f"WITH {MERGED} SELECT path, description FROM merged",
    "l5_apply_descriptions": f"""WITH {SCAN}, {MERGED},
keyed AS (SELECT CASE WHEN cast(path AS BIGINT) % 7 = 0
    THEN 'src' || (cast(path AS BIGINT) % 20) || '/src/d' || (cast(path AS BIGINT) % 40) ELSE '#' || path END AS key,
  arg_max(description, cast(path AS BIGINT)) AS description FROM merged GROUP BY 1),
usable AS (SELECT * FROM keyed WHERE description <> '')
SELECT t.doc_id, t.path, coalesce(u.description, t.description) AS description,
  CASE WHEN u.description IS NOT NULL THEN 'model' WHEN t.description IS NOT NULL THEN 'heuristic' END AS description_source,
  u.description IS NOT NULL AS applied
FROM nodes t LEFT JOIN usable u ON u.key = CASE WHEN t.kind = 'dir' THEN t.path ELSE '#' || t.doc_id END""",
    "l6_batch_outcomes": f"""WITH {ENTRIES} SELECT batch_id, turn,
  CASE WHEN doc IS NULL THEN 'failed' ELSE 'parsed' END AS status,
  coalesce(len(list_distinct(json_keys(doc))), 0) AS descriptions FROM good""",
    "l6_batches_with_code": f"""WITH {BATCHES} SELECT repo, batch_id, count(*) AS paths,
  count(snippet) AS paths_with_code FROM batches GROUP BY repo, batch_id""",
    "m1_extract_marks": _marks_query(),
    "m2_detect_modes": f"""WITH {FILES}, found AS (SELECT doc_id,
  regexp_extract_all(content, '{MARK}\\s*\\[(tutor|minimal|technical|non-technical)\\]', 1) AS m FROM files)
SELECT doc_id, coalesce(array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ','), '') AS modes FROM found""",
    "m3_count_marks": f"WITH {FILES} SELECT doc_id, {_counted()} AS marks, {_counted('tutor')} AS tutor_marks FROM files",
    "m4_strip_marks": f"WITH {FILES} SELECT doc_id, {_stripped()} AS stripped, {_counted()} AS removed FROM files",
    "m5_strip_marks_by_mode": f"""WITH {FILES} SELECT doc_id, {_stripped('non-technical')} AS stripped,
  {_counted('non-technical')} AS removed FROM files""",
    "m6_apply_strategy": f"""WITH {FILES} SELECT doc_id,
  CASE WHEN {HAS_MARKS} THEN {_stripped()} ELSE content END AS content FROM files""",
    "m7_annotation_requests": f"""WITH {NAMED} SELECT doc_id, {LANGUAGE} AS language,
  {_annotation_prompt('minimal')} AS prompt
FROM named LEFT JOIN {LANGUAGE_ROWS} l(ext, language) USING (ext) WHERE {ANNOTATABLE}""",
    "m8_clean_responses": f"""WITH {RESPONSES} SELECT batch_id, turn,
  regexp_replace(regexp_replace(body, '^```\\w*\\n?', ''), '\\n?```\\s*$', '') AS body FROM responses""",
    "m9_erase_report": f"""WITH {NAMED} SELECT repo, count(*) AS files_cleaned,
  cast(sum({_counted()}) AS BIGINT) AS marks_removed FROM named
WHERE {ANNOTATABLE_PATH} AND {HAS_MARKS} GROUP BY repo""",
    "m10_run_summary": f"""WITH {ENTRIES} SELECT CASE WHEN doc IS NULL THEN 'failed' ELSE 'succeeded' END AS status,
  count(*) AS files FROM good GROUP BY 1""",
    "m10_failures": f"""WITH {ENTRIES} SELECT 'conversation' || batch_id AS repo, 'turn' || turn AS path,
  'unparsable response' AS reason FROM good WHERE doc IS NULL""",
    "c1_parse_commits": f"WITH {PARSED} SELECT repo, event_id, type, scope, breaking, description FROM parsed",
    "c2_commits_since_release": f"""WITH {COMMITS}, {LATEST} SELECT c.repo, event_id, hash FROM commits c
LEFT JOIN latest l USING (repo) WHERE l.tag_ts IS NULL OR c.ts > l.tag_ts""",
    "c2_last_commits": f"""WITH {COMMITS} SELECT repo, event_id, hash FROM commits
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash DESC) <= 5""",
    "c2_commits_since_tag": f"""WITH RECURSIVE {GRAPH}
SELECT repo, event_id, hash FROM pending""",
    "c5_next_version_by_tag": f"""WITH RECURSIVE {GRAPH},
parsed AS (SELECT *, regexp_extract(subject, '^(\\w+)(?:\\(([^)]*)\\))?(!)?\\s*:\\s*(.+)$', ['type', 'scope', 'bang', 'text']) AS f
  FROM pending),
levels AS (SELECT repo, max(CASE WHEN f.type = '' THEN NULL WHEN f.bang = '!' OR contains(body, 'BREAKING CHANGE')
   OR contains(body, 'BREAKING-CHANGE') THEN 3 WHEN lower(f.type) IN {_in(fv.MINOR_TYPES)} THEN 2
   WHEN lower(f.type) IN {_in(fv.PATCH_TYPES)} THEN 1 END) AS level FROM parsed GROUP BY repo),
numbers AS (SELECT n.repo, n.version, level, list_transform(string_split(substr(n.version, 2), '.'),
  lambda x: cast(x AS BIGINT)) AS v FROM nearest n LEFT JOIN levels USING (repo))
SELECT repo, version, CASE level WHEN 3 THEN 'major' WHEN 2 THEN 'minor' WHEN 1 THEN 'patch' END AS bump,
  CASE level WHEN 3 THEN (v[1] + 1) || '.0.0' WHEN 2 THEN v[1] || '.' || (v[2] + 1) || '.0'
   WHEN 1 THEN v[1] || '.' || v[2] || '.' || (v[3] + 1) END AS next_version FROM numbers""",
    "c3_validate_commits": f"""WITH {COMMITS}, checked AS (SELECT *, regexp_matches(subject, '{SUBJECT}') AS formed,
  lower(regexp_extract(subject, '^\\w+')) AS kind, trim(substr(subject, instr(subject, ':') + 1)) AS text FROM commits)
SELECT repo, event_id, 'format' AS error, 'expected type(scope): description' AS detail FROM checked WHERE NOT formed
UNION ALL SELECT repo, event_id, 'unknown_type', kind FROM checked WHERE formed AND kind NOT IN {_in(fv.COMMIT_TYPES)}
UNION ALL SELECT repo, event_id, 'too_short', cast(length(text) AS VARCHAR) FROM checked WHERE formed AND length(text) < 5
UNION ALL SELECT repo, event_id, 'upper_case', text[1] FROM checked WHERE formed AND text[1] = upper(text[1])
  AND text[1] <> lower(text[1])""",
    "c3_commit_verdicts": f"""WITH {COMMITS}, checked AS (SELECT *, regexp_matches(subject, '{SUBJECT}') AS formed,
  lower(regexp_extract(subject, '^\\w+')) AS kind, trim(substr(subject, instr(subject, ':') + 1)) AS text FROM commits),
counted AS (SELECT repo, CASE WHEN NOT formed THEN 1 ELSE
  CASE WHEN kind NOT IN {_in(fv.COMMIT_TYPES)} THEN 1 ELSE 0 END + CASE WHEN length(text) < 5 THEN 1 ELSE 0 END
  + CASE WHEN text[1] = upper(text[1]) AND text[1] <> lower(text[1]) THEN 1 ELSE 0 END END AS n FROM checked)
SELECT repo, count(*) AS commits, cast(sum(n) AS BIGINT) AS problems, sum(n) = 0 AS valid FROM counted GROUP BY repo""",
    "c4_bump_type": f"""WITH {PARSED} SELECT c.repo, b.bump FROM (SELECT DISTINCT repo FROM commits) c
LEFT JOIN (SELECT repo, {BUMPS} AS bump FROM parsed GROUP BY repo) b USING (repo)""",
    "c5_next_version": f"""WITH {PARSED}, {LATEST}, bumps AS (SELECT p.repo, {BUMPS} AS bump FROM parsed p
  LEFT JOIN latest l USING (repo) WHERE l.tag_ts IS NULL OR p.ts > l.tag_ts GROUP BY p.repo),
numbers AS (SELECT l.repo, l.version, b.bump, list_transform(string_split(substr(l.version, 2), '.'),
  lambda x: cast(x AS BIGINT)) AS v FROM latest l LEFT JOIN bumps b USING (repo))
SELECT repo, version, bump, CASE bump WHEN 'major' THEN (v[1] + 1) || '.0.0'
  WHEN 'minor' THEN v[1] || '.' || (v[2] + 1) || '.0' WHEN 'patch' THEN v[1] || '.' || v[2] || '.' || (v[3] + 1) END
  AS next_version FROM numbers""",
    "c6_changelog_entries": f"""WITH {PARSED}, placed AS (SELECT p.*, coalesce(s.section, 'Other') AS section FROM parsed p
  LEFT JOIN {SECTION_ROWS} s(type, section) USING (type))
SELECT repo, section, o.section_rank, row_number() OVER (PARTITION BY repo, section ORDER BY ts DESC, hash DESC) AS entry_rank,
  '- ' || coalesce('**' || scope || '**: ', '') || description || ' (' || substr(hash, 1, 7) || ')' AS line
FROM placed JOIN {ORDER_ROWS} o(section, section_rank) USING (section)""",
    "c6_changelog_text": f"""WITH {PARSED}, {LATEST}, placed AS (SELECT p.*, coalesce(s.section, 'Other') AS section FROM parsed p
  LEFT JOIN {SECTION_ROWS} s(type, section) USING (type)),
entries AS (SELECT repo, section, o.section_rank, row_number() OVER (PARTITION BY repo, section ORDER BY ts DESC, hash DESC) AS n,
  '- ' || coalesce('**' || scope || '**: ', '') || description || ' (' || substr(hash, 1, 7) || ')' AS line
  FROM placed JOIN {ORDER_ROWS} o(section, section_rank) USING (section)),
notes AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash DESC) AS n,
  '- ' || coalesce(list_filter(string_split(body, chr(10)),
    lambda l: starts_with(l, 'BREAKING CHANGE:') OR starts_with(l, 'BREAKING-CHANGE:'))[1], description || ' (BREAKING)') AS line
  FROM parsed WHERE breaking OR contains(body, 'BREAKING CHANGE'))
SELECT repo, 0 AS part, 0 AS section_rank, 0 AS line_no, '## ' || version || ' — 2024-02-01' AS line FROM latest
UNION ALL SELECT DISTINCT repo, 1, 0, 0, '### BREAKING CHANGES' FROM notes
UNION ALL SELECT repo, 1, 0, n, line FROM notes
UNION ALL SELECT DISTINCT repo, 2, section_rank, 0, '### ' || section FROM entries
UNION ALL SELECT repo, 2, section_rank, n, line FROM entries""",
    "c7_breaking_notes": f"""WITH {PARSED} SELECT repo, hash, coalesce(list_filter(string_split(body, chr(10)),
  lambda l: starts_with(l, 'BREAKING CHANGE:') OR starts_with(l, 'BREAKING-CHANGE:'))[1],
  description || ' (BREAKING)') AS note FROM parsed WHERE breaking OR contains(body, 'BREAKING CHANGE')""",
    "c8_whats_new": f"""WITH {PARSED} SELECT repo, hash, type, description FROM parsed
WHERE type IN {_in(fv.USER_FACING_TYPES)}""",
    "w1_stream_catalogue": NEWEST,
    "w1_stream_newest": NEWEST,
    "w2_stream_marks": _marks_query(),
    "w2_watch_tree": _marks_query(f"""every AS ({_base(fixtures.FILES)}), kept AS (SELECT * FROM every
  WHERE NOT ({_excluded(fv.EXCLUDED_NAMES, fv.KEPT_DOT_NAMES)})),
files AS (SELECT doc_id, content FROM kept WHERE doc_id % 3 <> 0 UNION ALL
  SELECT doc_id, content || CASE WHEN doc_id % 3 = 1 THEN chr(10) || '// {MARK} [tutor] changed' ELSE '' END
  FROM kept WHERE doc_id % 3 <> 2)"""),
    "w2_stream_tags": f"WITH {TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags, purpose FROM tagged",
}

# The same rows by another way.
ORACLE_SQL["s4_import_catalogue_by_level"] = ORACLE_SQL["s4_import_catalogue"]
