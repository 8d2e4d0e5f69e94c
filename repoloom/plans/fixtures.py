"""File, path, commit and response tables derived from the given base tables.

Each is a view-like DataFrame over the whole base table: work grows with it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATHS = r"""
SELECT page_id, concat('site/', regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','')) AS path
FROM {pages}"""

# Seven lists whose paths overlap, some with a root of their own.
PATH_LISTS = r"""
SELECT page_id, cast(page_id % 7 AS bigint) AS list_id,
 concat(CASE WHEN page_id % 7 = 5 AND page_id % 3 = 0 THEN './' WHEN page_id % 7 = 6 THEN 'other/' ELSE 'site/' END,
  regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','')) AS path
FROM {pages}"""

FILES = """
SELECT doc_id, source AS repo,
 CASE doc_id % 97
  WHEN 0 THEN concat(source,'/README.md') WHEN 1 THEN concat(source,'/readme.md')
  WHEN 2 THEN concat(source,'/package.json') WHEN 3 THEN concat(source,'/yarn.lock')
  ELSE concat(source,'/',
   CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'src/components' WHEN 2 THEN 'tests'
    WHEN 3 THEN 'api' WHEN 4 THEN 'node_modules' WHEN 5 THEN '.github' WHEN 6 THEN '.cache' END,
   '/d',doc_id % 40,'/',
   CASE doc_id % 5 WHEN 0 THEN concat('mod',doc_id) WHEN 1 THEN concat('useItem',doc_id)
    WHEN 2 THEN 'Widget' WHEN 3 THEN 'types' ELSE 'config' END,
   CASE doc_id % 12 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.tsx'
    WHEN 4 THEN '.test.ts' WHEN 5 THEN '.sql' WHEN 6 THEN '.css' WHEN 7 THEN '.html'
    WHEN 8 THEN '.md' WHEN 9 THEN '.png' WHEN 10 THEN '.vue' WHEN 11 THEN '.yaml' END) END AS path,
 concat(
  CASE doc_id % 11 WHEN 0 THEN 'import torch' WHEN 1 THEN 'from flask import Flask'
   WHEN 2 THEN 'import React from "react";' WHEN 3 THEN 'const e = require("express");'
   WHEN 4 THEN 'import numpy as np' WHEN 5 THEN 'import {{ z }} from "zod";'
   WHEN 6 THEN 'import logging' ELSE 'x = 1' END, chr(10),
  CASE doc_id % 17 WHEN 0 THEN concat('// ᚲ [tutor] why', chr(10))
   WHEN 1 THEN concat('  # ᚲ [minimal] mark', chr(13), chr(10))
   WHEN 2 THEN concat('-- ᚲ [technical] cost', chr(10))
   WHEN 3 THEN concat('/* ᚲ [non-technical] plain */', chr(10), '// ᚲ [tutor] also', chr(10))
   WHEN 4 THEN concat('s = "ᚲ [tutor] not a comment"', chr(10))
   WHEN 5 THEN concat('// ᚲ [weird] other', chr(10)) ELSE '' END,
  text) AS content
FROM {documents}"""

# Listings and catalogues hold every segment of an address, and a page in four or three
# goes further down, so depths differ.
LISTINGS = """
SELECT page_id AS listing_id, concat('site', chr(10), '├── ', split_part(p,'/',1), chr(10),
 '│   ├── ', split_part(p,'/',2), chr(10), '│   │   └── ', split_part(p,'/',3),
 CASE WHEN split_part(p,'/',3) LIKE '%.html' THEN '' ELSE '/' END, chr(10),
 CASE page_id % 4 WHEN 1 THEN concat('│   │       └── deep', chr(10), '│   │           ├── er', chr(10),
   '│   │           │   └── est.py', chr(10), '│   │           └── index.ts', chr(10))
  WHEN 2 THEN concat('│   └── config.yaml', chr(10)) ELSE '' END,
 '└── README.md', chr(10), chr(10), '4 directories, 1 file') AS text
FROM (SELECT page_id, regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p
      FROM {pages}) t"""

CATALOGUES = """
SELECT page_id AS repo_id, concat('{{"basePath":"/x",',
 CASE page_id % 5 WHEN 0 THEN '"readme":"# Site","hasSnippets":true,"generatedAt":"2024-01-01T00:00:00Z",'
  WHEN 1 THEN '"model":"m","hasSnippets":false,' ELSE '' END,
 CASE page_id % 5 WHEN 0 THEN concat('"snippets":{{"site/a.md":"line ', page_id, '"}},') ELSE '' END,
 '"tree":{{"name":"site","children":[{{"name":"',
 split_part(p,'/',1), '","description":"host","children":[{{"name":"', split_part(p,'/',2),
 '","files":[{{"name":"f', page_id, '.md","purpose":"—","tags":["docs"]}}],"children":[{{"name":"',
 split_part(p,'/',3), '","files":[{{"name":"g.py","purpose":"code"}}]',
 CASE page_id % 3 WHEN 0 THEN ',"children":[{{"name":"a","children":[{{"name":"b","files":[{{"name":"c.ts"}}]}}]}}]'
  ELSE '' END,
 '}}]}}]}}],"files":[{{"name":"a.md"}}]}}}}') AS body
FROM (SELECT page_id, regexp_replace(regexp_replace(url,'^https?://',''),'[?#].*$','') AS p
      FROM {pages}) t"""

_ESCAPED = (
    "replace(replace(replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), "
    "chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')), "
    "chr(13), concat(chr(92), 'r')), chr(9), concat(chr(92), 't'))"
)
# Whole texts.  Some answers are cut off, some use single quotes, some repeat their key.
RESPONSES = f"""
SELECT conv_id AS batch_id, turn, CASE conv_id % 10
  WHEN 1 THEN concat('{{{{', chr(39), cast(conv_id * 8 + turn AS varchar(20)), chr(39), ': 1}}}}')
  ELSE concat('```json', chr(10), '{{{{', CASE conv_id % 10 WHEN 2
    THEN concat('"', cast(conv_id * 8 + turn AS varchar(20)), '": "before", ') ELSE '' END, '"',
   cast(conv_id * 8 + turn AS varchar(20)), '": "', {_ESCAPED},
   CASE WHEN conv_id % 10 = 0 THEN '' ELSE '"}}}}' END, chr(10), '```') END AS body
FROM {{conversations}} WHERE role = 'assistant'"""

COMMITS = """
SELECT concat('repo',user_id % 20) AS repo, ts, event_id, md5(cast(event_id AS varchar(20))) AS hash,
 CASE WHEN event_id % 25 = 1 OR user_id % 20 >= 18 THEN 'merge branch x' ELSE concat(
  CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 20 BETWEEN 10 AND 14 THEN 'perf' ELSE 'feat' END
       WHEN event_type = 'error' THEN 'fix' WHEN event_type = 'click' THEN 'docs'
       WHEN event_type = 'view' THEN 'Chore' ELSE 'wip' END,
  CASE WHEN event_id % 3 = 0 THEN concat('(s',event_id % 5,')') ELSE '' END,
  CASE WHEN event_id % 500 = 7 AND user_id % 20 < 4 THEN '!' ELSE '' END, ': ',
  CASE WHEN event_id % 10 = 0 THEN 'ok' WHEN event_id % 10 = 5 THEN 'Upper start'
       ELSE concat('change item ',event_id) END) END AS subject,
 CASE WHEN user_id % 20 IN (4,5) AND event_id % 100 = 3 THEN 'BREAKING CHANGE: drops a field'
      WHEN user_id % 20 = 6 AND event_id % 100 = 4 THEN 'BREAKING-CHANGE: drops a field'
      ELSE '' END AS body
FROM {events}"""

TAGS = """
SELECT repo, concat('v1.', n, '.0') AS version, TIMESTAMP '2024-01-15 00:00:00' AS ts
FROM (SELECT DISTINCT user_id % 20 AS n, concat('repo', user_id % 20) AS repo FROM {events}) t
WHERE n % 3 <> 0"""

# A history for the commits of each repo: a main line of three in five, side lines of the
# other two, two of three of which are merged, later ones with older times among them.
HISTORY = f"""
SELECT c.*, lag(hash, 1) OVER w AS h1, lag(hash, 2) OVER w AS h2, lag(hash, 3) OVER w AS h3,
 row_number() OVER w AS n, count(*) OVER (PARTITION BY repo) AS total
FROM ({COMMITS}) c WINDOW w AS (PARTITION BY repo ORDER BY event_id)"""

DAG = f"""
SELECT repo, ts, event_id, hash, subject, body, n, total,
 CASE WHEN n = 1 THEN NULL WHEN n % 5 = 3 THEN h2 WHEN n % 5 = 0 THEN h3 ELSE h1 END AS first_parent,
 CASE WHEN n % 5 = 0 AND n % 15 <> 0 THEN h1 END AS second_parent
FROM ({HISTORY}) h"""

#: Tags on the main line, on merged and unmerged side lines, and some that aren't releases.
DAG_TAGS = f"""
SELECT repo, concat(CASE WHEN n % 13 = 5 THEN 'rc' ELSE 'v' END, '1.', cast(n AS varchar(20)), '.0') AS version, hash
FROM ({DAG}) d WHERE repo NOT LIKE '%3' AND n % 20 IN (3, 7, 14) AND n * 4 < total * 3"""

DAG_HEADS = f"""
SELECT repo, max_by(hash, n) AS hash FROM ({DAG}) d WHERE n % 5 IN (0, 1, 2) GROUP BY repo"""

QUERY_TEXTS = [
    (1, "widget react"), (2, "config yaml"), (3, "Python module"),
    (4, " test  unit "), (5, "zzz"), (6, " "),
]

_NAMES = ("pages", "documents", "conversations", "events")


def for_duckdb(template: str) -> str:
    return template.format(**{n: n for n in _NAMES})


def _derived(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    tables = {n: f"parquet.`{sf_dir}/{n}.parquet`" for n in _NAMES}
    return spark.sql(template.format(**tables))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PATHS)


def path_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PATH_LISTS)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, FILES)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, LISTINGS)


def catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, CATALOGUES)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, RESPONSES)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, COMMITS)


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, TAGS)


def commit_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits with parents, tags and heads."""
    commits = _derived(spark, sf_dir, DAG)
    parents = F.array_compact(F.array("first_parent", "second_parent")).alias("parents")
    commits = commits.select("repo", "ts", "event_id", "hash", "subject", "body", parents)
    return commits, _derived(spark, sf_dir, DAG_TAGS), _derived(spark, sf_dir, DAG_HEADS)


def stream(spark: SparkSession, sf_dir: str, template: str, table: str) -> DataFrame:
    """The derived table over the base table, a file or a folder of files, read as a stream."""
    location = f"{sf_dir}/{table}.parquet"
    # A pattern that fits the table alone: a stream takes a single file by a pattern only.
    source = spark.readStream.schema(spark.read.parquet(location).schema).parquet(f"{location[:-1]}[t]")
    view = f"{table}_stream"
    source.createOrReplaceTempView(view)
    return spark.sql(template.format(**{table: view}))
