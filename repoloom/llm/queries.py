"""One query per corpus operator, each over its whole tables, and their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoloom.llm import (
    alignment,
    centroids,
    common,
    decontaminate,
    language,
    minhash,
    nearest,
    pieces,
    secrets,
    sharding,
    suffix_dedup,
    token_files,
    toxicity,
    url_lists,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tokenizer_path(name: str) -> str:
    """A vocabulary file: in the folder that REPOLOOM_TOKENIZERS names, else the public ones."""
    folder = os.environ.get("REPOLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return suffix_dedup.remove_repeats(docs).drop("spans", "kept")


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(common.read_table(spark, sf_dir, "documents")).drop("row_key")


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "tokens")
    manifest = token_files.write_tokens(docs, folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(manifest, folder)


# The tables have no fetch times and no lists.  Both are derived from all pages: a page is
# fetched on a day of two years that its id names, and 11 days later its host, its
# domain and its section each get an entry that lists or unlists them.
@_query
def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    days = F.col("page_id") * 37 % 730
    captures = pages.withColumn(
        "fetched", F.timestamp_seconds(F.lit(1_704_067_200) + days * 86_400)
    )
    host = url_lists.host(F.col("url"))
    section = F.concat_ws("/", host, F.slice(url_lists.segments(F.col("url")), 1, 1))
    domain = F.regexp_extract(host, r"[^.]+\.[^.]+$", 0)
    n = F.length("url")
    row = lambda name, pattern, active: F.struct(
        F.lit(name).alias("list"), pattern.alias("pattern"), active.alias("active")
    )
    listed = F.array(
        row("hosts", host, n % 3 == 0), row("sections", section, n % 2 == 0), row("domains", domain, n % 5 == 0)
    )
    entries = captures.select(
        F.timestamp_add("DAY", F.lit(11), "fetched").alias("at"), F.explode(listed).alias("e")
    ).select("at", "e.*")
    return url_lists.judge(captures, entries)


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs).drop("text", "redacted")


@_query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


@_query
def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return pieces.summary(docs, tokenizer_path("piece_bpe_32k.model"))


@_query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    items = common.read_table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("item_ids", "row_key")


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    dealt = sharding.interleaved_shards(docs, shards=8)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@_query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(common.read_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels")
    held_out = toxicity.held_out(F.col("doc_id"))
    found = toxicity.toxicity(docs, toxicity.fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


_OP4 = r"""
with captures as (
  select page_id, url,
    make_timestamp((1704067200 + page_id * 37 % 730 * 86400) * 1000000) as fetched,
    regexp_replace(lower(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') as host,
    list_filter(string_split(regexp_extract(url,
      '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as path
  from pages
),
entries as (
  select 'hosts' as list, host as pattern, fetched + interval 11 day as since,
    length(url) % 3 = 0 as active from captures
  union all
  select 'sections', lower(case when len(path) > 0 then host || '/' || path[1] else host end),
    fetched + interval 11 day, length(url) % 2 = 0 from captures
  union all
  select 'domains', regexp_extract(host, '[^.]+\.[^.]+$', 0), fetched + interval 11 day,
    length(url) % 5 = 0 from captures
),
states as (
  select list, pattern, since, max(active) as active from entries
  where pattern is not null and since is not null and active is not null group by all
),
valid as (
  select *, lead(since) over (partition by list, pattern order by since) as until from states
),
keys as (
  select distinct page_id, url, fetched, unnest(list_concat(
    [array_to_string(string_split(host, '.')[i:], '.')
      for i in range(1, len(string_split(host, '.')) + 1)],
    [lower(host || '/' || array_to_string(path[:i], '/')) for i in range(1, len(path) + 1)]
  )) as key
  from captures where host <> ''
),
found as (
  select page_id, url, fetched, count(*) as n_matches,
    string_agg(distinct list, ',' order by list) as lists,
    arg_min(pattern, (-length(pattern), pattern)) as pattern
  from keys join valid on key = pattern and active and fetched >= since
    and (until is null or fetched < until)
  group by all
)
select c.page_id, c.url, c.fetched, coalesce(n_matches, 0) as n_matches,
  coalesce(lists, '') as lists, pattern, coalesce(n_matches, 0) > 0 as blocked
from captures c left join found f
  on c.page_id = f.page_id and c.url = f.url and c.fetched = f.fetched
"""

# Bytes as pairs of hexadecimal digits, so that a string of 50 bytes is 100 characters.
_OP1 = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
),
n as (select *, length(h) // 2 as n from d),
starts as (
  select doc_id, p, h[2 * p - 1:2 * p + 98] as s
  from n, range(1, n - 48) r(p) where n >= 50
),
firsts as (select s, min(doc_id) as first from starts group by s having count(distinct doc_id) > 1),
gone as (
  select doc_id, p, p + 50 as q from starts join firsts using (s) where first < doc_id
),
runs as (
  select doc_id, p, q, coalesce(p > max(q) over (partition by doc_id order by p
    rows between unbounded preceding and 1 preceding), true) as fresh from gone
),
spans as (
  select doc_id, run, min(p) as lo, max(q) as hi from (
    select *, sum(fresh::int) over (partition by doc_id order by p) as run from runs
  ) x group by doc_id, run
),
kept as (
  select doc_id, coalesce(string_agg(h[2 * lo - 1:2 * hi - 2], '' order by lo), '') as k from (
    select n.doc_id, h, coalesce(lag(s.hi) over w, 1) as lo, s.lo as hi
    from n join spans s on s.doc_id = n.doc_id window w as (partition by n.doc_id order by s.lo)
    union all
    select n.doc_id, any_value(h), max(s.hi), any_value(n) + 1 from n join spans s on s.doc_id = n.doc_id
    group by n.doc_id
  ) y where hi > lo group by doc_id
),
sums as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from spans group by doc_id)
select n.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else coalesce(k, '') end)) as kept_sha256
from n left join sums s on s.doc_id = n.doc_id left join kept x on x.doc_id = n.doc_id
"""

_OP2 = r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
),
shingles as (
  select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s
  from d, range(1, greatest(len(w) - 3, 2)) r(k) where len(w) > 0
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * c >= 75 * (x.n + y.n - c)
),
both_ways as (select a, b from links union select b, a from links),
reach as (
  select a, b from both_ways
  union
  select r.a, l.b from reach r join both_ways l on l.a = r.b
),
least as (select a, min(b) as m from reach group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
  d.doc_id <= coalesce(m, d.doc_id) as kept
from d left join sizes using (doc_id) left join least on a = d.doc_id
"""

_OP8 = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
items as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
windows as (
  select distinct item, array_to_string(w[k:k + 9], ' ') as s, least(len(w), 10) as n
  from items, range(1, greatest(len(w) - 9, 1) + 1) r(k) where len(w) > 0
),
hits as (
  select doc_id, k, x.n, item
  from (select doc_id, k, l.n, array_to_string(w[k:k + l.n - 1], ' ') as s
    from d, (select distinct n from windows) l, range(1, len(w) + 1) r(k) where k + l.n - 1 <= len(w)) x
  join windows v on v.s = x.s and v.n = x.n
),
words as (
  select doc_id, count(distinct p) as n_hit from (
    select doc_id, unnest(range(k, k + n)) as p from hits) y group by doc_id
),
named as (
  select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids
  from hits group by doc_id
)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""

_OP12 = """
with vectors as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings
  where len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
),
parts as materialized (select vec_id, unnest(v) as x, unnest(range(64)) as i from vectors),
c0 as materialized (
  select c, unnest(v) as y, unnest(range(64)) as i from (
    select v, row_number() over (order by sha256('3:' || vec_id)) - 1 as c from vectors
  ) f where c < 8
)
"""
_OP12_ROUND = """,
a{n} as materialized (
  select vec_id, arg_min(c, (d, c)) as c, min(d) as d from (
    select vec_id, c, sum((x - y) * (x - y))::bigint as d
    from parts join c{n} using (i) group by vec_id, c
  ) p group by vec_id
)"""
_OP12_MOVE = """,
c{m} as materialized (
  select o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, y)::bigint as y
  from c{n} o left join (
    select c, i, sum(x) as s, count(*) as n from a{n} join parts using (vec_id) group by c, i
  ) w on w.c = o.c and w.i = o.i
)"""
for _n in range(10):
    _OP12 += (_OP12_ROUND + _OP12_MOVE).format(n=_n, m=_n + 1)
_OP12 += _OP12_ROUND.format(n=10)
_OP12 += """
select vec_id, a.c::int as cluster, d as distance,
  (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
  centroid_sha256
from a10 a join (
  select c, sha256(string_agg(y::varchar, ',' order by i)) as centroid_sha256 from c10 group by c
) s on s.c = a.c
"""

#: By query; the others can't be said in SQL and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _OP1,
    "op2_minhash_dedup": _OP2,
    "op4_url_lists": _OP4,
    "op8_decontaminate": _OP8,
    "op12_centroids": _OP12,
}
