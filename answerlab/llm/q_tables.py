"""Queries over documents, pages and conversations whose rows stand alone or
meet in joins: sharding, URL filter, chat formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlab.llm import chat, lang_id, sharding, url_filters
from answerlab.llm.common import read
from answerlab.llm.registry import QUERIES, query  # noqa: F401
from answerlab.session import literal_table

#: Byte limit of a shard in the registered query.
SHARD_BYTES = 1 << 21

#: Fixed rules of the contract: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP1_SQL = f"""
with k as (select doc_id, octet_length(encode(coalesce(text, '')))::bigint + 32 as n_bytes,
             ('0x' || substr(md5(concat_ws(chr(31), coalesce('v' || doc_id::varchar, 'n'), coalesce('v' || text, 'n'), coalesce('v' || lang, 'n'),
                                           coalesce('v' || source, 'n'), coalesce('v' || n_chars::varchar, 'n'))), 1, 15))::bigint as k
           from documents),
lv as (select k.*, d.depth, k >> (60 - d.depth) as prefix from k, (select unnest(range(0, 61))::bigint as depth) d),
ok as (select depth, prefix from lv group by all having sum(n_bytes) <= {SHARD_BYTES} or min(k) = max(k)),
leaf as (select k, min(depth) as depth from lv join ok using (depth, prefix) group by k),
r as (select k.*, leaf.depth, row_number() over (partition by k.k) - 1 as i, sum(n_bytes) over (partition by k.k) as kb from k join leaf using (k))
select doc_id, n_bytes, depth::int as depth, case when depth = 0 then '' else lpad(bin(k >> (60 - depth)), depth::int, '0') end as bucket,
       (case when kb > {SHARD_BYTES} then i // greatest(1, {SHARD_BYTES} // n_bytes) else 0 end)::bigint as page
from r
"""

OP2_SQL = r"""
with recursive rules as (select * from (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                                               ('org', '/fr/', 'allow')) t(h, q, v)),
p as (select row_number() over () as rid, page_id, url, coalesce(html, '') as html, coalesce(url, '') as u from pages),
tag as (select url, u, unnest(list_concat(
            list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t,
                '(?is)[^\w-]rel\s*=\s*("([^">]*\s)?canonical(\s[^">]*)?"|''([^''>]*\s)?canonical(\s[^''>]*)?''|canonical[\s/>])')),
                lambda t: regexp_extract(t, '(?is)[^\w-]href\s*=\s*["'']?\s*([^"''\s>]*)', 1)),
            list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t,
                '(?is)[^\w-]http-equiv\s*=\s*("([^">]*\s)?refresh(\s[^">]*)?"|''([^''>]*\s)?refresh(\s[^''>]*)?''|refresh[\s/>])')),
                lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]*)', 1)))) as href from p where url is not null),
hop as (select url as src, trim(replace(href, '&amp;', '&'), ' ') as h,
               translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from tag where href <> ''),
ends as (select src, case when contains(h, '://') then h when starts_with(h, '//') then 'http:' || h when starts_with(h, '/') then 'http://' || host || h
                          else 'http://' || host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || h end as dst
         from hop where h <> ''),
seen as (select url from p union select src from ends union select dst from ends),
parts as (select url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
                 array_to_string(list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'),
                     lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))), '&') as query from seen),
ruled as (select host, path, arg_max(h || q, (length(h || q), length(h), h || q, v)) as rule, arg_max(v, (length(h || q), length(h), h || q, v)) as verdict
          from (select distinct host, path from parts), rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by host, path),
u as materialized (select url, parts.host, parts.path, rule, verdict,
                          case when contains(url, '://') then parts.host || regexp_replace(parts.path, '/+$', '') || case when query = '' then '' else '?' || query end end as node
                   from parts left join ruled on ruled.host = parts.host and ruled.path = parts.path),
edge as materialized (select a.node as a, b.node as b from ends join u a on a.url = src join u b on b.url = dst
                      where a.node is not null and b.node is not null and a.node <> b.node),
linked as materialized (select a, b from edge union select b, a from edge),
reach as (select distinct a as node, a as other from linked union select r.node, l.b from reach r join linked l on l.a = r.other),
comp as materialized (select node, min(other) as component from reach group by node),
votes as (select component, coalesce(bool_or(verdict = 'allow'), false) as yes, coalesce(bool_or(verdict = 'block'), false) as no
          from comp join u using (node) where u.url in (select src from ends union select dst from ends) group by component)
select page_id, host, path, rule, coalesce(verdict, case when yes then 'allow' when no then 'block' else 'allow' end) as verdict, component
from p join u on u.url is not distinct from p.url left join comp using (node) left join votes using (component)
"""

OP10_SQL = r"""
with t as (select conv_id::bigint as conv_id, turn::bigint as turn, role, text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
-- what escaping adds: one for each backslash, each # before two more, each end mark, in roles each colon
s as (select conv_id, turn, role, text, coalesce(role, '') as r, coalesce(text, '') as x, coalesce(role, '') || chr(10) || coalesce(text, '') as said from t),
n as (select *, coalesce(list_sum(list_transform(regexp_extract_all(said, '#{3,}'), lambda h: length(h) - 2)), 0)
                + length(said) - length(replace(said, '\', '')) + (length(said) - length(replace(said, '</turn>', ''))) // 7
                + length(r) - length(replace(r, ':', '')) as added from s)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(said || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) as turns_sha256,
       coalesce(sum(length(x)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(x, '' order by turn nulls first, role nulls first, text nulls first) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(said) - 1 + added + 15)::bigint as formatted_chars
from n group by conv_id
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_extendible_hashing", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), SHARD_BYTES, keep=["doc_id"])


@query("op2_redirect_equivalence", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, RULES, ["host", "path", "verdict"])
    return url_filters.judge_urls(read(spark, sf_dir, "pages"), rules)


@query("op8_byte_gru_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read(spark, sf_dir, "documents"))


@query("op10_chat_formatting", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _tokenizer("byte_bpe_50k.json")
    turns = chat.with_probe(read(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_chats(turns, path), path)
