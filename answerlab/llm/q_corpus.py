"""Queries that compare whole documents with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlab.llm import line_dedup, near_dedup, packing, substring_dedup
from answerlab.llm.common import read
from answerlab.llm.registry import query

OP5_SQL = r"""
with d as (select row_number() over () as rid, doc_id,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select rid, w, unnest(range(1, len(w) - 33)) as i from d)),
rep as (select rid, i from (select rid, i, count(*) over (partition by h) as n from win) where n > 1),
gone as (select distinct rid, unnest(range(i, i + 35)) as j from rep),
word as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
left_over as (select rid, count(*) as n, string_agg(x, ' ' order by j) as t from word anti join gone using (rid, j) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join left_over using (rid)
"""

OP6_SQL = r"""
with recursive d as (select row_number() over () as rid, doc_id, list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
                     from documents),
sets as materialized (select distinct rid, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as g
                      from (select rid, w, unnest(range(1, greatest(len(w), least(len(w) + 1, 2)))) as i from d)),
size as materialized (select rid, count(*) as n from sets group by rid),
pair as (select a.rid as a, b.rid as b, count(*) as k from sets a join sets b on a.g = b.g and a.rid < b.rid group by all),
link as materialized (select a, b from pair join size x on x.rid = a join size y on y.rid = b where 100 * k >= 80 * (x.n + y.n - k)),
edge as materialized (select a, b from link union all select b, a from link),
reach as (select rid, rid as other from d union select r.rid, e.b from reach r join edge e on e.a = r.other),
least_id as (select r.rid, min(d.doc_id) as component_id from reach r join d on d.rid = r.other group by r.rid)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(doc_id = component_id, false) as kept
from d join least_id using (rid) left join size using (rid)
"""

OP7_SQL = r"""
with d as (select row_number() over () as rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) as p from documents),
piece as (select rid, doc_id, unnest(p) as x, unnest(range(1, len(p) + 1)) as i, len(p) as n from d),
line as (select rid, doc_id, x, i, row_number() over (partition by rid order by i) as j from piece where x <> ''),
win as (select a.rid, a.doc_id, a.j, md5(a.x || chr(10) || b.x || chr(10) || c.x) as h
        from line a join line b on b.rid = a.rid and b.j = a.j + 1 join line c on c.rid = a.rid and c.j = a.j + 2),
later as (select rid, j from (select rid, j, row_number() over (partition by h order by doc_id nulls first, rid, j) as o from win) where o > 1),
gone as (select distinct l.rid, l.i from line l join (select distinct rid, unnest([j, j + 1, j + 2]) as j from later) using (rid, j)),
kept as (select rid, string_agg(case when i < n then x || chr(10) else x end, '' order by i) as t from piece anti join gone using (rid, i) group by rid),
lines as (select rid, count(*) as n from line group by rid),
removed as (select rid, count(*) as n from gone group by rid)
select doc_id, coalesce(lines.n, 0)::bigint as n_lines, coalesce(removed.n, 0)::bigint as n_removed_lines, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (rid) left join lines using (rid) left join removed using (rid)
"""


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_mixture_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@query("op5_substring_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(read(spark, sf_dir, "documents"))


@query("op6_minhash_near_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(read(spark, sf_dir, "documents"))


@query("op7_line_dedup", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))
