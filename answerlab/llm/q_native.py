"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlab.llm import decontamination, quality_rules
from answerlab.llm.common import read
from answerlab.llm.registry import query

OP9_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '') as k,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l
           from documents),
win as (select k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select distinct k, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select k, i from (select *, count(*) over (partition by k, g) as n from win) where n > 1),
cov as (select k, count(distinct j) as n from (select k, unnest([i, i + 1, i + 2]) as j from rep) group by k),
base as (select d.*, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
                (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
         from d left join cov using (k)),
ln as (select distinct k, source, t, x from (
         select k, source, t, trim(unnest(string_split(regexp_replace(lower(t), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)))) as x from d) where x <> ''),
hosts as (select source, count(distinct t) as docs from d group by source),
hot as (select source, x, n from (select source, x, count(distinct t) as n from ln group by source, x) join hosts using (source)
        where n > least(50, greatest(2, docs * 0.1::double))),
gone as (select k, count(*) as n, sum(length(x)) as c from ln join hot using (source, x) group by k),
chars as (select k, sum(length(x)) as c from ln group by k)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       coalesce(gone.n, 0)::bigint as n_removed_lines, coalesce(chars.c, 0)::bigint as line_chars, coalesce(gone.c, 0)::bigint as removed_chars,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
         and coalesce(chars.c, 0) - coalesce(gone.c, 0) >= coalesce(chars.c, 0) * 0.3 as kept
from base b left join gone using (k) left join chars using (k)
"""


@query("op9_quality_rules", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


@query("op3_spaced_seed_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
