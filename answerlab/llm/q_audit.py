"""Queries that audit the corpus: sources, secrets, tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerlab.llm import alignment, divergence, secret_scan
from answerlab.llm.common import read
from answerlab.llm.registry import query

OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
w as (select r, lang, source, unnest(t) as term from d),
kept as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= 30),
lng as (select lang, count(*) as v, sum(n) as n from kept group by lang),
grp as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
tot as (select lang, source, sum(n) as n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as c,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)::hugeint) // (coalesce(tot.n, 0) + 5 * lng.v) as p,
             1 + (1000000000 * (k.n + 5)::hugeint) // (lng.n + 5 * lng.v) as q
      from grp g join kept k using (lang) join lng using (lang) left join tot using (lang, source) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item from grp a join grp b on a.lang = b.lang and a.source <> b.source),
diff as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
         from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
rows as (select lang, source, 'pair' as part, item, coalesce(value, 0)::bigint as value from pairs left join diff using (lang, source, item)
         union all
         select lang, source, 'term', term, (p - q)::bigint from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from rows)
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""


@query("op11_source_divergence_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_secret_cnn_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(read(spark, sf_dir, "documents"))
