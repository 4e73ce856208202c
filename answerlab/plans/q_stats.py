"""Queries for splits, label maps, label statistics and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions.constants import COARSE_LABELS
from answerlab.functions.labels import coarsen
from answerlab.functions.text import word_count
from answerlab.operators import measures as M
from answerlab.operators import stats as S
from answerlab.plans.oracle_views import PYSPACE, with_views
from answerlab.plans.registry import query
from answerlab.sources import views
from answerlab.sources.tables import table

R6 = lambda c: F.round(F.col(c), 6).alias(c)

HASH_SQL = "('0x' || substr(md5(cast(doc_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0"
WC_SQL = rf"length(list_filter(string_split_regex(coalesce(text, ''), '{PYSPACE}+'), lambda x: x <> ''))"


@query("l1_split_examples", f"""
select doc_id, case when {HASH_SQL} < 0.2 then 'validation' else 'train' end as split from documents""")
def q_l1(spark, sf):
    return S.split_examples(table(spark, sf, "documents").select("doc_id"), "doc_id", 0.2, 42)


@query("l2_exact_split", f"""
select doc_id, lang, case when row_number() over (partition by lang order by {HASH_SQL}, doc_id)
   <= ceil(0.2 * count(*) over (partition by lang)) then 'validation' else 'train' end as split
from documents""")
def q_l2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return S.exact_split(docs, "doc_id", 0.2, 42, strata=["lang"])


@query("l3_label_map", with_views("""
select label, (row_number() over (order by label) - 1)::integer as label_id
from (select distinct label from v_split where split = 'train' and label is not null and trim(label) <> '') x""",
                                  "v_split"))
def q_l3(spark, sf):
    return S.label_map(views.split(spark, sf).where(F.col("split") == "train"), "label")


@query("l4_class_weights", with_views("""
with m as (select label, (row_number() over (order by label) - 1)::integer as label_id
           from (select distinct label from v_split where split = 'train' and label is not null and trim(label) <> '') x),
c as (select label, count(*) as n from v_split where split = 'train' group by label),
t as (select m.label, m.label_id, coalesce(c.n, 0) as n from m left join c using (label))
select label, label_id, n::bigint as n,
  round(case when n > 0 then (select sum(n) from t) / ((select count(*) from t) * n) else 0.0 end, 6) as weight
from t""", "v_split"), "R")
def q_l4(spark, sf):
    train = views.split(spark, sf).where(F.col("split") == "train")
    w = S.class_weights(train, S.label_map(train, "label"), "label")
    return w.select("label", "label_id", "n", R6("weight"))


def _voted_split(spark, sf):
    return S.split_examples(views.votes(spark, sf), "doc_id", 0.2, 42)


@query("l5_label_distribution", with_views(f"""
with s as (select doc_id, annotator2, case when {HASH_SQL} < 0.2 then 'validation' else 'train' end as split from v_votes),
m as (select distinct annotator2 as label from s
      where split = 'train' and annotator2 is not null and regexp_replace(annotator2, '^\\s+|\\s+$', '', 'g') <> ''),
t as (select s.split, coalesce(m.label, '<unmapped>') as label from s left join m on m.label = s.annotator2),
g as (select sp.split, m.label from m, (values ('train'), ('validation')) sp(split)
      union select sp.split, '<unmapped>' from (values ('train'), ('validation')) sp(split))
select g.split, g.label, count(t.label)::bigint as n from g left join t on t.split = g.split and t.label = g.label
group by g.split, g.label having g.label <> '<unmapped>' or count(t.label) > 0""", "v_votes"))
def q_l5(spark, sf):
    df = _voted_split(spark, sf)
    lmap = S.label_map(df.where(F.col("split") == "train"), "annotator2")
    return S.label_distribution(df, lmap, "annotator2")


@query("l6_value_counts", """
select lang as value, count(*) as n, round(count(*) / (select count(*) from documents), 6) as share
from documents group by lang""", "R")
def q_l6(spark, sf):
    return S.value_counts(table(spark, sf, "documents"), "lang").select("value", "n", R6("share"))


_CT_SQL = """
with p as (select v.official_label, coalesce(t.coarse, v.annotator1) as a1 from v_votes v
           left join v_taxonomy t on t.label = v.annotator1)
select official_label, count(*) filter (where a1 = 'Clear Reply') as "Clear Reply",
  count(*) filter (where a1 = 'Ambivalent') as "Ambivalent",
  count(*) filter (where a1 = 'Clear Non-Reply') as "Clear Non-Reply"
from p group by official_label"""


def _ct_input(spark, sf):
    return views.votes(spark, sf).select("official_label", coarsen("annotator1").alias("a1"))


@query("l7_crosstab", with_views(_CT_SQL, "v_votes"))
def q_l7(spark, sf):
    return S.crosstab(_ct_input(spark, sf), "official_label", "a1", COARSE_LABELS)


@query("l8_crosstab_pct", with_views(f"""
with p as (select v.official_label, coalesce(t.coarse, v.annotator1) as a1 from v_votes v
           left join v_taxonomy t on t.label = v.annotator1),
ct as (select official_label, count(*) filter (where a1 = 'Clear Reply') as cr,
  count(*) filter (where a1 = 'Ambivalent') as am, count(*) filter (where a1 = 'Clear Non-Reply') as cn
  from p group by official_label)
select official_label, round(cr * 100.0 / (cr + am + cn), 6) as "Clear Reply",
  round(am * 100.0 / (cr + am + cn), 6) as "Ambivalent", round(cn * 100.0 / (cr + am + cn), 6) as "Clear Non-Reply"
from ct""", "v_votes"), "R")
def q_l8(spark, sf):
    ct = S.crosstab_pct(_ct_input(spark, sf), "official_label", "a1", COARSE_LABELS)
    return ct.select("official_label", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in COARSE_LABELS])


@query("l9_describe_lengths", f"""
with d as (select n_chars::double as n_chars, {WC_SQL}::double as word_count from documents),
u as (select 'n_chars' as "column", n_chars as x from d union all select 'word_count', word_count from d)
select "column", count(x) as count, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, min(x) as min,
  round(quantile_cont(x, 0.25), 6) as q25, round(quantile_cont(x, 0.5), 6) as q50,
  round(quantile_cont(x, 0.75), 6) as q75, max(x) as max
from u group by "column" """, "R")
def q_l9(spark, sf):
    d = table(spark, sf, "documents").select("n_chars", word_count("text").alias("word_count"))
    out = S.describe_lengths(d, ["n_chars", "word_count"])
    return out.select("column", "count", R6("mean"), R6("std"), "min", R6("q25"), R6("q50"), R6("q75"), "max")


@query("l10_length_stats_by_label", with_views("""
select label, round(avg(length(text)), 6) as mean, round(quantile_cont(length(text), 0.5), 6) as median,
  min(length(text))::integer as min, max(length(text))::integer as max,
  round(avg(case when length(text) <= 300 then 1.0 else 0.0 end), 6) as share_within_300,
  round(avg(case when length(text) <= 500 then 1.0 else 0.0 end), 6) as share_within_500
from v_split where split = 'train' group by label""", "v_split"), "R")
def q_l10(spark, sf):
    tr = views.split(spark, sf).where(F.col("split") == "train")
    out = S.length_stats_by_label(tr, "label", "text")
    return out.select("label", R6("mean"), R6("median"), "min", "max", R6("share_within_300"), R6("share_within_500"))


@query("l11_histogram", """
with mm as (select min(n_chars) as lo, max(n_chars) as hi from documents),
b as (select case when hi = lo then 0 else least(((n_chars - lo) * 30) // (hi - lo), 29) end as bin
      from documents, mm where n_chars is not null),
c as (select bin, count(*) as n from b group by bin)
select r.bin::integer as bin, round(mm.lo + r.bin * ((mm.hi - mm.lo) / 30.0), 6) as lo,
  round(mm.lo + (r.bin + 1) * ((mm.hi - mm.lo) / 30.0), 6) as hi, coalesce(c.n, 0)::bigint as n
from (select unnest(range(0, 30)) as bin) r cross join mm left join c on c.bin = r.bin""", "R")
def q_l11(spark, sf):
    h = S.histogram(table(spark, sf, "documents"), "n_chars", 30)
    return h.select("bin", R6("lo"), R6("hi"), "n")


@query("l12_label_vs_prediction", with_views("""
select label, sum(t)::bigint as n_true, sum(p)::bigint as n_pred from (
  select true_label as label, 1 as t, 0 as p from v_predictions
  union all select pred_label, 0, 1 from v_predictions) x
where label is not null group by label""", "v_predictions"))
def q_l12(spark, sf):
    return M.label_vs_prediction(views.predictions(spark, sf))


@query("b1_length_category", with_views(f"""
with w as (select doc_id, split, {WC_SQL} as wc from v_split),
p as (select quantile_cont(wc, 0.3333) as p33, quantile_cont(wc, 0.6667) as p67 from w where split = 'train')
select doc_id, case when split <> 'train' then null when wc <= p33 then 'Short' when wc <= p67 then 'Medium'
  else 'Large' end as length_category
from w, p""", "v_split"))
def q_b1(spark, sf):
    df = views.split(spark, sf)
    return S.length_category(df, "text", F.col("split") == "train").select("doc_id", "length_category")


@query("b2_quantile_bins", """
with e as (select quantile_cont(n_chars::double, 0.0) as e0, quantile_cont(n_chars::double, 1/3) as e1,
             quantile_cont(n_chars::double, 2/3) as e2, quantile_cont(n_chars::double, 1.0) as e3 from documents),
u as (select distinct unnest([e0, e1, e2, e3]) as edge from e),
b as (select d.n_chars, (select count(*) from u where u.edge > e.e0 and u.edge < e.e3 and u.edge < d.n_chars::double)::integer as qbin
      from documents d, e where d.n_chars is not null)
select qbin, count(*) as n, min(n_chars) as min, max(n_chars) as max from b group by qbin""")
def q_b2(spark, sf):
    rows, _ = S.quantile_bins(table(spark, sf, "documents"), "n_chars", 3)
    return rows.where(F.col("qbin").isNotNull()).groupBy("qbin").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("min"), F.max("n_chars").alias("max"))


@query("b3_binned_mean", with_views("""
with mm as (select min(n_chars::double) as lo, max(n_chars::double) as hi from v_text_labels),
b as (select case when hi = lo then 0 else greatest(least(ceil((n_chars::double - lo) / ((hi - lo) / 5)) - 1, 4), 0) end as bin,
        quality from v_text_labels, mm where n_chars is not null)
select b.bin::integer as bin, round(lo + b.bin * ((hi - lo) / 5), 6) as lo, round(lo + (b.bin + 1) * ((hi - lo) / 5), 6) as hi,
  count(*) as n, round(avg(quality::double), 6) as mean
from b, mm group by b.bin, mm.lo, mm.hi""", "v_text_labels"), "R")
def q_b3(spark, sf):
    out = S.binned_mean(views.text_labels(spark, sf), "n_chars", "quality", 5)
    return out.select("bin", R6("lo"), R6("hi"), "n", R6("mean"))
