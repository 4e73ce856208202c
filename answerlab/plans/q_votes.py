"""Queries for vote consolidation and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions.constants import COARSE_LABELS, FINE_LABELS
from answerlab.functions.labels import coarsen, label_id
from answerlab.operators import measures as M
from answerlab.operators import votes as V
from answerlab.plans.oracle_views import with_views
from answerlab.plans.registry import query
from answerlab.sources import views

# --- shared oracle pieces (DuckDB) ---------------------------------------------
ORACLE_VALID_VOTES = r"""
vv as (
  select doc_id, official_label, annotator_no, annotator, vote from (
    select doc_id, official_label, 1 as annotator_no, 'annotator1' as annotator, annotator1 as vote from v_votes
    union all select doc_id, official_label, 2, 'annotator2', annotator2 from v_votes
    union all select doc_id, official_label, 3, 'annotator3', annotator3 from v_votes) u
  where vote is not null and regexp_replace(vote, '^\s+|\s+$', '', 'g') not in ('', 'None'))"""

ORACLE_MAJORITY = ORACLE_VALID_VOTES + r""",
vc as (select doc_id, vote, count(*) as n from vv group by doc_id, vote),
mx as (select doc_id, max(n) as top from vc group by doc_id),
tops as (select vc.doc_id, count(*) as n_top, min(vc.vote) as top_vote
         from vc join mx on vc.doc_id = mx.doc_id and vc.n = mx.top group by vc.doc_id),
maj as (select doc_id, top_vote as maj from tops where n_top = 1)"""

ORACLE_RELIABILITY = ORACLE_MAJORITY + r""",
grid as (select a.annotator_no, a.annotator, c.label as coarse_label
         from (values (1,'annotator1'),(2,'annotator2'),(3,'annotator3')) a(annotator_no, annotator), v_coarse c),
hits as (select vv.annotator, t.coarse as coarse_label, count(*) as n
         from vv join maj using (doc_id) join v_taxonomy t on t.label = maj.maj
         where vv.vote = maj.maj group by 1, 2),
rel as (select g.annotator_no, g.annotator, g.coarse_label, coalesce(h.n, 0)::bigint as n
        from grid g left join hits h using (annotator, coarse_label))"""

ORACLE_CONSOLIDATED = ORACLE_RELIABILITY + r""",
und as (select doc_id from tops where n_top > 1),
cand as (select vv.*, coalesce(t.coarse, vv.vote) = vv.official_label as coh
         from vv join und using (doc_id) left join v_taxonomy t on t.label = vv.vote),
scored as (select c.*, coalesce(r.n, 0) as score from cand c
           left join rel r on r.annotator = c.annotator and r.coarse_label = c.official_label),
ncoh as (select doc_id, count(*) filter (where coh) as k from scored group by doc_id),
pick as (select s.doc_id, s.vote, n.k, row_number() over (partition by s.doc_id order by
           case when n.k = 0 then 0 when s.coh then 1 else 2 end,
           case when n.k >= 2 then -s.score else 0 end, s.annotator_no) as rn
         from scored s join ncoh n using (doc_id)),
gold as (select v.*, coalesce(m.maj, p.vote) as evasion_label,
           case when m.maj is not null then 'majority' when p.vote is null then 'no_vote'
                when p.k = 0 then 'fallback' when p.k = 1 then 'single_coherent' else 'reliability' end as rule
         from v_votes v left join maj m using (doc_id) left join (select * from pick where rn = 1) p using (doc_id))"""


def _gold(spark, sf, with_rule=False):
    return V.consolidate_votes(views.votes(spark, sf), with_rule=with_rule)


@query("v1_valid_votes", with_views("with " + ORACLE_VALID_VOTES + """
select doc_id, annotator_no, annotator, vote from vv""", "v_votes"))
def q_v1(spark, sf):
    return V.valid_votes(views.votes(spark, sf))


@query("v2_majority_label", with_views("with " + ORACLE_MAJORITY + """
select v.doc_id, coalesce(t.n_top, 0)::integer as n_top, m.maj as majority
from v_votes v left join tops t using (doc_id) left join maj m using (doc_id)""", "v_votes"))
def q_v2(spark, sf):
    return V.majority_label(views.votes(spark, sf)).select("doc_id", "n_top", "majority")


@query("v3_annotator_reliability", with_views("with " + ORACLE_RELIABILITY + """
select annotator_no, annotator, coarse_label, n from rel""", "v_votes", "v_coarse"))
def q_v3(spark, sf):
    return V.annotator_reliability(views.votes(spark, sf))


@query("v4_resolve_ties", with_views("with " + ORACLE_CONSOLIDATED + """
select doc_id, evasion_label as resolved, rule from gold where rule not in ('majority', 'no_vote')""",
                                     "v_votes", "v_coarse"))
def q_v4(spark, sf):
    df = views.votes(spark, sf)
    rel = V.annotator_reliability(df)
    m = V.majority_label(df).where(F.col("n_top") > 1)
    return V.resolve_ties(m, rel, rule_col="rule").select("doc_id", "resolved", "rule")


@query("v5_consolidate_votes", with_views("with " + ORACLE_CONSOLIDATED + """
select doc_id, evasion_label, rule from gold""", "v_votes", "v_coarse"))
def q_v5(spark, sf):
    return _gold(spark, sf, with_rule=True).select("doc_id", "evasion_label", "rule")


@query("v6_gold_label", with_views(r"""
with vv as (
  select doc_id, official_label, annotator_no, v as vote from (
    select doc_id, official_label, 1 as annotator_no, regexp_replace(coalesce(annotator1, 'None'), '^\s+|\s+$', '', 'g') as v from v_votes
    union all select doc_id, official_label, 2, regexp_replace(coalesce(annotator2, 'None'), '^\s+|\s+$', '', 'g') from v_votes
    union all select doc_id, official_label, 3, regexp_replace(coalesce(annotator3, 'None'), '^\s+|\s+$', '', 'g') from v_votes) u
  where v in (select label from v_taxonomy)),
vc as (select doc_id, vote, count(*) as n, min(annotator_no) as first_pos from vv group by 1, 2),
top as (select vc.*, max(n) over (partition by doc_id) as mx from vc),
cands as (select t.doc_id, t.vote, t.first_pos, tx.coarse = regexp_replace(coalesce(v.official_label, 'None'), '^\s+|\s+$', '', 'g') as coh
          from top t join v_votes v using (doc_id) left join v_taxonomy tx on tx.label = t.vote where t.n = t.mx),
pick as (select doc_id, vote, row_number() over (partition by doc_id order by
           case when cnt = 1 then 0 when coalesce(coh, false) then 0 else 1 end, first_pos) as rn
         from (select *, count(*) over (partition by doc_id) as cnt from cands) c)
select v.doc_id, coalesce(p.vote, '') as gold_label
from v_votes v left join (select * from pick where rn = 1) p using (doc_id)""", "v_votes"))
def q_v6(spark, sf):
    return V.gold_label(views.votes(spark, sf), existing=None).select("doc_id", "gold_label")


@query("p1_keep_labelled", with_views(r"""
select doc_id, regexp_replace(annotator2, '^\s+|\s+$', '', 'g') as annotator2 from v_votes
where annotator2 is not null and regexp_replace(annotator2, '^\s+|\s+$', '', 'g') <> ''""", "v_votes"))
def q_p1(spark, sf):
    return V.keep_labelled(views.votes(spark, sf), "annotator2").select("doc_id", "annotator2")


@query("p2_keep_nonnull", with_views("""
select doc_id, annotator3 as evasion_majority from v_votes where annotator3 is not null""", "v_votes"))
def q_p2(spark, sf):
    return V.keep_nonnull(views.votes(spark, sf), "annotator3", "evasion_majority").select("doc_id", "evasion_majority")


@query("p10_label_id", with_views("""
select v.doc_id, coalesce(t.pos, -100)::integer as label from v_votes v left join v_taxonomy t on t.label = v.annotator2""",
                                  "v_votes"))
def q_p10(spark, sf):
    return views.votes(spark, sf).select("doc_id", label_id("annotator2", FINE_LABELS).alias("label"))


@query("p10_label_id_by_table", with_views("""
select v.doc_id, coalesce(t.pos, -100)::integer as label from v_votes v left join v_taxonomy t on t.label = v.annotator3""", "v_votes"))
def q_p10_table(spark, sf):
    ids = views.taxonomy(spark).select("label", F.col("pos").alias("label_id"))
    return V.apply_label_ids(views.votes(spark, sf), ids, "annotator3").select("doc_id", "label")


@query("p11_coarsen", with_views("""
select v.doc_id, coalesce(a.coarse, 'PARSE_ERROR') as coarse1, coalesce(b.coarse, 'UNKNOWN') as coarse2,
       coalesce(c.coarse, v.annotator3) as coarse3
from v_votes v left join v_taxonomy a on a.label = v.annotator1 left join v_taxonomy b on b.label = v.annotator2
left join v_taxonomy c on c.label = v.annotator3""", "v_votes"))
def q_p11(spark, sf):
    return views.votes(spark, sf).select(
        "doc_id", coarsen("annotator1", "PARSE_ERROR").alias("coarse1"),
        coarsen("annotator2", "UNKNOWN").alias("coarse2"), coarsen("annotator3").alias("coarse3"))


@query("p13_select_for_task", "select doc_id, lang, n_chars from documents")
def q_p13(spark, sf):
    from answerlab.sources.tables import table
    return V.select_for_task(table(spark, sf, "documents"), ["doc_id", "lang", "n_chars", "missing_col"])


@query("p14_take_split", with_views("select doc_id, label from v_split where split = 'validation'", "v_split"))
def q_p14(spark, sf):
    return V.take_split(views.split(spark, sf), "validation").select("doc_id", "label")


# --- flagship: gold label, then how well annotator 1 matches it per coarse class

FLAGSHIP_ORACLE = with_views("with " + ORACLE_CONSOLIDATED + """,
pairs as (select coalesce(t1.coarse, g.evasion_label) as true_label, coalesce(t2.coarse, g.annotator1) as pred_label
          from gold g left join v_taxonomy t1 on t1.label = g.evasion_label left join v_taxonomy t2 on t2.label = g.annotator1
          where g.evasion_label is not null and g.annotator1 is not null),
labs as (select * from v_coarse),
per as (select l.label, l.pos,
          (select count(*) from pairs p where p.true_label = l.label and p.pred_label = l.label) as tp,
          (select count(*) from pairs p where p.true_label = l.label) as sup,
          (select count(*) from pairs p where p.pred_label = l.label) as prd from labs l),
sc as (select label, case when prd > 0 then tp / prd else 0.0 end as precision,
         case when sup > 0 then tp / sup else 0.0 end as recall,
         case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1, sup as support from per)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from sc
union all select 'accuracy', null, null, round((select avg(case when true_label = pred_label then 1.0 else 0.0 end) from pairs), 6),
  (select count(*) from pairs)
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from sc
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from sc""", "v_votes", "v_coarse")


def flagship(spark, sf):
    gold = _gold(spark, sf)
    pairs = gold.select(coarsen("evasion_label").alias("true_label"), coarsen("annotator1").alias("pred_label"))
    rep = M.class_report(pairs, COARSE_LABELS)
    return rep.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


query("m7_class_report", FLAGSHIP_ORACLE, "R")(flagship)


@query("m1_confusion_matrix", with_views("with " + ORACLE_CONSOLIDATED + """,
pairs as (select coalesce(t1.coarse, g.evasion_label) as true_label, coalesce(t2.coarse, g.annotator1) as pred_label
          from gold g left join v_taxonomy t1 on t1.label = g.evasion_label left join v_taxonomy t2 on t2.label = g.annotator1
          where g.evasion_label is not null and g.annotator1 is not null)
select a.label as true_label, b.label as pred_label,
  (select count(*) from pairs p where p.true_label = a.label and p.pred_label = b.label)::bigint as n
from v_coarse a, v_coarse b""", "v_votes", "v_coarse"))
def q_m1(spark, sf):
    gold = _gold(spark, sf)
    pairs = gold.select(coarsen("evasion_label").alias("true_label"), coarsen("annotator1").alias("pred_label"))
    return M.confusion_matrix(pairs, COARSE_LABELS)
