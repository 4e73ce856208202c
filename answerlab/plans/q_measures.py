"""Queries for measures and losses (M2-M6, M8-M14, M18, and lineitem-scale M1/M3/M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions.labels import coarsen
from answerlab.operators import losses as LS
from answerlab.operators import measures as M
from answerlab.operators import votes as V
from answerlab.plans.oracle_views import with_views
from answerlab.plans.q_votes import ORACLE_CONSOLIDATED
from answerlab.plans.registry import query
from answerlab.sources import views
from answerlab.sources.tables import table

LANGS = ["de", "en", "es", "fr"]
R6 = lambda c: F.round(F.col(c), 6).alias(c)

PC_SQL = """
pc as (select true_label, pred_label, count(*) as n from v_predictions
       where true_label is not null and pred_label is not null group by 1, 2),
labs as (select * from (values ('de'), ('en'), ('es'), ('fr')) t(label)),
per as (select l.label,
          coalesce((select sum(n) from pc where true_label = l.label and pred_label = l.label), 0) as tp,
          coalesce((select sum(n) from pc where true_label = l.label), 0) as sup,
          coalesce((select sum(n) from pc where pred_label = l.label), 0) as prd from labs l),
sc as (select label, case when prd > 0 then tp / prd else 0.0 end as precision,
         case when sup > 0 then tp / sup else 0.0 end as recall,
         case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1, sup as support from per)"""


@query("m2_confusion_normalised", with_views("""
with pc as (select true_label, pred_label, count(*) as n from v_predictions group by 1, 2),
labs as (select * from (values ('de'), ('en'), ('es'), ('fr')) t(label)),
cm as (select a.label as true_label, b.label as pred_label, coalesce(pc.n, 0)::bigint as n
       from labs a cross join labs b left join pc on pc.true_label = a.label and pc.pred_label = b.label)
select true_label, pred_label, n, round(n / greatest(sum(n) over (partition by true_label), 1), 6) as share from cm""",
                                             "v_predictions"), "R")
def q_m2(spark, sf):
    cm = M.confusion_matrix(views.predictions(spark, sf), LANGS)
    return M.confusion_normalised(cm).select("true_label", "pred_label", "n", R6("share"))


@query("m3_per_class", with_views("with " + PC_SQL.strip() + """
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from sc""",
                                  "v_predictions"), "R")
def q_m3(spark, sf):
    pc = M.per_class(views.predictions(spark, sf), LANGS)
    return pc.select("label", R6("precision"), R6("recall"), R6("f1"), "support")


@query("m4_accuracy", with_views("""
select round(avg(case when true_label = pred_label then 1.0 else 0.0 end), 6) as accuracy from v_predictions""",
                                 "v_predictions"), "R")
def q_m4(spark, sf):
    return M.accuracy(views.predictions(spark, sf)).select(R6("accuracy"))


@query("m5_macro_f1", with_views("with " + PC_SQL.strip() + """,
seen as (select distinct label from (select true_label as label from pc union select pred_label from pc) x),
per2 as (select s.label, coalesce((select sum(n) from pc where true_label = s.label and pred_label = s.label), 0) as tp,
           coalesce((select sum(n) from pc where true_label = s.label), 0) as sup,
           coalesce((select sum(n) from pc where pred_label = s.label), 0) as prd from seen s)
select 'listed' as labels, round((select avg(f1) from sc), 6) as macro_f1
union all select 'seen', round((select avg(case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end) from per2), 6)""",
                                 "v_predictions"), "R")
def q_m5(spark, sf):
    p = views.predictions(spark, sf)
    a = M.macro_f1(p, LANGS).select(F.lit("listed").alias("labels"), R6("macro_f1"))
    b = M.macro_f1(p).select(F.lit("seen").alias("labels"), R6("macro_f1"))
    return a.unionByName(b)


@query("m6_weighted_f1", with_views("with " + PC_SQL.strip() + """
select round(sum(f1 * support) / sum(support), 6) as weighted_f1 from sc""", "v_predictions"), "R")
def q_m6(spark, sf):
    return M.weighted_f1(views.predictions(spark, sf), LANGS).select(R6("weighted_f1"))


@query("m8_dual_level_metrics", with_views("with " + ORACLE_CONSOLIDATED + """,
pairs as (select evasion_label as t, annotator1 as p from gold where evasion_label is not null and annotator1 is not null),
lv as (select 'fine' as level, t, p from pairs
       union all select 'coarse', a.coarse, b.coarse from pairs left join v_taxonomy a on a.label = pairs.t
       left join v_taxonomy b on b.label = pairs.p),
labs as (select 'fine' as level, label from v_taxonomy union all select 'coarse', label from v_coarse),
per as (select l.level, l.label,
          (select count(*) from lv where lv.level = l.level and t = l.label and p = l.label) as tp,
          (select count(*) from lv where lv.level = l.level and t = l.label) as sup,
          (select count(*) from lv where lv.level = l.level and p = l.label) as prd from labs l),
sc as (select level, label, case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1, sup from per)
select s.level, (select count(*) from lv where lv.level = s.level and t is not null and p is not null) as n_rows,
  round((select avg(case when t = p then 1.0 else 0.0 end) from lv where lv.level = s.level and t is not null and p is not null), 6) as accuracy,
  round(avg(f1), 6) as macro_f1, round(sum(f1 * sup) / sum(sup), 6) as weighted_f1,
  (select count(*) from lv where lv.level = s.level and (t is null or p is null)) as n_unmapped
from sc s group by s.level""", "v_votes", "v_coarse"), "R")
def q_m8(spark, sf):
    gold = V.consolidate_votes(views.votes(spark, sf))
    pairs = gold.select(F.col("evasion_label").alias("true_label"), F.col("annotator1").alias("pred_label"))
    return M.dual_level_metrics(pairs).select("level", "n_rows", R6("accuracy"), R6("macro_f1"), R6("weighted_f1"),
                                              "n_unmapped")


@query("m9_drop_ignored", with_views("select doc_id, label_id from v_logits where label_id <> -100", "v_logits"))
def q_m9(spark, sf):
    return M.drop_ignored(views.logits(spark, sf)).select("doc_id", "label_id")


@query("m10_drop_parse_errors", with_views("""
select doc_id, true_label, pred_label from v_predictions where pred_label <> 'PARSE_ERROR'""", "v_predictions"))
def q_m10(spark, sf):
    return M.drop_parse_errors(views.predictions(spark, sf))


LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))))"
CE = f"({LSE} - logits[label_id + 1])"
W_SQL = """
w as (select label_id, count(*) as n from v_logits where label_id <> -100 group by label_id),
wt as (select label_id, (select sum(n) from w) / ((select count(*) from w) * n) as weight from w)"""


@query("m11_cross_entropy", with_views(f"""
select round(avg({CE}), 6) as loss from v_logits where label_id <> -100""", "v_logits"), "R")
def q_m11(spark, sf):
    return LS.cross_entropy(views.logits(spark, sf)).select(R6("loss"))


@query("m12_weighted_ce", with_views(f"""
with {W_SQL.strip()}
select round(sum(wt.weight * {CE}) / sum(wt.weight), 6) as loss from v_logits v join wt using (label_id)""", "v_logits"), "R")
def q_m12(spark, sf):
    lg = views.logits(spark, sf)
    return LS.weighted_ce(lg).select(R6("loss"))


@query("m13_focal_loss", with_views(f"""
with {W_SQL.strip()}
select round(coalesce(avg(wt.weight * pow(1 - exp(-{CE}), 2.0) * {CE}), 0.0), 6) as loss
from v_logits v join wt using (label_id)""", "v_logits"), "R")
def q_m13(spark, sf):
    lg = views.logits(spark, sf)
    return LS.focal_loss(lg, None, 2.0, balanced=True).select(R6("loss"))


@query("m14_smoothed_ce", with_views(f"""
select round(coalesce(avg(0.9 * {CE} + 0.1 * ({LSE} - list_sum(logits) / length(logits))), 0.0), 6) as loss
from v_logits where label_id <> -100""", "v_logits"), "R")
def q_m14(spark, sf):
    return LS.smoothed_ce(views.logits(spark, sf), 0.1).select(R6("loss"))


@query("m18_top_classes", with_views("with " + PC_SQL.strip() + """
select label, round(f1, 6) as f1 from sc order by f1 desc, label limit 2""", "v_predictions"), "R")
def q_m18(spark, sf):
    return M.top_classes(views.predictions(spark, sf), 2, LANGS).select("label", R6("f1"))


# --- lineitem scale: truth = return flag, prediction derived from the line status

FLAGS = ["A", "N", "R"]
LI_PRED_SQL = "case when l_linestatus = 'O' then 'N' when l_quantity > 25 then 'A' else 'R' end"


def _li_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return li.select(F.col("l_returnflag").alias("true_label"), pred.alias("pred_label"))


_LI_PC = f"""
pc as (select l_returnflag as true_label, {LI_PRED_SQL} as pred_label, count(*) as n from lineitem group by 1, 2),
labs as (select * from (values ('A'), ('N'), ('R')) t(label)),
per as (select l.label, coalesce((select sum(n) from pc where true_label = l.label and pred_label = l.label), 0) as tp,
          coalesce((select sum(n) from pc where true_label = l.label), 0) as sup,
          coalesce((select sum(n) from pc where pred_label = l.label), 0) as prd from labs l),
sc as (select label, case when prd > 0 then tp / prd else 0.0 end as precision, case when sup > 0 then tp / sup else 0.0 end as recall,
         case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1, sup as support from per)"""


@query("m1_confusion_lineitem", f"""
with pc as (select l_returnflag as true_label, {LI_PRED_SQL} as pred_label, count(*) as n from lineitem group by 1, 2),
labs as (select * from (values ('A'), ('N'), ('R')) t(label))
select a.label as true_label, b.label as pred_label, coalesce(pc.n, 0)::bigint as n
from labs a cross join labs b left join pc on pc.true_label = a.label and pc.pred_label = b.label""")
def q_m1_li(spark, sf):
    return M.confusion_matrix(_li_pairs(spark, sf), FLAGS)


@query("m7_class_report_lineitem", f"""
with {_LI_PC.strip()}
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support::bigint as support from sc
union all select 'accuracy', null, null, round((select sum(tp) from per) / (select sum(n) from pc), 6), (select sum(n) from pc)::bigint
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from sc
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from sc""", "R")
def q_m7_li(spark, sf):
    rep = M.class_report(_li_pairs(spark, sf), FLAGS)
    return rep.select("label", R6("precision"), R6("recall"), R6("f1"), "support")


@query("m8_dual_level_lineitem", f"""
with {_LI_PC.strip()}
select round((select sum(tp) from per) / (select sum(n) from pc), 6) as accuracy, round(avg(f1), 6) as macro_f1,
  round(sum(f1 * support) / sum(support), 6) as weighted_f1, (select sum(n) from pc)::bigint as n_rows from sc""", "R")
def q_m8_li(spark, sf):
    return M.metrics_row(_li_pairs(spark, sf), FLAGS).select("n_rows", R6("accuracy"), R6("macro_f1"), R6("weighted_f1"))


@query("m1_confusion_wide", with_views("""
with pc as (select true_label, pred_label from v_predictions)
select l.label as true_label,
  count(*) filter (where pc.pred_label = 'de') as de, count(*) filter (where pc.pred_label = 'en') as en,
  count(*) filter (where pc.pred_label = 'es') as es, count(*) filter (where pc.pred_label = 'fr') as fr
from (values ('de'), ('en'), ('es'), ('fr')) l(label) left join pc on pc.true_label = l.label group by l.label""",
                                       "v_predictions"))
def q_m1_wide(spark, sf):
    cm = M.confusion_matrix(views.predictions(spark, sf), LANGS)
    return M.confusion_wide(cm, LANGS)


@query("p11_m1_coarse_confusion", with_views("""
with p as (select coalesce(a.coarse, 'PARSE_ERROR') as t, coalesce(b.coarse, 'PARSE_ERROR') as pr
           from v_votes v left join v_taxonomy a on a.label = v.annotator1 left join v_taxonomy b on b.label = v.annotator3)
select t as true_label, pr as pred_label, count(*) as n from p group by 1, 2""", "v_votes"))
def q_p11_m1(spark, sf):
    v = views.votes(spark, sf)
    return M.pair_counts(v.select(coarsen("annotator1", "PARSE_ERROR").alias("t"),
                                  coarsen("annotator3", "PARSE_ERROR").alias("p")), "t", "p")
