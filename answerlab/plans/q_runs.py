"""Queries for sources/sinks and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.operators import measures as M
from answerlab.operators import runs as RU
from answerlab.plans.oracle_views import with_views
from answerlab.plans.registry import query
from answerlab.sources import io as IO
from answerlab.sources import views
from answerlab.sources.tables import table

LANGS = ["de", "en", "es", "fr"]
R6 = lambda c: F.round(F.col(c), 6).alias(c)
HASH = "('0x' || substr(md5(cast(doc_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@query("s1_read_examples", "select doc_id, lang, n_chars from documents")
def q_s1(spark, sf):
    return IO.read_examples(spark, f"{sf}/documents.parquet", DOC_SCHEMA).select("doc_id", "lang", "n_chars")


def _pred_rows(spark, sf):
    p = views.predictions(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return (p.join(d, "doc_id")
            .select(F.col("source").alias("question"), F.substring("text", 1, 150).alias("answer_snippet"),
                    "true_label", "pred_label", F.concat(F.lit("reply:\n\"raw\" "), "pred_label").alias("raw_output"),
                    F.col("source").alias("run_id"), "doc_id"))


@query("s3_read_predictions", with_views("""
select d.source as question, substr(d.text, 1, 150) as answer_snippet, p.true_label, p.pred_label,
  'reply:' || chr(10) || '"raw" ' || p.pred_label as raw_output
from v_predictions p join documents d using (doc_id)""", "v_predictions"))
def q_s3(spark, sf):
    path = IO.scratch_path(spark, "predictions-csv")
    IO.write_predictions(_pred_rows(spark, sf).drop("run_id", "doc_id"), path, fmt="csv", partition_by=None)
    return IO.read_predictions(spark, path)


@query("s4_write_predictions", with_views("""
select p.doc_id, p.true_label, p.pred_label, d.source as run_id from v_predictions p join documents d using (doc_id)""",
                                          "v_predictions"))
def q_s4(spark, sf):
    path = IO.scratch_path(spark, "predictions-parquet")
    IO.write_predictions(_pred_rows(spark, sf).select("doc_id", "true_label", "pred_label", "run_id"), path)
    return spark.read.parquet(path).select("doc_id", "true_label", "pred_label", "run_id")


@query("s6_append_scored", with_views("""
select doc_id, pred_label from v_predictions union all select doc_id, pred_label from v_predictions""", "v_predictions"))
def q_s6(spark, sf):
    path = IO.scratch_path(spark, "scored")
    rows = views.predictions(spark, sf).select("doc_id", "pred_label")
    IO.append_scored(rows, path)
    IO.append_scored(rows, path)
    return spark.read.parquet(path)


# --- run records derived from the predictions: one run per source --------------

RUNS_SQL = f"""
d as (select p.doc_id, p.true_label, p.pred_label, s.source,
        case when {HASH.replace('doc_id', 'p.doc_id')} < 0.2 then 'validation' else 'train' end as split
      from v_predictions p join documents s using (doc_id)),
pc as (select source, split, true_label, pred_label, count(*) as n from d group by all),
labs as (select * from (values ('de'), ('en'), ('es'), ('fr')) t(label)),
grp as (select distinct source, split from pc),
per as (select g.source, g.split, l.label,
          coalesce(sum(case when pc.true_label = l.label and pc.pred_label = l.label then n end), 0) as tp,
          coalesce(sum(case when pc.true_label = l.label then n end), 0) as sup,
          coalesce(sum(case when pc.pred_label = l.label then n end), 0) as prd
        from grp g cross join labs l left join pc on pc.source = g.source and pc.split = g.split group by all),
sc as (select *, case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1 from per),
m as (select source, split, avg(f1) as macro_f1, sum(f1 * sup) / sum(sup) as weighted_f1 from sc group by all),
acc as (select source, split, sum(case when true_label = pred_label then n else 0 end) / sum(n) as accuracy,
          sum(n) as n_rows from pc group by all),
runs as (select t.source as model_key, cast(substr(t.source, 4) as integer) as k,
           case when cast(substr(t.source, 4) as integer) % 2 = 0 then 'smart_resampling' else '' end as bal_name,
           case when cast(substr(t.source, 4) as integer) % 3 = 0 then 'tone_analysis' else '' end as aug_name,
           case when cast(substr(t.source, 4) as integer) % 2 = 0 then 'ce' else 'focal' end as loss_name,
           case when cast(substr(t.source, 4) as integer) % 2 = 0 then 'coarse' else 'evasion' end as task,
           ta.accuracy as test_accuracy,
           case when cast(substr(t.source, 4) as integer) % 7 = 3 then null else t.macro_f1 end as test_macro_f1,
           t.weighted_f1 as test_weighted_f1, v.macro_f1 as val_macro_f1, ta.n_rows as train_size
         from m t join acc ta on ta.source = t.source and ta.split = t.split
         left join m v on v.source = t.source and v.split = 'validation'
         where t.split = 'train'),
named as (select *, concat_ws('__', case when task = 'coarse' then 'c' else 'e' end, model_key, bal_name, aug_name, loss_name)
            as run_name from runs)"""


def run_metrics(spark, sf):
    """Per source: test measures on the train part, val macro F1 on the
    validation part, settings derived from the source number."""
    p = views.predictions(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "source")
    rows = p.join(d, "doc_id").withColumn("split", F.when(views.split_hash(F.col("doc_id")) < 0.2, "validation")
                                          .otherwise("train"))
    m = M.metrics_row(rows, LANGS, by=["source", "split"])
    tr = m.where(F.col("split") == "train").select(
        "source", F.col("accuracy").alias("test_accuracy"), F.col("macro_f1").alias("test_macro_f1"),
        F.col("weighted_f1").alias("test_weighted_f1"), F.col("n_rows").alias("train_size"))
    va = m.where(F.col("split") == "validation").select("source", F.col("macro_f1").alias("val_macro_f1"))
    k = F.substring("source", 4, 10).cast("int")
    return (tr.join(va, "source", "left").select(
        F.col("source").alias("model_key"),
        F.when(k % 2 == 0, "smart_resampling").otherwise("").alias("bal_name"),
        F.when(k % 3 == 0, "tone_analysis").otherwise("").alias("aug_name"),
        F.when(k % 2 == 0, "ce").otherwise("focal").alias("loss_name"),
        F.struct(F.col("source").alias("model_id"), F.lit(512).cast("long").alias("max_length"),
                 F.lit(5).cast("long").alias("num_epochs"), F.lit(2.0).alias("focal_gamma"),
                 F.when(k % 2 == 0, "coarse").otherwise("evasion").alias("task"),
                 F.col("train_size").cast("long").alias("train_size")).alias("extra"),
        "test_accuracy", F.when(k % 7 == 3, F.lit(None).cast("double")).otherwise(F.col("test_macro_f1")).alias("test_macro_f1"),
        "test_weighted_f1", "val_macro_f1"))


def _written_runs(spark, sf):
    path = IO.scratch_path(spark, "runs")
    records = IO.run_records(run_metrics(spark, sf))
    IO.write_runs(records.withColumn("loss_name", F.lit("old")), path)
    IO.write_runs(records, path)  # the same names: the first records go
    return IO.read_runs(spark, path, "test_macro_f1").withColumn(
        "run_name", F.concat_ws("__", F.when(F.col("extra.task") == "coarse", "c").otherwise("e"),
                                "model_key", "bal_name", "aug_name", "loss_name"))


@query("s5_write_run", with_views(f"""
with {RUNS_SQL.strip()}
select run_name, model_key, round(test_macro_f1, 6) as test_macro_f1, round(val_macro_f1, 6) as val_macro_f1,
  train_size::bigint as train_size, test_macro_f1 is null as missing_test_macro_f1 from named""", "v_predictions"), "R")
def q_s5(spark, sf):
    return _written_runs(spark, sf).select("run_name", "model_key", F.round(F.col("metrics")["test_macro_f1"], 6).alias("test_macro_f1"),
                      F.round(F.col("metrics")["val_macro_f1"], 6).alias("val_macro_f1"),
                      F.col("extra.train_size").alias("train_size"),
                      (~F.map_contains_key("metrics", "test_macro_f1")).alias("missing_test_macro_f1"))


@query("s2_read_runs", with_views(f"""
with {RUNS_SQL.strip()}
select run_name, model_key, bal_name, aug_name, loss_name, task, round(coalesce(test_macro_f1, 0.0), 6) as sort_value from named""",
                                  "v_predictions"), "R")
def q_s2(spark, sf):
    r = _written_runs(spark, sf)
    return r.select("run_name", "model_key", "bal_name", "aug_name", "loss_name", F.col("extra.task").alias("task"),
                    F.round(F.coalesce(F.col("metrics")["test_macro_f1"], F.lit(0.0)), 6).alias("sort_value"))


MEASURES = ["test_macro_f1", "test_weighted_f1", "test_accuracy", "val_macro_f1"]


@query("m15_leaderboard", with_views(f"""
with {RUNS_SQL.strip()}
select run_name, model_key as model, task, bal_name as balancing, aug_name as augmentation, loss_name as loss,
  round(test_macro_f1, 4) as test_macro_f1, round(test_weighted_f1, 4) as test_weighted_f1,
  round(test_accuracy, 4) as test_accuracy, round(val_macro_f1, 4) as val_macro_f1 from named""", "v_predictions"), "R")
def q_m15(spark, sf):
    return RU.leaderboard(_written_runs(spark, sf), MEASURES)


SUMMARY_SQL = """
d as (select p.true_label, p.pred_label, s.source, s.lang as task from v_predictions p join documents s using (doc_id)),
pc as (select task, source, true_label, pred_label, count(*) as n from d group by all),
sm as (select task, source as strategy, cast(substr(source, 4) as integer) as position,
         sum(case when true_label = pred_label then n else 0 end) / sum(n) as accuracy from pc group by all)"""


def _summary(spark, sf):
    p = views.predictions(spark, sf)
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("task"))
    s = RU.experiment_summary(p.join(d, "doc_id"), ["task", "source"], LANGS)
    return s.select("task", F.col("source").alias("strategy"),
                    F.substring("source", 4, 10).cast("int").alias("position"), "accuracy")


@query("s8_experiment_summary", with_views("""
with pc as (select source, true_label, pred_label, count(*) as n from v_predictions p join documents d using (doc_id) group by all),
labs as (select * from (values ('de'), ('en'), ('es'), ('fr')) t(label)),
grp as (select distinct source from pc),
per as (select g.source, l.label,
          coalesce(sum(case when pc.true_label = l.label and pc.pred_label = l.label then n end), 0) as tp,
          coalesce(sum(case when pc.true_label = l.label then n end), 0) as sup,
          coalesce(sum(case when pc.pred_label = l.label then n end), 0) as prd
        from grp g cross join labs l left join pc on pc.source = g.source group by all),
sc as (select *, case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1 from per)
select s.source, round(avg(f1), 6) as macro_f1, round(sum(f1 * sup) / sum(sup), 6) as weighted_f1,
  round((select sum(case when true_label = pred_label then n else 0 end) / sum(n) from pc where pc.source = s.source), 6) as accuracy,
  (select sum(n) from pc where pc.source = s.source)::bigint as n_total,
  (select coalesce(sum(n), 0) from pc where pc.source = s.source and pred_label = 'PARSE_ERROR')::bigint as n_parse_errors
from sc s group by s.source""", "v_predictions"), "R")
def q_s8(spark, sf):
    p = views.predictions(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    s = RU.experiment_summary(p, ["source"], LANGS)
    RU.write_summary_csv(s, IO.scratch_path(spark, "summary-csv"))
    return s.select("source", R6("macro_f1"), R6("weighted_f1"), R6("accuracy"), "n_total", "n_parse_errors")


@query("m16_best_per_task", with_views(f"""
with {SUMMARY_SQL.strip()}
select task, strategy, round(accuracy, 6) as accuracy from sm
qualify row_number() over (partition by task order by accuracy desc, position) = 1""", "v_predictions"), "R")
def q_m16(spark, sf):
    return M.best_per_task(_summary(spark, sf), "accuracy").select("task", "strategy", R6("accuracy"))


@query("m17_task_gap", with_views(f"""
with {SUMMARY_SQL.strip()},
w as (select strategy, min(position) as position,
        max(case when task = 'de' then accuracy end) as de, max(case when task = 'en' then accuracy end) as en,
        max(case when task = 'es' then accuracy end) as es, max(case when task = 'fr' then accuracy end) as fr
      from sm group by strategy)
select strategy, round(de, 6) as de, round(en, 6) as en, round(es, 6) as es, round(fr, 6) as fr,
  round(fr - de, 6) as gap, round(de - lag(de) over (order by position), 6) as gain from w""", "v_predictions"), "R")
def q_m17(spark, sf):
    g = M.task_gap(_summary(spark, sf), "accuracy", LANGS)
    return g.select("strategy", *[R6(t) for t in LANGS], R6("gap"), R6("gain"))


GRID = RU.run_grid(["distilbert", "roberta"], ["", "tone_analysis"], ["ce", "focal"])


@query("c6_run_grid", with_views(f"""
with g as (select * from (values {', '.join(f"({i}, '{m}', '{b}', '{a}', '{lo}')" for i, m, b, a, lo in GRID)})
             t(run_id, model_key, bal_name, aug_name, loss_name)),
pc as (select doc_id % {len(GRID)} as run_id, true_label, pred_label, count(*) as n from v_predictions group by all),
labs as (select * from (values ('de'), ('en'), ('es'), ('fr')) t(label)),
per as (select g.run_id, l.label,
          coalesce(sum(case when pc.true_label = l.label and pc.pred_label = l.label then n end), 0) as tp,
          coalesce(sum(case when pc.true_label = l.label then n end), 0) as sup,
          coalesce(sum(case when pc.pred_label = l.label then n end), 0) as prd
        from g cross join labs l left join pc on pc.run_id = g.run_id group by all),
sc as (select *, case when sup + prd > 0 then 2.0 * tp / (sup + prd) else 0.0 end as f1 from per)
select g.run_id::integer as run_id, g.model_key, g.bal_name, g.aug_name, g.loss_name,
  (select sum(n) from pc where pc.run_id = g.run_id)::bigint as n_rows,
  round((select sum(case when true_label = pred_label then n else 0 end) / sum(n) from pc where pc.run_id = g.run_id), 6) as accuracy,
  round((select avg(f1) from sc where sc.run_id = g.run_id), 6) as macro_f1
from g""", "v_predictions"), "R")
def q_c6(spark, sf):
    p = views.predictions(spark, sf).withColumn("run_id", (F.col("doc_id") % len(GRID)).cast("int"))
    m = M.metrics_row(p, LANGS, by=["run_id"])
    grid = spark.range(1).select(F.inline(RU.grid_column(GRID)))
    return grid.join(m, "run_id", "left").select("run_id", "model_key", "bal_name", "aug_name", "loss_name",
                                                  "n_rows", R6("accuracy"), R6("macro_f1"))

