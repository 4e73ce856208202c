"""Queries for scoring, resume and streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from answerlab.functions.constants import COARSE_LABELS, FINE_LABELS
from answerlab.operators import scoring as SC
from answerlab.operators import stats as S
from answerlab.plans.oracle_views import with_views
from answerlab.plans.q_text import o1_sql, o3_sql, strip_sql
from answerlab.plans.registry import query
from answerlab.sources import io as IO
from answerlab.sources import views
from answerlab.sources.tables import table
from answerlab.streaming import streams as ST

REPLY_LABELS = COARSE_LABELS + FINE_LABELS
R6 = lambda c: F.round(F.col(c), 6).alias(c)


def rule_scorer(pdf: pd.DataFrame) -> pd.Series:
    """Stand-in for a model: a raw reply per answer text; fails on unreadable
    answers (those holding ``$$$``), as a real model call can."""
    t = pdf["text"].fillna("")
    if t.str.contains("$$$", regex=False).any():
        raise ValueError("unreadable answer")
    long_ = t.str.len() > 2000
    has_the = t.str.contains(" the ", regex=False)
    return pd.Series(np.where(long_, "Clear Reply", np.where(has_the, "I think: Dodging.", "non-reply")), index=pdf.index)


RAW_SQL = """case when contains(text, '$$$') then 'ERROR: unreadable answer' when length(text) > 2000 then 'Clear Reply'
  when contains(text, ' the ') then 'I think: Dodging.' else 'non-reply' end"""
C1_SQL = f"""
select doc_id, lang as true_label, raw_output,
  case when starts_with(raw_output, 'ERROR: ') then 'PARSE_ERROR' else {o1_sql('raw_output', REPLY_LABELS)} end as pred_label,
  case when length(text) > 150 then substr(text, 1, 150) else text end as answer_snippet
from (select doc_id, lang, text, {RAW_SQL} as raw_output from documents) x"""


def _scored_cols(df):
    return df.select("doc_id", F.col("lang").alias("true_label"), "raw_output", "pred_label", "answer_snippet")


@query("c1_score_table", C1_SQL)
def q_c1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return _scored_cols(SC.score_table(docs, rule_scorer, ["doc_id", "lang", "text"], REPLY_LABELS, answer="text"))


def tagged_scorer(pdf: pd.DataFrame) -> pd.Series:
    """Stand-in for a model that thinks in steps and tags its label."""
    t = pdf["text"].fillna("")
    if t.str.contains("$$$", regex=False).any():
        raise ValueError("unreadable answer")
    label = np.where(t.str.len() > 2000, "Explicit", np.where(t.str.contains(" the ", regex=False), "Dodging", "none"))
    return pd.Series([f"<step1> {len(x)} characters </step1><step2>{x[:20]}</step2><label> {y} </label>" for x, y in zip(t, label)], index=pdf.index)


TAGGED_SQL = """case when contains(text, '$$$') then 'ERROR: unreadable answer' else '<step1> ' || length(text) || ' characters </step1><step2>' ||
  substr(text, 1, 20) || '</step2><label> ' || case when length(text) > 2000 then 'Explicit' when contains(text, ' the ') then 'Dodging' else 'none' end
  || ' </label>' end"""


@query("c1_score_tagged", f"""
select doc_id, raw_output, case when starts_with(raw_output, 'ERROR: ') then 'PARSE_ERROR' else {o3_sql('raw_output', FINE_LABELS)} end as pred_label,
  case when starts_with(raw_output, 'ERROR: ') then '' else array_to_string(list_transform(
    regexp_extract_all(raw_output, '(?s)<step\\d>(.*?)</step\\d>', 1), lambda s: {strip_sql('s')}), ' | ') end as reasoning
from (select doc_id, {TAGGED_SQL} as raw_output from documents) x""")
def q_c1_tagged(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = SC.score_table(docs, tagged_scorer, ["doc_id", "text"], FINE_LABELS, tagged=True)
    return out.select("doc_id", "raw_output", "pred_label", "reasoning")


@query("c2_lexicon_label", with_views(r"""
with tok as (select doc_id, regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g') as w
             from (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as w
                   from documents) a),
s as (select doc_id, tone, sum(weight) as sc from tok join v_lexicon l on l.word = tok.w group by all),
tones as (select * from (values ('Assertive', 0), ('Guarded', 1), ('Dismissive', 2)) t(tone, pos)),
al as (select d.doc_id, t.tone, t.pos, coalesce(s.sc, 0.0) as sc from documents d cross join tones t
       left join s on s.doc_id = d.doc_id and s.tone = t.tone)
select doc_id, tone from al qualify row_number() over (partition by doc_id order by sc desc, pos) = 1""", "v_lexicon"))
def q_c2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return SC.lexicon_label(docs, "text", views.lexicon(spark), "doc_id").select("doc_id", "tone")


@query("c7_train_text_classifier", with_views("""
select r.reg_param::double as reg_param, (select count(*) from v_split where split = 'validation' and label is not null) as n_rows,
  1::bigint as n_chosen, true as beats_majority from (values (0.0), (0.01)) r(reg_param)""", "v_split"))
def q_c7(spark, sf):
    sp = views.split(spark, sf)
    train, valid = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "validation")
    weights = S.class_weights(train, S.label_map(train, "label"), "label")
    res, _ = SC.train_text_classifier(train, valid, "text", "label", weights, reg_params=(0.0, 0.01), max_iter=30)
    counts = valid.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    majority = counts.agg(F.max("n") / F.sum("n")).scalar()
    chosen = res.agg(F.count_if("chosen")).scalar()
    return res.select("reg_param", "n_rows", chosen.alias("n_chosen"), (F.col("accuracy") > majority).alias("beats_majority"))


@query("t1_pending", with_views("select doc_id from documents where doc_id not in (select doc_id from v_done)", "v_done"))
def q_t1(spark, sf):
    return SC.pending(table(spark, sf, "documents").select("doc_id"), views.done(spark, sf), ["doc_id"])


@query("t2_is_complete", with_views("""
select (select count(*) from v_done) as n_done, (select count(*) from documents) as n_input,
  (select count(*) from v_done) = (select count(*) from documents) as complete""", "v_done"))
def q_t2(spark, sf):
    return SC.is_complete(views.done(spark, sf), table(spark, sf, "documents"))


def _files(df, least):
    """Files that a table arrives in: one for each task of its scan, ``least`` at least, so
    that a file does not grow with the table."""
    return max(least, df.rdd.getNumPartitions())


@query("t3_score_stream", C1_SQL)
def q_t3(spark, sf):
    src, sink, ckpt = (IO.scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files = _files(docs, 4)
    docs.repartition(files, "doc_id").write.parquet(src)  # the incoming files, in two batches
    ST.score_stream(spark, src, docs.schema, rule_scorer, ["doc_id", "lang", "text"], REPLY_LABELS, sink, ckpt,
                    max_files_per_trigger=-(-files // 2), answer="text")
    return _scored_cols(spark.read.parquet(sink))


T4_SQL = with_views("""
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, true_label, pred_label, count(*) as n
from v_scored_events group by all""", "v_scored_events")


@query("t4_confusion_by_window", T4_SQL)
def q_t4_batch(spark, sf):
    return ST.batch_window_confusion(views.scored_events(spark, sf))


@query("t4_stream_confusion", T4_SQL)
def q_t4(spark, sf):
    changes, ckpt = IO.scratch_path(spark, "confusion-changes"), IO.scratch_path(spark, "confusion-ckpt")
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    shift = F.create_map(*[F.lit(x) for kv in (("view", "click"), ("click", "purchase"), ("purchase", "signup"),
                                               ("signup", "error"), ("error", "view")) for x in kv])
    scored = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("true_label"),
                           F.when(F.col("event_id") % 4 == 0, shift[F.col("event_type")])
                           .otherwise(F.col("event_type")).alias("pred_label"))
    ST.run_window_confusion(ST.window_confusion(scored), changes, ckpt)
    return ST.current_counts(spark, changes)


LATE_SQL = with_views("""
with e as (select event_id, epoch_us(ts) as t, ts, true_label, pred_label from v_scored_events),
b as (select min(t) as lo, max(t) as hi from e),
f as (select e.*, case least(3, ((t - lo) * 4) // greatest(1, hi - lo)) when 1 then 2 when 2 then 1 else least(3, ((t - lo) * 4) // greatest(1, hi - lo)) end as arrival
      from e, b),
m as (select a.arrival, max(o.ts) - interval 1 day as mark from (select distinct arrival from f) a left join f o on o.arrival < a.arrival group by a.arrival)
select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, true_label, pred_label,
  count(*) filter (where not coalesce(date_trunc('day', ts) + interval 1 day <= mark, false)) as n_kept,
  count(*) filter (where coalesce(date_trunc('day', ts) + interval 1 day <= mark, false)) as n_late
from f join m using (arrival) group by all""", "v_scored_events")


@query("t4_kept_and_late", LATE_SQL)
def q_t4_late(spark, sf):
    """The events in four files by time, of which the second and third arrive in
    the wrong order."""
    names = ("late-src", "late-changes", "late-rows", "late-marks", "late-ckpt")
    src, changes, late, marks, ckpt = (IO.scratch_path(spark, n) for n in names)
    events = views.scored_events(spark, sf)
    ends = events.agg(F.struct(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi"))).scalar()
    parts = events.withColumn("_e", ends).withColumn("_part", F.expr(
        "least(3L, ((unix_micros(ts) - _e.lo) * 4) div greatest(1L, _e.hi - _e.lo))")).drop("_e")
    for i in (0, 2, 1, 3):
        parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.run_counted_confusion(stream, changes, late, marks, ckpt)
    return ST.kept_and_late(spark, changes, late)


@query("t3_score_stream_by_key", C1_SQL)
def q_t3_key(spark, sf):
    """Every document arrives in two files; a first half was scored before."""
    src, sink, ckpt, old = (IO.scratch_path(spark, n) for n in ("stream-src", "stream-sink", "stream-ckpt", "stream-old"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    keep = ["doc_id", "lang", "text"]
    SC.score_table(docs.where("doc_id % 2 = 0"), rule_scorer, keep, REPLY_LABELS, "text").write.parquet(old)
    files = _files(docs, 2)
    for _ in range(2):
        docs.repartition(files, "doc_id").write.mode("append").parquet(src)
    done = spark.read.parquet(old)
    ST.score_stream(spark, src, docs.schema, rule_scorer, keep, REPLY_LABELS, sink, ckpt, max_files_per_trigger=files, answer="text",
                    keys=["doc_id"], done=done)
    return _scored_cols(done.unionByName(spark.read.parquet(sink)))
