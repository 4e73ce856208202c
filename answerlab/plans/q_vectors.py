"""Queries for exemplars, vectors, retrieval and prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions.labels import argmax
from answerlab.operators import neighbours as N
from answerlab.operators import prompts as P
from answerlab.operators import vector_index as VI
from answerlab.plans.oracle_views import with_views
from answerlab.plans.q_votes import ORACLE_CONSOLIDATED
from answerlab.plans.registry import query
from answerlab.sources import views
from answerlab.sources.tables import table

HASH = "('0x' || substr(md5(cast(doc_id as varchar) || '|42'), 1, 8))::bigint / 4294967296.0"
EX_CTE = ORACLE_CONSOLIDATED + f""",
ex as (select d.doc_id, 'What does ' || d.source || ' say?' as question, d.text as answer, d.lang, g.evasion_label,
         g.official_label, case when {HASH.replace('doc_id', 'd.doc_id')} < 0.2 then 'validation' else 'train' end as split
       from documents d join gold g using (doc_id))"""


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def ex_sql(body: str, *more: str) -> str:
    return with_views("with " + EX_CTE + ",\n" + body.strip(), "v_votes", "v_coarse", *more)


def _train_examples(spark, sf):
    return views.examples(spark, sf).where(F.col("split") == "train")


# --- fixed values: example prompt texts for the prompt-table queries (our own wording) ---
HEADER = "Classify the answer. Similar labelled examples follow.\n\n"
TAIL = "Now classify the following question-answer pair:"
TEMPLATES = [("zero_shot", "Classify the answer into one of the given classes."),
             ("with_steps", "Think in steps, then give the class inside <label></label>.")]
TUNING_SYSTEM = "Label the answer with one evasion class."


@query("x1_median_exemplar", ex_sql("""
b as (select doc_id, length(answer)::integer as length from ex where split = 'train' and official_label = 'Clear Reply'),
m as (select quantile_cont(length, 0.5) as median from b)
select doc_id, length, median from b, m order by abs(length - median), doc_id limit 1"""), "R")
def q_x1(spark, sf):
    tr = _train_examples(spark, sf).where(F.col("official_label") == "Clear Reply")
    return N.median_exemplar(tr, "answer", "doc_id")


_X2_SQL = """
b as (select 'coarse' as level, official_label as label, doc_id, length(answer)::integer as length from ex where split = 'train'
      union all select 'evasion', evasion_label, doc_id, length(answer)::integer from ex where split = 'train' and evasion_label is not null),
m as (select level, label, quantile_cont(length, 0.5) as median from b group by level, label),
x2 as (select b.level, b.label, b.doc_id, b.length, m.median from b join m using (level, label)
       qualify row_number() over (partition by b.level, b.label order by abs(b.length - m.median), b.doc_id) = 1)"""


def _x2(spark, sf):
    return N.exemplars_by_level(_train_examples(spark, sf), "answer", "doc_id", {"coarse": "official_label", "evasion": "evasion_label"})


@query("x2_exemplar_per_label", ex_sql(_X2_SQL + "\nselect level, label, doc_id, length, median from x2"), "R")
def q_x2(spark, sf):
    return _x2(spark, sf).select("level", "label", "doc_id", "length", "median")


@query("x3_collapse_exemplars", ex_sql(_X2_SQL + """,
f as (select t.coarse, x2.doc_id, row_number() over (partition by t.coarse order by t.pos) as r
      from x2 join v_taxonomy t on t.label = x2.label where x2.level = 'evasion'),
found as (select coarse, doc_id, 'fine' as source from f where r = 1)
select * from found union all
select x2.label as coarse, x2.doc_id, 'coarse' from x2 where x2.level = 'coarse' and x2.label not in (select coarse from found)"""))
def q_x3(spark, sf):
    return N.collapse_stacked(_x2(spark, sf), "doc_id", fine_level="evasion")


@query("x4_one_shot_fine_label", ex_sql("""
firsts as (select coarse, label from v_taxonomy qualify row_number() over (partition by coarse order by pos) = 1)
select ex.doc_id, ex.official_label, f.label as fine_label from ex left join firsts f on f.coarse = ex.official_label"""))
def q_x4(spark, sf):
    ex = views.examples(spark, sf)
    return ex.select("doc_id", "official_label", N.one_shot_fine_label(F.col("official_label")).alias("fine_label"))


@query("x13_fine_exemplar_per_coarse", ex_sql(_X2_SQL + """,
f as (select t.coarse, x2.label, x2.doc_id, row_number() over (partition by t.coarse order by t.pos) as r
      from x2 join v_taxonomy t on t.label = x2.label where x2.level = 'evasion'),
found as (select coarse, label, doc_id from f where r = 1),
firsts as (select coarse, label from v_taxonomy qualify row_number() over (partition by coarse order by pos) = 1)
select * from found union all
select x2.label as coarse, fi.label, x2.doc_id from x2 join firsts fi on fi.coarse = x2.label
where x2.level = 'coarse' and x2.label not in (select coarse from found)"""))
def q_x13(spark, sf):
    return N.fine_stacked(_x2(spark, sf), "doc_id", fine_level="evasion")


@query("x5_normalise_vectors", """
select vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as norm, round(v[1], 6) as x1
from (select vec_id, case when n > 0 then list_transform(e, lambda x: x / n) else list_transform(e, lambda x: 0.0) end as v
      from (select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n
            from embeddings) a) b""", "R")
def q_x5(spark, sf):
    e = N.normalise_vectors(table(spark, sf, "embeddings"), "embedding", "unit")
    return e.select("vec_id", F.round(N.norm(F.col("unit")), 6).alias("norm"), F.round(F.col("unit")[0], 6).alias("x1"))


DOT = "round(list_inner_product(q.embedding::double[], c.embedding::double[]), 6)"


@query("x6_nearest_neighbours", with_views(f"""
select q.vec_id as query_id, c.vec_id as corpus_id, {DOT} as score,
  (row_number() over (partition by q.vec_id order by {DOT} desc, c.vec_id))::integer as rank
from v_vectors_q q, v_vectors_c c qualify rank <= 5""", "v_vectors_q", "v_vectors_c"), "R")
def q_x6(spark, sf):
    return N.nearest_neighbours(views.vectors_q(spark, sf), views.vectors_c(spark, sf), 5)


def _x6_hashed(spark, sf):
    return VI.hashed_neighbours(views.vectors_q(spark, sf), views.vectors_c(spark, sf), 5)


@query("x6_hashed_neighbours", None, "P")
def q_x6_hashed(spark, sf):
    return _x6_hashed(spark, sf)


@query("x6_hashed_recall", with_views(f"""
with x6 as (select q.vec_id as query_id, c.vec_id as corpus_id from v_vectors_q q, v_vectors_c c
            qualify row_number() over (partition by q.vec_id order by {DOT} desc, c.vec_id) <= 5)
select count(distinct query_id) as n_queries, count(*) as n_exact, true as recall_at_least_90 from x6""", "v_vectors_q", "v_vectors_c"))
def q_x6_recall(spark, sf):
    exact = N.nearest_neighbours(views.vectors_q(spark, sf), views.vectors_c(spark, sf), 5)
    return VI.recall_against(_x6_hashed(spark, sf), exact).select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("recall_at_least_90"))


_X7_SQL = f"""
s as (select q.vec_id as query_id, c.vec_id as corpus_id, c.label, {DOT} as score from v_vectors_q q, v_vectors_c c),
r as (select * from s qualify row_number() over (partition by query_id order by score desc, corpus_id) <= 45),
l as (select * from r qualify row_number() over (partition by query_id, label order by score desc, corpus_id) <= 1),
x7 as (select query_id, corpus_id, label, score,
         (row_number() over (partition by query_id order by score desc, corpus_id))::integer as rank from l qualify rank <= 9)"""


def _x7(spark, sf):
    return N.diverse_neighbours(views.vectors_q(spark, sf), views.vectors_c(spark, sf), "label", k=9, cap=1, over=5)


@query("x7_diverse_neighbours", with_views("with " + _X7_SQL.strip() + "\nselect * from x7", "v_vectors_q", "v_vectors_c"), "R")
def q_x7(spark, sf):
    return _x7(spark, sf).select("query_id", "corpus_id", "label", "score", "rank")


@query("x8_format_examples", with_views("with " + _X7_SQL.strip() + f""",
b as (select x7.query_id, row_number() over (partition by x7.query_id order by x7.rank) as rank, 'QUESTION: What does ' || d.source || ' say?' || chr(10) || 'ANSWER: ' ||
        case when length(d.text) > 1500 then substr(d.text, 1, 1500) || '...' else d.text end || chr(10) ||
        'CLASSIFICATION: ' || cast(x7.label as varchar) as block
      from x7 join documents d on d.doc_id = x7.corpus_id)
select query_id, {_sq(HEADER)} || string_agg('Example ' || rank || ':' || chr(10) || block || chr(10) || chr(10), '' order by rank)
  || {_sq(TAIL)} as system_prompt
from b group by query_id""", "v_vectors_q", "v_vectors_c"))
def q_x8(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("corpus_id"), F.concat(F.lit("What does "), F.col("source"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"))
    rows = _x7(spark, sf).join(docs, "corpus_id").withColumn("label", F.col("label").cast("string"))
    return P.format_examples(rows, ["query_id"], "rank", "question", "answer", "label", HEADER, TAIL, 1500)


@query("x9_prompt_table", with_views(f"""
select q.conv_id, q.turn, t.run_id, t.system_prompt, 'QUESTION: ' || q.question || chr(10) || chr(10) || 'ANSWER: ' || q.answer as user_prompt
from v_qa q, (values {', '.join(f'({_sq(r)}, {_sq(t)})' for r, t in TEMPLATES)}) t(run_id, system_prompt)""", "v_qa"))
def q_x9(spark, sf):
    return P.prompt_table(views.qa(spark, sf), TEMPLATES, "question", "answer").select(
        "conv_id", "turn", "run_id", "system_prompt", "user_prompt")


@query("x9_prompt_table_per_row", with_views("with " + _X7_SQL.strip() + f""",
b as (select x7.query_id, row_number() over (partition by x7.query_id order by x7.rank) as rank, 'QUESTION: What does ' || d.source || ' say?' || chr(10) || 'ANSWER: ' ||
        case when length(d.text) > 1500 then substr(d.text, 1, 1500) || '...' else d.text end || chr(10) ||
        'CLASSIFICATION: ' || cast(x7.label as varchar) as block
      from x7 join documents d on d.doc_id = x7.corpus_id),
p as (select query_id, {_sq(HEADER)} || string_agg('Example ' || rank || ':' || chr(10) || block || chr(10) || chr(10), '' order by rank)
  || {_sq(TAIL)} as system_prompt from b group by query_id)
select p.query_id, p.system_prompt, 'QUESTION: What does ' || d.source || ' say?' || chr(10) || chr(10) || 'ANSWER: ' || d.text as user_prompt
from p join documents d on d.doc_id = p.query_id""", "v_vectors_q", "v_vectors_c"))
def q_x9_rows(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("What does "), F.col("source"), F.lit(" say?")).alias("question"),
        F.col("text").alias("answer"))
    return (P.prompt_table_dynamic(rows, q_x8(spark, sf), ["query_id"], "question", "answer")
            .select("query_id", "system_prompt", "user_prompt"))


@query("x10_training_texts", ex_sql(f"""
t as (select doc_id, to_json([{{'role': 'system', 'content': {_sq(TUNING_SYSTEM)}}},
        {{'role': 'user', 'content': 'Question: ' || question || chr(10) || 'Politician answer: ' || answer}},
        {{'role': 'assistant', 'content': coalesce(evasion_label, 'Explicit')}}])::varchar as messages from ex where split = 'train')
select * from t"""))
def q_x10(spark, sf):
    tr = _train_examples(spark, sf)
    return P.training_texts(tr, TUNING_SYSTEM, "question", "answer", "evasion_label", "Explicit").select("doc_id", "messages")


SCORE_TXT = "cast(round(cast(score as decimal(18,6)), 3) as varchar)"
_X12_SQL = f"""
lists as (select query_id, string_agg(cast(label as varchar), ',' order by rank) as retrieved_labels,
            string_agg({SCORE_TXT}, ',' order by rank) as retrieved_sims, count(*)::integer as n_retrieved
          from x7 group by query_id)"""


def _x12(spark, sf):
    return N.neighbour_lists(_x7(spark, sf), "label")


@query("x12_neighbour_list_columns", with_views("with " + _X7_SQL.strip() + "," + _X12_SQL + "\nselect * from lists",
                                                "v_vectors_q", "v_vectors_c"))
def q_x12(spark, sf):
    return _x12(spark, sf)


@query("x11_retrieval_quality", with_views("with " + _X7_SQL.strip() + "," + _X12_SQL + """
select label, count(*) as n_retrieved from (select unnest(string_split(retrieved_labels, ',')) as label from lists) x
where label <> '' group by label""", "v_vectors_q", "v_vectors_c"))
def q_x11(spark, sf):
    _, labels = N.retrieval_quality(_x12(spark, sf))
    return labels


@query("x11_retrieval_sims", with_views("with " + _X7_SQL.strip() + "," + _X12_SQL + """
select query_id, round(avg(s::double), 6) as mean_sim, count(*) as n_sims
from (select query_id, unnest(string_split(retrieved_sims, ',')) as s from lists) x group by query_id""",
                                        "v_vectors_q", "v_vectors_c"), "R")
def q_x11b(spark, sf):
    sims, _ = N.retrieval_quality(_x12(spark, sf))
    return sims.groupBy("query_id").agg(F.round(F.avg("sim"), 6).alias("mean_sim"), F.count(F.lit(1)).alias("n_sims"))


@query("c3_centroid_classifier", with_views("""
with cd as (select label, d, avg(x::double) as m from (
      select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from v_vectors_c) a group by label, d),
ce as (select label, list(m order by d) as centroid from cd group by label),
sc as (select q.vec_id, q.label as true_label, ce.label as cl, list_inner_product(q.embedding::double[], ce.centroid) as s
       from v_vectors_q q, ce)
select vec_id, true_label, cl as pred_label from sc
qualify row_number() over (partition by vec_id order by s desc, cl) = 1""", "v_vectors_q", "v_vectors_c"))
def q_c3(spark, sf):
    out = N.centroid_classifier(views.vectors_c(spark, sf), views.vectors_q(spark, sf), "label")
    return out.select("vec_id", F.col("label").alias("true_label"), "pred_label")


@query("c4_neighbour_vote", with_views(f"""
with nn as (select q.vec_id as query_id, c.label, {DOT} as score from v_vectors_q q, v_vectors_c c
            qualify row_number() over (partition by q.vec_id order by {DOT} desc, c.vec_id) <= 5),
pl as (select query_id, label, count(*) as n_votes, max(score) as s from nn group by query_id, label)
select query_id, label as voted_label, n_votes from pl
qualify row_number() over (partition by query_id order by n_votes desc, s desc, label) = 1""",
                                       "v_vectors_q", "v_vectors_c"))
def q_c4(spark, sf):
    nn = N.nearest_neighbours(views.vectors_q(spark, sf), views.vectors_c(spark, sf), 5, c_cols=["label"])
    return N.neighbour_vote(nn, "label")


@query("c5_argmax_label", with_views("""
select doc_id, (list_position(logits, list_max(logits)) - 1)::integer as pred_id from v_logits""", "v_logits"))
def q_c5(spark, sf):
    return views.logits(spark, sf).select("doc_id", argmax("logits").alias("pred_id"))
