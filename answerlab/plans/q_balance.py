"""Queries for rebalancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlab.functions.text import feature_prefix, tone_tag
from answerlab.operators import balance as B
from answerlab.operators import stats as S
from answerlab.operators.ranking import cut_lineage, join_null_safe, rank_within
from answerlab.plans.oracle_views import with_views
from answerlab.plans.registry import query
from answerlab.sources import views
from answerlab.sources.tables import table

R6 = lambda c: F.round(F.col(c), 6).alias(c)
HASH = "('0x' || substr(md5(cast({c} as varchar) || '|42'), 1, 8))::bigint / 4294967296.0"


def _train(spark, sf):
    return views.balance_rows(spark, sf).where(F.col("split") == "train")


def _targets(df, label="class", ratio=0.6, strategy="soft"):
    return B.class_targets(B.class_counts(df, label), strategy, ratio)


TG_SQL = """
t0 as (select class as label, count(*) as n from v_balance where split = 'train' group by class),
tg as (select label, n, case when n >= floor(mx * 0.6) then floor(mx * 0.6)::bigint
         else least(2 * n, floor(mx * 0.6)::bigint) end as target from t0, (select max(n) as mx from t0) m)"""


@query("r1_class_targets", with_views(f"""
with {TG_SQL.strip()}
select 'soft' as strategy, label, n, target from tg
union all select 'mean', label, n, floor((select avg(n) from t0))::bigint from t0
union all select 'median', label, n, floor((select quantile_cont(n, 0.5) from t0))::bigint from t0
union all select 'majority', label, n, (select max(n) from t0) from t0
union all select 'fixed', label, n, 100 from t0""", "v_balance"))
def q_r1(spark, sf):
    counts = B.class_counts(_train(spark, sf), "class")
    parts = [B.class_targets(counts, s, 0.6).withColumn("strategy", F.lit(name))
             for name, s in (("soft", "soft"), ("mean", "mean"), ("median", "median"), ("majority", "majority"),
                             ("fixed", 100))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "label", "n", "target")


@query("r2b_representatives", with_views("""
with t0 as (select class, count(*) as n from v_clusters group by class),
tg as (select class, n, case when n >= floor(mx * 0.6) then floor(mx * 0.6)::bigint
         else least(2 * n, floor(mx * 0.6)::bigint) end as target from t0, (select max(n) as mx from t0) m),
ov as (select c.*, tg.n, tg.target from v_clusters c join tg using (class) where tg.n > tg.target),
cd as (select class, cluster, d, avg(x::double) as m from (
         select class, cluster, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from ov) a group by all),
ce as (select class, cluster, list(m order by d) as cen from cd group by all),
di as (select o.vec_id, o.class, o.cluster, round(sqrt(list_sum(list_transform(o.embedding::double[],
         lambda x, i: (x - ce.cen[i]) * (x - ce.cen[i])))), 6) as dd from ov o join ce using (class, cluster)),
sz as (select class, cluster, count(*) as s, any_value(n) as n, any_value(target) as t from ov group by all),
q as (select *, (t * s) // n as base, (t * s) % n as rem from sz),
q2 as (select *, t - sum(base) over (partition by class) as lft,
         row_number() over (partition by class order by rem desc, cluster) as rr from q),
q3 as (select class, cluster, base + case when rr <= lft then 1 else 0 end as quota from q2),
rk as (select *, row_number() over (partition by class, cluster order by dd, vec_id) as rn from di)
select vec_id, class, cluster from rk join q3 using (class, cluster) where rn <= quota
union all select vec_id, class, cluster from v_clusters join tg using (class) where tg.n <= tg.target""", "v_clusters"))
def q_r2b(spark, sf):
    c = views.clusters(spark, sf)
    kept = B.representatives(c, _targets(c), "class", "cluster", "embedding", "vec_id")
    return kept.select("vec_id", "class", "cluster")


@query("r2a_assign_clusters", with_views(f"""
with {TG_SQL.strip()}
select label as "class", n, (case when n > target then 8 else 1 end)::bigint as n_clusters from tg""", "v_balance"))
def q_r2a(spark, sf):
    tr = _train(spark, sf)
    cl = B.assign_clusters(tr, _targets(tr), "class", "embedding", k=8)
    return cl.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("n_clusters"))


@query("r2a_target_clusters", with_views(f"""
with {TG_SQL.strip()}
select label as "class", n, (case when n > target then target else 1 end)::bigint as n_clusters, true as kept_from_every_cluster from tg""",
                                         "v_balance"))
def q_r2a_target(spark, sf):
    """As many clusters as the target: none empty, and one row of each is kept."""
    tr = _train(spark, sf)
    tg = _targets(tr)
    cl = B.assign_clusters(tr, tg, "class", "embedding")
    kept = B.representatives(cl, tg, "class", "cluster", "embedding", "doc_id", one_each=True)
    per = cl.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("n_clusters"))
    left = kept.groupBy("class").agg(F.countDistinct("cluster").alias("_k"), F.count(F.lit(1)).alias("_rows"))
    return (join_null_safe(per, left, ["class"])
            .select("class", "n", "n_clusters", ((F.col("_k") == F.col("n_clusters")) & ((F.col("_rows") == F.col("_k")) | (F.col("_rows") == F.col("n"))))
                    .alias("kept_from_every_cluster")))


R3_SQL = f"""
need as (select label, n, least(target, floor(n * 2.0)::bigint) - n as need from tg),
u as (select b.doc_id, b.class, need.n, need.need, {HASH.format(c='b.doc_id')} as h
      from v_balance b join need on need.label = b.class where b.split = 'train' and need.need > 0),
r as (select *, row_number() over (partition by class order by h, doc_id) as rn from u),
c as (select doc_id, class, (need // n + case when rn <= need % n then 1 else 0 end)::integer as copies from r),
src as (select doc_id, class, copies, unnest(range(1, copies + 1))::integer as copy_no from c where copies > 0)"""


@query("r3_upsample_sources", with_views(f"""
with {TG_SQL.strip()},{R3_SQL}
select doc_id, class, copies, copy_no from src""", "v_balance"))
def q_r3(spark, sf):
    tr = _train(spark, sf)
    return B.upsample_sources(tr, _targets(tr), "class", "doc_id").select("doc_id", "class", "copies", "copy_no")


@query("r4_surface_bound", with_views("""
with ca as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(lower(original), '')) as c from v_pairs) a group by all),
cb as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(lower(rewrite), '')) as c from v_pairs) b group by all),
ov as (select ca.doc_id, sum(least(ca.n, cb.n)) as o from ca join cb using (doc_id, c) group by ca.doc_id)
select p.doc_id, round(case when length(p.original) + length(p.rewrite) > 0
  then 2.0 * coalesce(ov.o, 0) / (length(p.original) + length(p.rewrite)) else 1.0 end, 6) as surface_bound
from v_pairs p left join ov using (doc_id)""", "v_pairs"), "R")
def q_r4_bound(spark, sf):
    p = views.pairs(spark, sf)
    return B.with_surface_bound(p, "original", "rewrite").select("doc_id", F.round("surface_bound", 6).alias("surface_bound"))


@query("r4_accept_pairs", with_views("""
with ca as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(lower(original), '')) as c from v_pairs) a group by all),
cb as (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(lower(rewrite), '')) as c from v_pairs) b group by all),
ov as (select ca.doc_id, sum(least(ca.n, cb.n)) as o from ca join cb using (doc_id, c) group by ca.doc_id),
bd as (select p.doc_id, case when length(p.original) + length(p.rewrite) > 0
         then 2.0 * coalesce(ov.o, 0) / (length(p.original) + length(p.rewrite)) else 1.0 end as b from v_pairs p left join ov using (doc_id)),
cs as (select a.vec_id as doc_id, list_sum(list_transform(a.embedding::double[], lambda x, i: x * b.embedding[i]::double))
         / (sqrt(list_sum(list_transform(a.embedding::double[], lambda x: x * x))) * sqrt(list_sum(list_transform(b.embedding::double[], lambda x: x * x)))) as c
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select doc_id, round(b, 6) as surface_bound, round(c, 6) as cosine, b > 0.85 as needs_exact,
  case when b <= 0.85 then c is null or c between 0.6 and 0.9 when c is not null and c not between 0.6 and 0.9 then false end as native_decision
from bd left join cs using (doc_id)""", "v_pairs"), "R")
def q_r4(spark, sf):
    p = views.pairs(spark, sf)
    e = table(spark, sf, "embeddings")
    p = (p.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("va")), "doc_id", "left")
         .join(e.select((F.col("vec_id") - 1).alias("doc_id"), F.col("embedding").alias("vb")), "doc_id", "left"))
    out = B.accept_pairs(p, "original", "rewrite", 0.15, "va", "vb", 0.6, 0.9)
    # the decision wherever it does not hang on the exact ratio (which SQL cannot express; see the tests for it)
    exact = F.col("surface_bound") > 0.85
    return out.select("doc_id", F.round("surface_bound", 6).alias("surface_bound"), F.round("cosine", 6).alias("cosine"),
                      exact.alias("needs_exact"),
                      F.when(~exact | ~F.coalesce(F.col("cosine").between(0.6, 0.9), F.lit(True)), F.col("accepted")).alias("native_decision"))


@query("r5_choose_rewrites", with_views("""
select doc_id, attempt, accepted, rewrite from v_candidates
qualify row_number() over (partition by doc_id order by case when accepted then 0 else 1 end, attempt) = 1""",
                                        "v_candidates"))
def q_r5(spark, sf):
    return B.choose_rewrites(views.candidates(spark, sf), ["doc_id"]).select("doc_id", "attempt", "accepted", "rewrite")


@query("r5_retry_sources", with_views("""
with n as (select doc_id, lang, source, row_number() over (partition by lang order by doc_id) as r, count(*) over (partition by lang) as m from documents),
nx as (select n.doc_id, x.attempt, o.doc_id as other from n, (values (0), (1), (2)) x(attempt)
       join n o on o.lang = n.lang and o.r = 1 + (n.r + x.attempt) % n.m),
f as (select c.doc_id, nx.other as source_id, accepted, rewrite from v_candidates c join nx on nx.doc_id = c.doc_id and nx.attempt = 0 where c.attempt = 0),
t as (select c.doc_id, nx.other as s, rewrite, c.attempt from v_candidates c join nx on nx.doc_id = c.doc_id and nx.attempt = c.attempt
      where c.attempt > 0 and accepted qualify row_number() over (partition by c.doc_id order by c.attempt) = 1),
c as (select f.doc_id, case when not f.accepted and t.s is not null then t.s else f.source_id end as source_id,
        case when not f.accepted and t.s is not null then t.rewrite else f.rewrite end as rewrite, not f.accepted and t.s is not null as retried
      from f left join t using (doc_id))
select c.*, d.lang, d.source from c left join documents d on d.doc_id = c.source_id""", "v_candidates"))
def q_r5_retry(spark, sf):
    """Every document is a synthetic row; it is made from the next document of
    its language, its retries from those after that."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    place = rank_within(docs, ["lang"], ["doc_id"], "_r")
    many = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_m"))
    place = cut_lineage(join_null_safe(place, many, ["lang"]).select("doc_id", "lang", "_r", "_m"))
    wanted = place.select("doc_id", "lang", F.explode(F.array(*map(F.lit, range(3)))).alias("attempt"), "_r", "_m") \
        .select("doc_id", "lang", "attempt", (F.lit(1) + (F.col("_r") + F.col("attempt")) % F.col("_m")).alias("_r"))
    other = join_null_safe(wanted, place.select("lang", "_r", F.col("doc_id").alias("source_id")), ["lang", "_r"]).select("doc_id", "attempt", "source_id")
    c = views.candidates(spark, sf).join(other, ["doc_id", "attempt"])
    rows = docs.withColumnRenamed("doc_id", "source_id")
    return (B.retry_sources(c.where("attempt = 0"), c.where("attempt > 0"), rows, "doc_id")
            .select("doc_id", "source_id", "rewrite", "retried", "lang", "source"))


@query("r6_upsample", with_views(f"""
with {TG_SQL.strip()},{R3_SQL},
ch as (select doc_id, rewrite from v_candidates
       qualify row_number() over (partition by doc_id order by case when accepted then 0 else 1 end, attempt) = 1)
select doc_id, class, text, null::integer as copy_no, false as is_augmented from v_balance where split = 'train'
union all select s.doc_id, s.class, coalesce(ch.rewrite, ''), s.copy_no, true from src s left join ch using (doc_id)""",
                                 "v_balance", "v_candidates"))
def q_r6(spark, sf):
    tr = cut_lineage(_train(spark, sf).select("doc_id", "class", "text"))
    src = B.upsample_sources(tr, _targets(tr), "class", "doc_id")
    chosen = B.choose_rewrites(views.candidates(spark, sf), ["doc_id"])
    up = B.upsample(tr, src, chosen, "doc_id", "text")
    return up.select("doc_id", "class", "text", "copy_no", "is_augmented")


def _rebalanced(spark, sf):
    return B.rebalance(views.balance_rows(spark, sf), "class", "doc_id", "embedding", "text",
                       views.candidates(spark, sf), "soft", 0.6)


GROWTH_SQL = f"""
with {TG_SQL.strip()},
need as (select label, n, target, least(target, floor(n * 2.0)::bigint) - n as need from tg)
select label as "class", case when n > target then target else n end as n_original,
  greatest(need, 0) as n_synthetic, (case when n > target then target else n end) + greatest(need, 0) as n_total from need"""


@query("r7_rebalance", with_views(f"""
with g as ({GROWTH_SQL.strip()})
select 'train' as split, "class", n_total as n from g
union all select 'validation', class, count(*) from v_balance where split = 'validation' group by class""", "v_balance"))
def q_r7(spark, sf):
    return _rebalanced(spark, sf).groupBy("split", "class").agg(F.count(F.lit(1)).alias("n"))


@query("r8_growth_report", with_views(GROWTH_SQL, "v_balance"))
def q_r8(spark, sf):
    rb = _rebalanced(spark, sf).where(F.col("split") == "train")
    return B.growth_report(rb, "class").withColumnRenamed("label", "class")


@query("r9_seeded_shuffle", "select doc_id, md5(cast(doc_id as varchar) || '|42') as shuffle_key from documents")
def q_r9(spark, sf):
    return B.seeded_shuffle(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("r9_seeded_positions", """
select count(*) as n, count(*) as n_places, 0::bigint as first_place, count(*) - 1 as last_place, true as moved from documents""")
def q_r9_positions(spark, sf):
    """The places are a permutation, and not the order of the ids."""
    placed = B.seeded_positions(table(spark, sf, "documents").select("doc_id"), "doc_id")
    return placed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("n_places"), F.min("position").alias("first_place"),
                      F.max("position").alias("last_place"), (F.count_if(F.col("position") != F.col("doc_id")) > 0.9 * F.count(F.lit(1))).alias("moved"))


def _length_category_step(df, **_):
    return S.length_category(df, "text", F.col("split") == "train")


def _feature_step(df, **_):
    return df.withColumn("model_input", feature_prefix("text", None, "length_category"))


def _tone_step(df, tone_col="label", **_):
    return df.withColumn("model_input", tone_tag("model_input", tone_col))


TRANSFORMS = {"length_category": _length_category_step, "feature_prefix": _feature_step, "tone_tag": _tone_step}


@query("r10_apply_transforms", with_views(r"""
with w as (select doc_id, text, label, split,
             length(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) as wc from v_split),
p as (select quantile_cont(wc, 0.3333) as p33, quantile_cont(wc, 0.6667) as p67 from w where split = 'train'),
c as (select doc_id, text, label, case when split <> 'train' then null when wc <= p33 then 'Short' when wc <= p67 then 'Medium'
        else 'Large' end as lc from w, p)
select doc_id, lc as length_category, '[TONE OF RESPONSE: ' || label || ']' || chr(10) ||
  case when lc is not null and lc <> '' then 'Length: ' || lc || ' | Answer: ' || coalesce(text, 'None') else coalesce(text, 'None') end
  as model_input from c""", "v_split"))
def q_r10(spark, sf):
    out = B.apply_transforms(views.split(spark, sf), ["length_category", "feature_prefix", "tone_tag"], TRANSFORMS,
                             label="label")
    return out.select("doc_id", "length_category", "model_input")


@query("p12_augmented_flag", with_views("""
select doc_id, false as is_augmented from v_split where split = 'validation'
union all select doc_id, doc_id % 2 = 0 from v_split where split = 'train'""", "v_split"))
def q_p12(spark, sf):
    sp = views.split(spark, sf)
    val = sp.where(F.col("split") == "validation").select("doc_id")
    tr = sp.where(F.col("split") == "train").select("doc_id", (F.col("doc_id") % 2 == 0).alias("is_augmented"))
    return B.union_all(B.augmented_flag([val, tr]))


@query("s7_union_splits", with_views("""
select doc_id, label, 'train' as split from v_split where split = 'train'
union all select doc_id, label, 'validation' from v_split where split = 'validation'""", "v_split"))
def q_s7(spark, sf):
    sp = views.split(spark, sf)
    parts = [sp.where(F.col("split") == s).select("doc_id", "label").withColumn("split", F.lit(s))
             for s in ("train", "validation")]
    return B.union_all(parts)
