"""Down step with as many clusters as the target."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from answerlab.operators import balance as B
from answerlab.operators import many_means as MM


def _table(spark):
    rnd = random.Random(7)
    vec = lambda i: [1.0, 2.0, 3.0] if i % 3 == 0 else [rnd.gauss(0, 1) for _ in range(3)]
    data = [(i, vec(i), None if i < 200 else (0 if i < 700 else 1), f"text {i}", "train") for i in range(740)]
    return spark.createDataFrame(data, "doc_id long, embedding array<double>, class int, text string, split string")


@pytest.mark.parametrize("block", [8192, 32])
def test_as_many_clusters_as_the_target(spark, block):
    df = _table(spark)
    t = B.class_targets(B.class_counts(df, "class"), 120)
    got = B.assign_clusters(df, t, "class", "embedding", block=block)
    per = {r["class"]: (r["n"], r["k"], r["hi"]) for r in got.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("k"), F.max("cluster").alias("hi")).collect()}
    assert per == {None: (200, 120, 119), 0: (500, 120, 119), 1: (40, 1, 0)}
    kept = B.representatives(got, t, "class", "cluster", "embedding", "doc_id", one_each=True)
    assert sorted(r["count"] for r in kept.where("class is null or class = 0").groupBy("class", "cluster").count().collect()) == [1] * 240
    members = {}
    for r in got.where("class = 0").collect():
        members.setdefault(r.cluster, []).append((r.doc_id, np.array(r.embedding)))
    want = set()
    for m in members.values():
        centre = np.mean([v for _, v in m], axis=0)
        want.add(min((round(float(np.sqrt(((v - centre) ** 2).sum())), 6), i) for i, v in m)[1])
    assert {r.doc_id for r in kept.where("class = 0").collect()} == want


def test_rebalance_queries_keep_a_row_of_each_target_cluster(spark, monkeypatch):
    from answerlab.plans import q_balance
    seen = []
    real = B.assign_clusters
    monkeypatch.setattr(B, "assign_clusters", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    q_balance.q_r8(spark, "/root/testdata/sf0.001")
    targets = {r["label"]: r["target"] for r in q_balance._targets(q_balance._train(spark, "/root/testdata/sf0.001")).where("n > target").collect()}
    got = {r["class"]: r["k"] for r in seen[0].groupBy("class").agg(F.countDistinct("cluster").alias("k")).collect()}
    assert targets and all(got[c] == t for c, t in targets.items())
    assert rows(q_balance.q_r7(spark, "/root/testdata/sf0.001"), "split", "class", "n")


def _brute_kmeans(x, k, starts=8, rounds=50):
    """Best of several plain Lloyd runs over all rows and centres."""
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng(s)
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds):
            of = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[of == c].mean(0) if (of == c).any() else centres[c] for c in range(k)])
        best = min(best, float(((x - centres[of]) ** 2).sum()))
    return best


@pytest.mark.parametrize("block,factor", [(8192, 1.05), (100, 1.5)])
def test_cost_against_brute_force(spark, block, factor):
    """In one block the cost is that of plain k-means; with blocks of 100 rows and 8 centres, borders add up to half."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(25, 4)) * 4
    x = np.concatenate([c + rnd.normal(size=(24, 4)) for c in centres])
    rnd.shuffle(x)
    df = spark.createDataFrame([(i, list(map(float, v)), 1) for i, v in enumerate(x)], "doc_id long, embedding array<double>, class int")
    t = B.class_targets(B.class_counts(df, "class"), 40)
    got = {r.doc_id: r.cluster for r in B.assign_clusters(df, t, "class", "embedding", block=block).collect()}
    of = np.array([got[i] for i in range(len(x))])
    assert sorted(set(of.tolist())) == list(range(40))
    assert MM.cost(x, of) <= factor * _brute_kmeans(x, 40)


def test_lloyd_repairs_and_shares():
    x = np.repeat(np.arange(6.0), 20)[:, None]  # equal rows: more centres than values
    of = MM.lloyd(x, 11)
    assert sorted(set(of.tolist())) == list(range(11)) and MM.cost(x, of) == 0
    assert MM.shared_out([1, 9999], 2) == [1, 1] and sum(MM.shared_out([5, 3, 900], 17)) == 17
    assert MM.shared_out([1, 1, 1], 3) == [1, 1, 1] and max(MM.shared_out([2, 50], 40)) <= 50
    tree = MM.grow(np.arange(40.0)[:, None], 8)
    part = MM.route(np.arange(40.0)[:, None], tree)
    assert len(set(part.tolist())) == 8 and MM.grow(np.ones((5, 2)), 8) == [(-1, 0.0, -1, -1)]


@pytest.mark.parametrize("block", [8192, 64])
def test_vectors_that_cannot_be_used(spark, block):
    """Null, short and odd vectors count as the zero vector; every class keeps its target."""
    rnd = random.Random(1)
    vec = lambda i: {0: None, 1: [1.0], 2: [None, 1.0, 2.0], 3: [float("nan"), 0.0, 1.0]}.get(i % 10, [rnd.gauss(3, 1) for _ in range(3)])
    data = [(i, vec(i), None if i < 100 else 0 if i < 500 else 1, f"t{i}", "train" if i % 7 else None) for i in range(540)]
    df = spark.createDataFrame(data, "doc_id long, embedding array<double>, class int, text string, split string")
    tr = df.where("split = 'train'")
    t = B.class_targets(B.class_counts(tr, "class"), 50)
    got = B.assign_clusters(tr, t, "class", "embedding", block=block)
    assert {r["class"]: r["k"] for r in got.groupBy("class").agg(F.countDistinct("cluster").alias("k")).collect()} == {None: 50, 0: 50, 1: 1}
    cands = spark.createDataFrame([(i, 0, True, f"r{i}") for i in range(540)], "doc_id long, attempt int, accepted boolean, rewrite string")
    out = B.rebalance(df, "class", "doc_id", "embedding", "text", cands, 50)
    kept = out.where("split = 'train'").groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in kept} == {None: 50, 0: 50, 1: 50}
    assert out.where("split is null").count() == df.where("split is null").count()
    ids = [r.doc_id for r in out.where("split = 'train' and not is_augmented").collect()]
    assert len(ids) == len(set(ids))


def test_rebalance_on_the_given_table_row_by_row(spark):
    """Kept rows of r7 on the smallest tables: the row nearest to each cluster's
    mean, by plain numpy on the same clusters."""
    from answerlab.plans import q_balance
    from answerlab.sources import views
    sf = "/root/testdata/sf0.001"
    tr = q_balance._train(spark, sf)
    targets = q_balance._targets(tr)
    members = {}
    for r in B.assign_clusters(tr, targets, "class", "embedding").collect():
        members.setdefault((r["class"], r.cluster), []).append((r.doc_id, np.array(r.embedding, dtype=float)))
    over = {r.label for r in targets.where("n > target").collect()}
    want = {i for (c, _), m in members.items() if c not in over for i, _ in m}
    for (c, _), m in members.items():
        if c in over:
            centre = np.mean([v for _, v in m], axis=0)
            want.add(min((round(float(np.sqrt(((v - centre) ** 2).sum())), 6), i) for i, v in m)[1])
    out = q_balance._rebalanced(spark, sf)
    assert {r.doc_id for r in out.where("split = 'train' and not coalesce(is_augmented, false)").collect()} == want
    rest = views.balance_rows(spark, sf).where("split = 'validation'").count()
    assert out.where("split = 'validation'").count() == rest


def test_class_table_is_sent_only_below_its_limit(spark):
    """Same rows with the class table sent to all tasks and beyond its limit."""
    from answerlab.operators.ranking import class_table, join_null_safe
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "none")], "id long, label string")
    classes = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "label string, n int")
    want = [(1, 10), (2, 20), (3, 30)]
    for limit, joined in ((1 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        got = join_null_safe(rows, class_table(classes, limit), ["label"])
        assert sorted((r.id, r.n) for r in got.collect()) == want
        assert joined in got._jdf.queryExecution().sparkPlan().toString()
    empty = class_table(classes.limit(0))
    assert join_null_safe(rows, empty, ["label"]).count() == 0
