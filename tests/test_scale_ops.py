"""Distributed operators: exactness against brute force and invariance to
the number of partitions."""
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from answerlab.operators import balance as B
from answerlab.operators import neighbours as N
from answerlab.operators import stats as S
from answerlab.operators.ranking import rank_within
from conftest import rows


def test_rank_within_matches_window(spark):
    rnd = random.Random(7)
    data = [(i, "hot" if i % 3 else f"g{i % 5}", rnd.random()) for i in range(600)]
    df = spark.createDataFrame(data, "id long, g string, h double")
    got = rows(rank_within(df, ["g"], ["h", "id"]), "id", "rn")
    want = rows(df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "id"))), "id", "rn")
    assert got == want


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_exact_split_partition_invariant(spark, parts):
    df = spark.range(500).withColumnRenamed("id", "doc_id").repartition(parts)
    out = S.exact_split(df, "doc_id", 0.2)
    assert out.where("split = 'validation'").count() == 100
    base = S.exact_split(spark.range(500).withColumnRenamed("id", "doc_id").coalesce(1), "doc_id", 0.2)
    assert rows(out, "doc_id", "split") == rows(base, "doc_id", "split")


def test_split_disjoint_and_complete(spark):
    df = S.split_examples(spark.range(1000).withColumnRenamed("id", "doc_id"))
    assert df.count() == 1000 and df.select("split").distinct().count() == 2


def _vectors(spark, n, dim, seed, clustered):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(n):
        base = centres[i % 5] if clustered else [0.0] * dim
        out.append((i, [b + rnd.gauss(0, 0.3 if clustered else 1) for b in base], i % 4))
    return spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_neighbours_exact(spark, clustered):
    q = _vectors(spark, 30, 8, 1, clustered)
    c = _vectors(spark, 300, 8, 2, clustered).withColumn("vec_id", F.col("vec_id") + 1000)
    got = rows(N.nearest_neighbours(q, c, 5, n_pivots=8, probe=1), "query_id", "corpus_id", "rank")
    pairs = (q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("a"))
             .crossJoin(c.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("b")))
             .withColumn("score", F.round(N.dot(F.col("a"), F.col("b")), 6)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    want = rows(pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 5"), "query_id", "corpus_id", "rank")
    assert got == want


def test_nearest_neighbours_ties_strings_and_empty_corpus(spark):
    same = spark.createDataFrame([(f"c{i:03d}", [1.0, 0.0] if i % 2 else [0.5, 0.5], i) for i in range(60)], "vec_id string, embedding array<double>, label int")
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "vec_id string, embedding array<double>")
    got = rows(N.nearest_neighbours(q, same, 3, n_pivots=4, probe=1, max_block=7, max_queries=1, c_cols=["label"]), "query_id", "corpus_id", "rank", "label")
    assert got == [("q1", "c001", 1, 1), ("q1", "c003", 2, 3), ("q1", "c005", 3, 5), ("q2", "c000", 1, 0), ("q2", "c002", 2, 2), ("q2", "c004", 3, 4)]
    assert N.diverse_neighbours(q, same.limit(0), "label").collect() == []


def test_diverse_neighbours_cap(spark):
    q = _vectors(spark, 10, 8, 3, True)
    c = _vectors(spark, 200, 8, 4, True).withColumn("vec_id", F.col("vec_id") + 1000)
    out = N.diverse_neighbours(q, c, "label", k=3, cap=1, over=5, n_pivots=8)
    per = out.groupBy("query_id", "label").count().where("count > 1").count()
    assert per == 0 and out.groupBy("query_id").count().where("count > 3").count() == 0


def test_rebalance_counts_match_targets(spark):
    rnd = random.Random(5)
    data = [(i, [rnd.random() for _ in range(4)], 0 if i < 300 else (1 if i < 400 else 2), f"text {i}", "train")
            for i in range(450)]
    df = spark.createDataFrame(data, "doc_id long, embedding array<double>, class int, text string, split string")
    rewrites = spark.createDataFrame([(i, 0, False, f"rw {i}") for i in range(450)],
                                     "doc_id long, attempt int, accepted boolean, rewrite string")
    out = B.rebalance(df, "class", "doc_id", "embedding", "text", rewrites, "soft", 0.6, k=4)
    got = {r["label"]: (r["n_original"], r["n_synthetic"]) for r in B.growth_report(out, "class").collect()}
    # ceiling = int(300 * 0.6) = 180: class 0 down to 180, class 1 up to 180, class 2 up to 100 (2x cap)
    assert got == {0: (180, 0), 1: (100, 80), 2: (50, 50)}
    assert out.where("is_augmented").select("text").distinct().count() > 1


def test_class_targets_strategies(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 4), ("c", 1)], "label string, n long")
    t = lambda s: {r["label"]: r["target"] for r in B.class_targets(counts, s, 0.75).collect()}
    assert t("soft") == {"a": 7, "b": 7, "c": 2}
    assert t("mean") == {"a": 5, "b": 5, "c": 5}
    assert t("median") == {"a": 4, "b": 4, "c": 4}
    assert t("majority") == {"a": 10, "b": 10, "c": 10}
    assert t(3) == {"a": 3, "b": 3, "c": 3}


def test_apply_transforms_unknown_name(spark):
    with pytest.raises(KeyError, match="available"):
        B.apply_transforms(spark.range(1), ["nope"], {"x": lambda d: d})
    df = spark.range(1)
    assert B.apply_transforms(df, ["x"], {"x": lambda d: d.withColumn("y", F.lit(1))}, label="missing") is df


def test_smallest_k_matches_window_with_collisions(spark):
    from answerlab.operators.ranking import smallest_k
    rnd = random.Random(11)
    # keys spread over the 32-bit range with many exact collisions; one hot group
    data = [(i, "hot" if i % 4 else f"g{i % 3}", rnd.choice([0, 5, 65535, 65536, 70000, 1 << 31, (1 << 32) - 1]) +
             rnd.randrange(3)) for i in range(800)]
    df = spark.createDataFrame(data, "id long, g string, key long")
    want_k = {"hot": 333, "g0": 0, "g1": 17, "g2": 66}
    kdf = spark.createDataFrame(list(want_k.items()), "g string, k long")
    got = {r["id"] for r in smallest_k(df, ["g"], "key", "id", kdf).where("in_k").collect()}
    ranked = df.join(kdf, "g").withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("key", "id")))
    want = {r["id"] for r in ranked.where("r <= k").collect()}
    assert got == want and len(got) == sum(want_k.values())


def test_exact_split_matches_window(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("s", (F.col("doc_id") % 3).cast("int"))
    out = S.exact_split(df, "doc_id", 0.2, strata=["s"])
    h = df.withColumn("h", S.split_hash_int("doc_id")).withColumn(
        "r", F.row_number().over(Window.partitionBy("s").orderBy("h", "doc_id")))
    want = rows(h.withColumn("split", F.when(F.col("r") <= 200, "validation").otherwise("train")), "doc_id", "split")
    assert rows(out, "doc_id", "split") == want


def test_upsample_sources_histogram_plan(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, 0 if i < 500 else 1) for i in range(700)], "doc_id long, class int")
    t = B.class_targets(B.class_counts(df, "class"), "soft", 0.7)  # class 1: 200 -> 350, remainder 150
    a = rows(B.upsample_sources(df, t, "class", "doc_id"), "doc_id", "copy_no")
    h = df.where("class = 1").withColumn("h", S.split_hash_int("doc_id")).orderBy("h", "doc_id").limit(150)
    assert a == sorted((r.doc_id, 1) for r in h.collect()) and rnd is not None


def test_null_labels_and_splits_are_kept(spark):
    data = [(i, [float(i % 7), 1.0], None if i < 15 else (0 if i < 75 else 1), f"text {i}", "train" if i < 90 else None) for i in range(100)]
    df = spark.createDataFrame(data, "doc_id long, embedding array<double>, class int, text string, split string")
    rewrites = spark.createDataFrame([(i, 0, False, f"rw {i}") for i in range(100)], "doc_id long, attempt int, accepted boolean, rewrite string")
    out = B.rebalance(df, "class", "doc_id", "embedding", "text", rewrites, "soft", 0.6, k=4)
    got = {r["label"]: (r["n_original"], r["n_synthetic"]) for r in B.growth_report(out.where("split = 'train'"), "class").collect()}
    assert got == {0: (36, 0), 1: (15, 15), None: (15, 15)}
    assert out.where("split is null").count() == 10


def test_copies_take_their_own_rewrites(spark):
    rows_ = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, class int")
    src = rows_.withColumn("copies", F.lit(2)).withColumn("copy_no", F.explode(F.array(F.lit(1), F.lit(2))))
    rw = spark.createDataFrame([(1, 1, "first"), (1, 2, "second")], "doc_id long, copy_no int, rewrite string")
    assert sorted(r.text for r in B.upsample(rows_, src, rw, "doc_id", "text").where("is_augmented").collect()) == ["first", "second"]


def test_retry_takes_over_the_source_row(spark):
    first = spark.createDataFrame([(1, 10, False, "w1"), (2, 11, True, "w2"), (3, 12, False, "w3")], "doc_id long, source_id long, accepted boolean, rewrite string")
    cands = spark.createDataFrame([(1, 1, 20, False, "x"), (1, 2, 21, True, "y"), (1, 3, 22, True, "z"), (3, 1, 20, False, "n")],
                                  "doc_id long, attempt int, source_id long, accepted boolean, rewrite string")
    base = spark.createDataFrame([(i, f"t{i}") for i in (10, 11, 12, 20, 21, 22)], "source_id long, tag string")
    got = rows(B.retry_sources(first, cands, base, "doc_id"), "doc_id", "source_id", "rewrite", "tag")
    assert got == [(1, 21, "y", "t21"), (2, 11, "w2", "t11"), (3, 12, "w3", "t12")]


def test_exact_ratio_runs_only_above_the_bound(spark):
    df = spark.createDataFrame([(1, "abcdef", "zzzzzz"), (2, "abcdef", "abcdef"), (3, None, None)], "id long, a string, b string")
    got = {r.id: (r.surface_ratio, r.accepted) for r in B.accept_pairs(df, "a", "b").collect()}
    assert got == {1: (None, True), 2: (1.0, False), 3: (1.0, False)}


def test_runs_are_read_line_by_line(spark, tmp_path):
    from answerlab.sources import io as IO
    recs = [{"model_key": f"m{i}", "bal_name": "b", "aug_name": "a", "loss_name": "l", "metrics": {"macro_f1": i / 10}} for i in range(3)]
    import json
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in recs))
    assert [r.model_key for r in IO.read_runs(spark, str(tmp_path)).collect()] == ["m2", "m1", "m0"]


def test_scorer_with_a_short_result_fails_its_rows_only(spark):
    import pandas as pd

    from answerlab.operators import scoring as SC
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string").coalesce(1)

    def short(pdf):
        return pd.Series(["<step1> why </step1><label>General</label>"]) if len(pdf) > 1 else pd.Series([] if pdf.text.iloc[0] == "y" else ["<step1> why </step1><label>General</label>"])
    got = {r.id: (r.pred_label, r.reasoning) for r in SC.score_table(df, short, ["id", "text"], ["General", "Explicit"], tagged=True).collect()}
    assert got == {1: ("General", "why"), 2: ("PARSE_ERROR", "")}


def test_lexicon_join_equals_a_count(spark):
    from answerlab.operators import scoring as SC
    lex = spark.createDataFrame([(f"w{i}", ["A", "B"][i % 2], 1.0) for i in range(5000)], "word string, tone string, weight double")
    df = spark.createDataFrame([(1, "W1 w3, w2."), (2, None), (3, "nothing"), (4, "w2 w4 w1")], "doc_id long, text string")
    got = {r.doc_id: (r.tone, list(r.tone_scores)) for r in SC.lexicon_label(df, "text", lex, "doc_id", ["A", "B"]).collect()}
    assert got == {1: ("B", [1.0, 2.0]), 2: ("A", [0.0, 0.0]), 3: ("A", [0.0, 0.0]), 4: ("A", [2.0, 1.0])}
