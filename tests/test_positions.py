"""Seeded places without a sort."""

import pytest
from pyspark.sql import functions as F

from answerlab.operators import balance as B


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutation_of_any_size(spark, n):
    got = [r.p for r in spark.range(n).select(B.permuted(F.col("id"), n, seed=3).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    other = [r.p for r in spark.range(n).select(B.permuted(F.col("id"), n, seed=4).alias("p")).collect()]
    assert n < 64 or got != other and got != list(range(n))


def test_places_do_not_follow_the_partitions(spark):
    df = spark.range(700).select((F.col("id") * 7).alias("doc_id"))
    one = {r.doc_id: r.position for r in B.seeded_positions(df, "doc_id").collect()}
    two = {r.doc_id: r.position for r in B.seeded_positions(df.repartition(7).orderBy(F.desc("doc_id")), "doc_id").collect()}
    assert one == two and sorted(one.values()) == list(range(700))
    assert B.seeded_positions(df.limit(0), "doc_id").collect() == []
    text = df.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"))
    assert sorted(r.position for r in B.seeded_positions(text, "doc_id").collect()) == list(range(700))
    plan = B.seeded_positions(df, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    # places are spread: a tenth of the ids do not stay together
    low = sorted(one[i * 7] for i in range(70))
    assert low[0] < 70 and low[-1] > 600
