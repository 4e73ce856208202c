"""Repeated windows of long texts are equal in all 64 bits of their hash."""

from pyspark.sql import functions as F

from answerlab.llm import quality_rules


def test_windows_that_share_44_bits_are_not_repeats(spark):
    x, y = "9608664", "13806697"
    h = [F.xxhash64(F.lit("a"), F.lit("b"), F.lit(w)) for w in (x, y)]
    row = spark.range(1).select(h[0].alias("x"), h[1].alias("y")).first()
    assert row.x != row.y and row.x >> 20 == row.y >> 20
    n = 1 << 19  # a position takes 20 bits of a long
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("u"), i.cast("string"))))
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.concat_ws(
        " ", F.lit(f"a b {x}"), text, F.lit(f"a b {y}"), F.when(F.col("id") == 1, F.lit("u7 u8 u9"))).alias("text"))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.judge(docs).collect()}
    assert got == {0: 0, 1: 6}
