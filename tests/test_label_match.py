"""Labels from a table give what the CASE chain over a list gives."""

import random
import time

import pytest
from pyspark.sql import functions as F

from answerlab.functions import replies as R
from answerlab.functions.constants import COARSE_LABELS, FINE_LABELS
from answerlab.operators import label_match as LM


def _replies():
    rnd = random.Random(4)
    words = [w for x in FINE_LABELS + COARSE_LABELS for w in [x, x.upper(), x[:4], x[2:], *x.split()]] + ["", " ", "the", "partial", "clear", "non", "\n", "x" * 50]
    out = [None, "", "  \t", "<label> General </label>", "<LABEL>nothing</LABEL>\nDodging", "a\nb\nImplicit", "non-reply", " Explicit "]
    for _ in range(300):
        body = "".join(rnd.choice(words) + rnd.choice([" ", "", "\n", ", "]) for _ in range(rnd.randint(0, 5)))
        out.append(rnd.choice([body, f"<label>{body}</label>", f"well\n{body}"]))
    return out


@pytest.mark.parametrize("labels", [FINE_LABELS, COARSE_LABELS, ["", "b", "ab", "B"], []])
@pytest.mark.parametrize("kind", ["label", "strict", "tagged", "contained"])
def test_same_as_the_chain(spark, labels, kind):
    df = spark.createDataFrame(list(enumerate(_replies())), "id int, raw string")
    table = spark.createDataFrame([(x, i) for i, x in enumerate(labels)] + [(None, 1)], "label string, rank int")
    if kind == "contained":
        want = df.withColumn("want", R.contained_label("raw", labels, "none of them"))
    else:
        want = R.with_reply_label(df, "raw", labels, kind, "want")
    got = LM.with_table_label(want, "raw", table, kind, "got", "none of them" if kind == "contained" else "PARSE_ERROR")
    assert [r for r in got.collect() if r.want != r.got] == []


def test_time_does_not_follow_the_number_of_labels():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    replies = [word() + " " + word() + " " + word() for _ in range(20_000)]
    took = []
    for n in (10, 10_000):
        m = LM.LabelMatcher([word() for _ in range(n)])
        began = time.process_time()
        for r in replies:
            m.match(r, True)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2  # a chain takes a thousand times as long


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(LM, "MAX_LABELS", 3)
    with pytest.raises(ValueError):
        LM.labels_of(spark.range(4).select(F.col("id").cast("string").alias("label"), F.col("id").alias("rank")))
