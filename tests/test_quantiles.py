"""Exact quantiles and the similarity ratio against Spark's and Python's own."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from answerlab.operators import balance as B
from answerlab.operators import quantiles as Q
from answerlab.operators import similarity as S

PROBS = [0.0, 0.1, 0.25, 0.3333, 0.5, 0.6667, 0.9, 1.0]


def _compare(df, col, group=()):
    got = {tuple(r[:-1]): r.q for r in Q.exact_quantiles(df, col, PROBS, group).collect()}
    want = {tuple(r[:-1]): r.q for r in df.groupBy(*group).agg(F.percentile(F.col(col).cast("double"), F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    assert {k: v and list(map(repr, v)) for k, v in got.items()} == {k: v and list(map(repr, v)) for k, v in want.items()}


def test_doubles_of_all_sizes(spark):
    rnd = random.Random(1)
    some = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 1.5, 1.5, 1.5]
    data = [(None if i % 40 == 0 else i % 3, None if i % 11 == 0 else rnd.choice([*some, rnd.gauss(0, 1), rnd.gauss(0, 1e-9), rnd.gauss(0, 1e12)]))
            for i in range(700)] + [(9, None), (9, None)]
    df = spark.createDataFrame([(g, None if x is None else x + 0.0) for g, x in data if x is None or abs(x) != float("inf")], "g int, x double")
    _compare(df, "x", ["g"])
    _compare(df, "x")
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert [repr(v) for v in Q.exact_quantiles(nan, "x", [0.0, 0.5, 1.0]).first().q] == ["1.0", "2.0", "nan"]


@pytest.mark.parametrize("kind,low,high", [("int", -5, 70), ("long", -(1 << 62), 1 << 62), ("int", 100_000, 400_000), ("long", 7, 7)])
def test_integers(spark, kind, low, high):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i % 4, rnd.randint(low, high)) for i in range(500)], f"g int, x {kind}")
    _compare(df, "x", ["g"])
    _compare(df, "x")


def test_no_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "g int, x double")
    assert sorted(map(tuple, Q.exact_quantiles(df, "x", [0.5], ["g"]).collect())) == [(1, None), (2, None)]
    assert Q.exact_quantiles(df.limit(0), "x", [0.5], ["g"]).collect() == []
    assert Q.exact_quantiles(df.limit(0), "x", [0.5]).collect() in ([], [(None,)])


@pytest.mark.parametrize("direct", [0, 64, 2048])
def test_ratio_is_difflibs(monkeypatch, direct):
    monkeypatch.setattr(S, "_DIRECT", direct)
    rnd = random.Random(5)
    for _ in range(400):
        alphabet = rnd.choice(["ab", "abcde", "abcdefghijklmnop ", "日本é a"])
        a = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, rnd.choice([12, 90, 500]))))
        near = "".join(c if rnd.random() < 0.9 else rnd.choice(alphabet) for c in a)
        b = rnd.choice([a, near, near + a[:9], "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 400)))])
        want = SequenceMatcher(None, a, b).ratio()
        assert S.sequence_ratio(a, b) == pytest.approx(want, abs=1e-12)
        assert (S.sequence_ratio(a, b, 0.85) > 0.85) == (want > 0.85)


def test_ratio_of_long_texts():
    import time
    rnd = random.Random(6)
    words = ["".join(rnd.choice("etaoinshrdlucmfwypvbgkqjxz") for _ in range(rnd.randint(2, 9))) + rnd.choice([" ", " ", ". ", ", ", "-", "\n"]) for _ in range(4000)]
    one = [rnd.choice(words) for _ in range(20_000)]
    two = [w if rnd.random() > 0.02 else rnd.choice(words) for w in one]
    began = time.process_time()
    S.sequence_ratio("".join(one), "".join(two))
    assert time.process_time() - began < 5  # difflib's own needs minutes
    short, other = "".join(one[:600]), "".join(two[:600])
    assert S.sequence_ratio(short, other) == pytest.approx(SequenceMatcher(None, short, other).ratio(), abs=1e-12)


def test_accepted_pairs_use_the_ratio(spark):
    rnd = random.Random(8)
    data = [(i, a := "".join(rnd.choice("abcdef gh") for _ in range(60)), "".join(sorted(a)) if i % 3 == 0 else a[5:] + "zz" if i % 3 == 1 else a) for i in range(60)]
    df = spark.createDataFrame(data, "id long, a string, b string")
    for r in B.accept_pairs(df, "a", "b").collect():
        want = SequenceMatcher(None, r.a.lower(), r.b.lower()).ratio()
        assert r.accepted == (want <= 0.85) and (r.surface_ratio is None or r.surface_ratio == pytest.approx(want))
