"""Measures: scikit-learn conventions on hand-made rows."""
import pytest

from answerlab.operators import losses as LS
from answerlab.operators import measures as M


def _df(spark, pairs):
    return spark.createDataFrame(pairs, "true_label string, pred_label string")


def test_per_class_outside_label_counts_as_miss(spark):
    df = _df(spark, [("a", "a"), ("a", "PARSE_ERROR"), ("b", "a"), ("b", "b")])
    pc = {r["label"]: r for r in M.per_class(df, ["a", "b", "c"]).collect()}
    assert pc["a"]["precision"] == pytest.approx(0.5) and pc["a"]["recall"] == pytest.approx(0.5)
    assert pc["c"]["f1"] == 0.0 and pc["c"]["support"] == 0  # zero support -> 0, listed anyway


def test_class_report_micro_avg_when_outside(spark):
    df = _df(spark, [("a", "a"), ("a", "PARSE_ERROR"), ("b", "b")])
    labels = [r["label"] for r in M.class_report(df, ["a", "b"]).collect()]
    assert labels == ["a", "b", "micro avg", "macro avg", "weighted avg"]
    df2 = _df(spark, [("a", "a"), ("b", "a"), ("b", "b")])
    rep = {r["label"]: r for r in M.class_report(df2, ["a", "b"]).collect()}
    assert "accuracy" in rep and rep["accuracy"]["f1"] == pytest.approx(2 / 3)
    assert rep["accuracy"]["precision"] is None


def test_micro_f1_equals_accuracy_without_drops(spark):
    df = _df(spark, [("a", "a"), ("b", "a"), ("b", "b"), ("c", "b")])
    s = M._summary(df, ["a", "b", "c"], "true_label", "pred_label", []).collect()[0]
    assert s["micro_f1"] == pytest.approx(s["accuracy"])


def test_confusion_sum_equals_in_list_rows(spark):
    df = _df(spark, [("a", "a"), ("a", "x"), ("b", "a"), (None, "a")])
    cm = M.confusion_matrix(df, ["a", "b"]).collect()
    assert len(cm) == 4 and sum(r["n"] for r in cm) == 2


def test_macro_f1_seen_vs_listed(spark):
    df = _df(spark, [("a", "a"), ("b", "b")])
    assert M.macro_f1(df).collect()[0]["macro_f1"] == pytest.approx(1.0)
    assert M.macro_f1(df, ["a", "b", "c"]).collect()[0]["macro_f1"] == pytest.approx(2 / 3)


def test_losses_ignore_and_empty(spark):
    import math
    df = spark.createDataFrame([(0, [0.0, 0.0]), (-100, [5.0, 1.0])], "label_id int, logits array<double>")
    assert LS.cross_entropy(df).collect()[0]["loss"] == pytest.approx(math.log(2))
    empty = spark.createDataFrame([(-100, [1.0, 2.0])], "label_id int, logits array<double>")
    assert LS.focal_loss(empty).collect()[0]["loss"] == 0.0
    assert LS.smoothed_ce(empty).collect()[0]["loss"] == 0.0


def test_dual_level_counts_unmapped(spark):
    df = _df(spark, [("Explicit", "Explicit"), ("Dodging", "General"), ("Dodging", "nonsense")])
    out = {r["level"]: r for r in M.dual_level_metrics(df).collect()}
    assert out["coarse"]["n_unmapped"] == 1 and out["coarse"]["accuracy"] == pytest.approx(1.0)
