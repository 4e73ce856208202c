"""Run tables and comparison.

Runs are rows; all their measures come from one grouped pass over the
predictions (``by=[run]``), never one job per run.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlab.operators import measures as M


def experiment_summary(df: DataFrame, by: Sequence[str], labels: Sequence[str] | None = None,
                       truth: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """One row per experiment: rows, parse errors, accuracy, macro F1,
    weighted F1 (all from the same pass)."""
    m = M.metrics_row(df, labels, truth, pred, by)
    pe = M.parse_error_rate(df, pred, by).select(*by, "n_total", "n_parse_errors")
    return m.join(pe, list(by))


def write_summary_csv(summary: DataFrame, path: str) -> str:
    """S8 file side: the summary as CSV with a header (one small file)."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def run_grid(models: Sequence[str], augs: Sequence[str], losses: Sequence[str], balancings: Sequence[str] = ("",)):
    """The product of settings as (run_id, model_key, bal_name, aug_name,
    loss_name) rows - a parameter list, attached by a generator."""
    rows = [(i, m, b, a, lo) for i, (m, b, a, lo) in enumerate(itertools.product(models, balancings, augs, losses))]
    return rows


def grid_column(rows) -> "F.Column":
    return F.array(*[F.struct(F.lit(i).alias("run_id"), F.lit(m).alias("model_key"), F.lit(b).alias("bal_name"),
                              F.lit(a).alias("aug_name"), F.lit(lo).alias("loss_name")) for i, m, b, a, lo in rows])


def leaderboard(runs: DataFrame, measures: Sequence[str], sort_by: str = "test_macro_f1", digits: int = 4) -> DataFrame:
    """One row per run with the chosen measures rounded (missing -> null),
    best first by ``sort_by`` with missing values last."""
    cols = [F.col("model_key").alias("model"), F.col("extra.task").alias("task"),
            F.col("bal_name").alias("balancing"), F.col("aug_name").alias("augmentation"),
            F.col("loss_name").alias("loss")]
    out = runs.select("run_name", *cols, *[F.round(F.col("metrics")[m], digits).alias(m) for m in measures])
    return out.orderBy(F.desc_nulls_last(sort_by), "run_name")
