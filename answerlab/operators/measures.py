"""Classification measures.

Plan shape: the data is aggregated once into pair counts (truth, pred, n);
partial aggregation happens map-side, so the shuffle carries at most
(#labels)^2 rows per task. Every measure is then computed on that tiny
table; predictions are never collected.

Everything takes ``by`` grouping columns (run, level, window ...) so many
runs are measured in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.functions.constants import IGNORE_ID, PARSE_ERROR, TAXONOMY
from answerlab.functions.labels import coarsen
from answerlab.session import literal_table


def pair_counts(df: DataFrame, truth: str = "true_label", pred: str = "pred_label",
                by: Sequence[str] = ()) -> DataFrame:
    """(by.., true_label, pred_label, n) over rows where both labels are present."""
    # no filter before the aggregation: a filter on a computed label would be
    # pushed down with the label's whole expression; null pairs are dropped
    # from the aggregated (small) table instead
    pc = (df.groupBy(*by, F.col(truth).cast("string").alias("true_label"),
                     F.col(pred).cast("string").alias("pred_label"))
          .agg(F.count(F.lit(1)).alias("n")))
    return pc.select(*by, "true_label", "pred_label",
                     F.when(F.col("true_label").isNotNull() & F.col("pred_label").isNotNull(), F.col("n"))
                     .otherwise(F.lit(0)).cast("long").alias("n"))


def _label_grid(spark, labels: Sequence[str]) -> DataFrame:
    return literal_table(spark, [(i, lbl) for i, lbl in enumerate(labels)], ["label_pos", "label"])


def _grid_per_group(pc: DataFrame, by: Sequence[str], rows: list[dict], schema: str) -> DataFrame:
    """Fixed parameter rows (label cells) repeated for every group of ``by``;
    without groups the rows form a small literal table."""
    if not by:
        return literal_table(pc.sparkSession, [tuple(r.values()) for r in rows], list(rows[0].keys()))
    lit_rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
    return pc.select(*by).distinct().select(*by, F.inline(lit_rows))


def confusion_matrix(df: DataFrame, labels: Sequence[str], truth: str = "true_label",
                     pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M1: long confusion table (by.., true_label, pred_label, n); every pair of
    the given labels present (0 filled), pairs outside the list left out."""
    pc = pair_counts(df, truth, pred, by)
    cells = _grid_per_group(pc, by, [{"true_label": a, "pred_label": b} for a in labels for b in labels],
                            "true_label string, pred_label string")
    # zero-filled by union + sum (a join here would push an inferred not-null
    # filter on the computed labels down into the scan)
    return (cells.withColumn("n", F.lit(0).cast("long")).withColumn("_cell", F.lit(True))
            .unionByName(pc.withColumn("_cell", F.lit(False)))
            .groupBy(*by, "true_label", "pred_label").agg(F.sum("n").cast("long").alias("n"), F.max("_cell").alias("_cell"))
            .where(F.col("_cell")).drop("_cell"))


def confusion_wide(cm: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """M1 wide form: one row per truth label, one column per predicted label."""
    return (cm.groupBy(*by, "true_label").pivot("pred_label", list(labels)).agg(F.sum("n"))
            .na.fill(0))


def confusion_normalised(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M2: row shares; the row sum is clipped to at least 1."""
    w = Window.partitionBy(*by, "true_label")
    return cm.withColumn("share", F.col("n") / F.greatest(F.sum("n").over(w), F.lit(1)).cast("double"))


def _labelled(pc: DataFrame, labels: Sequence[str] | None, by: Sequence[str]) -> DataFrame:
    """(by.., label, label_pos, in_list, tp, support, predicted) for every label
    seen in truth or prediction and, with ``labels``, every listed label (zero
    filled). One aggregation: the listed labels enter as zero contributions
    next to the exploded pair counts, so no join is needed."""
    n = F.col("n")
    contrib = F.array(
        F.struct(F.col("true_label").alias("label"), n.alias("sup"), F.lit(0).cast("long").alias("prd"),
                 F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("sup"), n.alias("prd"),
                 F.lit(0).cast("long").alias("tp")))
    rows = pc.where(F.col("n") > 0).select(*by, F.inline(contrib)).withColumn("_pos", F.lit(None).cast("int"))
    if labels is not None:
        listed = F.array(*[F.struct(F.lit(lbl).alias("label"), F.lit(0).cast("long").alias("sup"),
                                    F.lit(0).cast("long").alias("prd"), F.lit(0).cast("long").alias("tp"),
                                    F.lit(i).alias("_pos")) for i, lbl in enumerate(labels)])
        grid = pc.select(*by).distinct().select(*by, F.inline(listed)) if by else \
            pc.sparkSession.range(1).select(F.inline(listed))
        rows = rows.unionByName(grid)
    agg = rows.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"),
                                         F.sum("prd").alias("predicted"), F.min("_pos").alias("label_pos"))
    in_list = F.lit(True) if labels is None else F.col("label_pos").isNotNull()
    return agg.withColumn("in_list", in_list)


def _with_scores(t: DataFrame) -> DataFrame:
    tp, sup, prd = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    return (t.withColumn("precision", F.when(prd > 0, tp / prd).otherwise(F.lit(0.0)))
            .withColumn("recall", F.when(sup > 0, tp / sup).otherwise(F.lit(0.0)))
            .withColumn("f1", F.when(sup + prd > 0, 2 * tp / (sup + prd)).otherwise(F.lit(0.0))))


def per_class(df: DataFrame, labels: Sequence[str] | None = None, truth: str = "true_label",
              pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M3: precision, recall, F1 and support per label (0 where undefined).
    Counts cover all rows, so a prediction outside the list is a miss for the
    true label (as scikit-learn does with ``labels=``)."""
    t = _with_scores(_labelled(pair_counts(df, truth, pred, by), labels, by)).where("in_list")
    return t.select(*by, "label", "precision", "recall", "f1", "support")


def _scored(df: DataFrame, labels: Sequence[str] | None, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    return _with_scores(_labelled(pair_counts(df, truth, pred, by), labels, by))


def _asum(arr, field):
    return F.aggregate(arr, F.lit(0.0), lambda a, r: a + r[field].cast("double"))


def _grouped(df: DataFrame, labels: Sequence[str] | None, truth: str, pred: str, by: Sequence[str]) -> DataFrame:
    """One row per group: ``rows`` = per-label structs (bounded by the number
    of labels) and every summary value, from a single lineage."""
    t = _scored(df, labels, truth, pred, by)
    g = t.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("label_pos", F.lit(1 << 30)).alias("pos"), "label", "in_list", "tp", "support", "predicted",
        "precision", "recall", "f1"))).alias("rows"))
    inl = F.filter("rows", lambda r: r["in_list"])
    n_in = F.size(inl)
    sup_in, prd_in, tp_in = _asum(inl, "support"), _asum(inl, "predicted"), _asum(inl, "tp")
    safe = lambda num, den: F.when(den > 0, num / den).otherwise(F.lit(0.0))
    wavg = lambda f: safe(F.aggregate(inl, F.lit(0.0), lambda a, r: a + r[f] * r["support"]), sup_in)
    n_all, tp_all = _asum("rows", "support"), _asum("rows", "tp")
    return g.select(
        *by, "rows",
        n_all.cast("long").alias("n_rows"), F.when(n_all > 0, tp_all / n_all).alias("accuracy"),
        F.when(n_in > 0, _asum(inl, "f1") / n_in).alias("macro_f1"),
        F.when(n_in > 0, _asum(inl, "precision") / n_in).alias("macro_precision"),
        F.when(n_in > 0, _asum(inl, "recall") / n_in).alias("macro_recall"),
        wavg("f1").alias("weighted_f1"), wavg("precision").alias("weighted_precision"),
        wavg("recall").alias("weighted_recall"), sup_in.cast("long").alias("support_in"),
        safe(tp_in, prd_in).alias("micro_precision"), safe(tp_in, sup_in).alias("micro_recall"),
        safe(2 * tp_in, sup_in + prd_in).alias("micro_f1"),
        F.size(F.filter("rows", lambda r: ~r["in_list"] & ((r["support"] > 0) | (r["predicted"] > 0)))).alias("n_outside"))


def _summary(df: DataFrame, labels: Sequence[str] | None, truth: str, pred: str,
             by: Sequence[str]) -> DataFrame:
    return _grouped(df, labels, truth, pred, by).drop("rows")


def accuracy(df: DataFrame, truth: str = "true_label", pred: str = "pred_label",
             by: Sequence[str] = ()) -> DataFrame:
    """M4: share of rows whose prediction equals the truth, over all given rows."""
    eq = F.coalesce(F.col(truth) == F.col(pred), F.lit(False))
    return df.groupBy(*by).agg(F.avg(eq.cast("double")).alias("accuracy"))


def macro_f1(df: DataFrame, labels: Sequence[str] | None = None, truth: str = "true_label",
             pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M5: mean F1 over ``labels`` (zero support counts 0) or over seen labels."""
    return _summary(df, labels, truth, pred, by).select(*by, "macro_f1")


def weighted_f1(df: DataFrame, labels: Sequence[str] | None = None, truth: str = "true_label",
                pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M6: F1 weighted by support; null pairs are dropped."""
    return _summary(df, labels, truth, pred, by).select(*by, "weighted_f1")


def metrics_row(df: DataFrame, labels: Sequence[str] | None = None, truth: str = "true_label",
                pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M4-M6 together: (by.., n_rows, accuracy, macro_f1, weighted_f1)."""
    return _summary(df, labels, truth, pred, by).select(*by, "n_rows", "accuracy", "macro_f1", "weighted_f1")


def class_report(df: DataFrame, labels: Sequence[str], truth: str = "true_label",
                 pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """M7: per-class rows, then ``accuracy`` (or ``micro avg`` when some row
    holds a label outside the list), ``macro avg`` and ``weighted avg``.
    Per-class and summary rows come out of the same grouped row, so the data
    is aggregated once."""
    g = _grouped(df, labels, truth, pred, by)
    per = F.transform(F.filter("rows", lambda r: r["in_list"]), lambda r: F.struct(
        r["label"].alias("label"), r["precision"].alias("precision"), r["recall"].alias("recall"),
        r["f1"].alias("f1"), r["support"].alias("support")))
    micro = F.col("n_outside") > 0
    first = F.struct(
        F.when(micro, F.lit("micro avg")).otherwise(F.lit("accuracy")).alias("label"),
        F.when(micro, F.col("micro_precision")).alias("precision"),
        F.when(micro, F.col("micro_recall")).alias("recall"),
        F.when(micro, F.col("micro_f1")).otherwise(F.col("accuracy")).alias("f1"),
        F.when(micro, F.col("support_in")).otherwise(F.col("n_rows")).alias("support"))
    macro = F.struct(F.lit("macro avg").alias("label"), F.col("macro_precision").alias("precision"),
                     F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"),
                     F.col("support_in").alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("label"), F.col("weighted_precision").alias("precision"),
                        F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"),
                        F.col("support_in").alias("support"))
    return g.select(*by, F.inline(F.concat(per, F.array(first, macro, weighted))))


def dual_level_metrics(df: DataFrame, truth: str = "true_label", pred: str = "pred_label",
                       taxonomy: Sequence[tuple[str, str]] = TAXONOMY, by: Sequence[str] = (), seen_only: bool = False) -> DataFrame:
    """M8: accuracy, macro and weighted F1 on the fine labels and again on their
    coarse classes. Rows with a label outside the taxonomy cannot be coarsened:
    they are dropped from the coarse level and counted in ``n_unmapped``. With
    ``seen_only`` the means run over the labels that occur, as a training metric
    does, else over all listed labels. Rows with a null label count as wrong."""
    fine = [f for f, _ in taxonomy]
    coarse = sorted({c for _, c in taxonomy})
    t, p = F.col(truth).cast("string"), F.col(pred).cast("string")
    ct, cp = coarsen(t, default=None, taxonomy=taxonomy), coarsen(p, default=None, taxonomy=taxonomy)
    stacked = df.select(*by, F.inline(F.array(
        F.struct(F.lit("fine").alias("level"), t.alias("t"), p.alias("p"), F.lit(False).alias("unmapped")),
        F.struct(F.lit("coarse").alias("level"), ct.alias("t"), cp.alias("p"),
                 (ct.isNull() | cp.isNull()).alias("unmapped")))))
    # one pass: pair counts of both levels, then everything from that small table; a
    # level lists its own labels only, so the grids of both cannot mix
    pc = (stacked.groupBy(*by, "level", "unmapped", F.col("t").alias("true_label"), F.col("p").alias("pred_label"))
          .agg(F.count(F.lit(1)).alias("n")))
    listed = F.when(F.col("level") == "fine", F.array(*[F.lit(x) for x in fine])).otherwise(F.array(*[F.lit(x) for x in coarse]))
    return _levels(pc, [*by, "level"], F.array().cast("array<string>") if seen_only else listed, seen_only)


def _levels(pc: DataFrame, by: Sequence[str], listed, seen_only: bool = False) -> DataFrame:
    """Summary per group of pair counts (``unmapped`` ones only counted), with
    the labels of ``listed`` (an array by group); null pairs count as wrong."""
    zero = F.lit(0).cast("long")

    def cell(label, t, p, hit, listed_, un):
        return F.struct(label.alias("label"), t.alias("t"), p.alias("p"), hit.alias("hit"), listed_.alias("listed"), un.alias("un"))
    n, mapped = F.col("n"), ~F.col("unmapped")
    seen = F.array(cell(F.when(mapped, F.col("true_label")), F.when(mapped, n).otherwise(zero), zero,
                        F.when(mapped & (F.col("true_label") == F.col("pred_label")), n).otherwise(zero), F.lit(False),
                        F.when(mapped, zero).otherwise(n)),
                   cell(F.when(mapped, F.col("pred_label")), zero, F.when(mapped, n).otherwise(zero), zero, F.lit(False), zero))
    grid = F.transform(listed, lambda x: cell(x, zero, zero, zero, F.lit(True), zero))
    cells = pc.select(*by, F.inline(F.concat(seen, grid)))
    per = cells.groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"),
                                          F.max("listed").alias("listed"), F.sum("un").alias("un"))
    inl = (F.lit(True) if seen_only else F.col("listed")) & F.col("label").isNotNull()
    f1 = F.when(inl & (F.col("t") + F.col("p") > 0), 2 * F.col("hit") / (F.col("t") + F.col("p"))).when(inl, F.lit(0.0))
    sup = F.sum(F.when(inl, F.col("t")))
    return per.withColumn("f1", f1).groupBy(*by).agg(
        F.sum("t").cast("long").alias("n_rows"), (F.sum("hit") / F.when(F.sum("t") > 0, F.sum("t"))).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), F.coalesce(F.sum(F.col("f1") * F.col("t")) / F.when(sup > 0, sup), F.lit(0.0)).alias("weighted_f1"),
        F.sum("un").cast("long").alias("n_unmapped"))


def drop_ignored(df: DataFrame, col: str = "label_id") -> DataFrame:
    """M9: remove rows with the ignore label -100."""
    return df.where(F.col(col) != IGNORE_ID)


def drop_parse_errors(df: DataFrame, col: str = "pred_label") -> DataFrame:
    """Keep rows with a parsed prediction."""
    return df.where(F.col(col) != PARSE_ERROR)


def parse_error_rate(df: DataFrame, col: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """Total rows, parse errors, valid rows and the error share."""
    err = F.coalesce(F.col(col) == PARSE_ERROR, F.lit(False))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(err).alias("n_parse_errors"),
                               F.count_if(~err).alias("n_valid"),
                               F.avg(err.cast("double")).alias("parse_error_share"))


def label_vs_prediction(df: DataFrame, truth: str = "true_label", pred: str = "pred_label",
                        by: Sequence[str] = ()) -> DataFrame:
    """Per label, count as truth and count as prediction."""
    return (df.select(*by, F.inline(F.array(
        F.struct(F.col(truth).cast("string").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col(pred).cast("string").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))))
        .where(F.col("label").isNotNull())
        .groupBy(*by, "label").agg(F.sum("t").cast("long").alias("n_true"), F.sum("p").cast("long").alias("n_pred")))


def top_classes(df: DataFrame, k: int, labels: Sequence[str] | None = None, truth: str = "true_label",
                pred: str = "pred_label") -> DataFrame:
    """The k labels with the best F1 (ties by label name). The limit is the
    feature here; the input is the per-class table of C rows."""
    return per_class(df, labels, truth, pred).orderBy(F.desc("f1"), F.asc("label")).limit(k)


def best_per_task(summary: DataFrame, measure: str, task: str = "task", strategy: str = "strategy",
                  position: str = "position") -> DataFrame:
    """Best strategy per task; the first listed wins ties."""
    return summary.groupBy(task).agg(
        F.max_by(F.struct(strategy, measure), F.struct(F.col(measure), -F.col(position))).alias("b")
    ).select(task, F.col(f"b.{strategy}").alias(strategy), F.col(f"b.{measure}").alias(measure))


def task_gap(summary: DataFrame, measure: str, tasks: Sequence[str], task: str = "task",
             strategy: str = "strategy", position: str = "position") -> DataFrame:
    """One row per strategy with the measure per task side by side, the
    gap between the last and first task and the gain over the previous strategy."""
    wide = summary.groupBy(strategy).pivot(task, list(tasks)).agg(F.first(measure))
    pos = summary.groupBy(strategy).agg(F.min(position).alias(position))
    w = Window.orderBy(position)  # strategies: a handful of rows
    out = wide.join(pos, strategy).withColumn("gap", F.col(f"`{tasks[-1]}`") - F.col(f"`{tasks[0]}`"))
    return out.withColumn("gain", F.col(f"`{tasks[0]}`") - F.lag(F.col(f"`{tasks[0]}`")).over(w))
