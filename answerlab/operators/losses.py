"""Loss values over logit arrays (M11-M14), as array expressions.

Per row: stable log-softmax (max subtracted), cross-entropy of the true id;
then one global aggregate. Rows with the ignore id -100 are left out. Class
weights come from a table with one row per class (broadcast join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.functions.constants import IGNORE_ID


def log_sum_exp(logits: Column) -> Column:
    m = F.array_max(logits)
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def cross_entropy_col(logits: Column, label_id: Column) -> Column:
    """-log softmax(logits)[label_id] (label_id 0-based)."""
    return log_sum_exp(logits) - F.element_at(logits, (label_id + 1).cast("int"))


def _valid(df: DataFrame, logits: str, label: str) -> DataFrame:
    return (df.where(F.col(label) != IGNORE_ID)
            .select(F.col(logits).cast("array<double>").alias("_l"), F.col(label).alias("_y"))
            .withColumn("_ce", cross_entropy_col(F.col("_l"), F.col("_y"))))


def cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label_id") -> DataFrame:
    """Mean cross-entropy over rows with a label (null when none)."""
    return _valid(df, logits, label).agg(F.avg("_ce").alias("loss"))


def _with_weights(v: DataFrame, weights: DataFrame) -> DataFrame:
    w = F.broadcast(weights.select(F.col("label_id").alias("_y"), F.col("weight").alias("_w")))
    return v.join(w, "_y", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))


def _class_mean(v: DataFrame, term) -> DataFrame:
    """Mean over the classes seen of the term's mean in each class. With balanced
    weights w_y = N / (C n_y), both sum(w_y * x) / sum(w_y) and sum(w_y * x) / N
    are this value, so the weights need no pass of their own."""
    return v.groupBy("_y").agg(F.avg(term).alias("_m")).agg(F.avg("_m").alias("loss"))


def weighted_ce(df: DataFrame, weights: DataFrame | None = None, logits: str = "logits", label: str = "label_id") -> DataFrame:
    """sum(w_y * CE) / sum(w_y); without ``weights``, the balanced ones
    (L4 on the labels seen), in one pass over the rows."""
    if weights is None:
        return _class_mean(_valid(df, logits, label), F.col("_ce"))
    v = _with_weights(_valid(df, logits, label), weights)
    return v.agg((F.sum(F.col("_w") * F.col("_ce")) / F.sum("_w")).alias("loss"))


def focal_loss(df: DataFrame, weights: DataFrame | None = None, gamma: float = 2.0, logits: str = "logits",
               label: str = "label_id", balanced: bool = False) -> DataFrame:
    """Mean of alpha_y * (1 - p)^gamma * CE with p = exp(-CE); 0.0 when
    no row has a label. ``balanced``: alpha_y as in M12 without weights."""
    v = _valid(df, logits, label)
    if balanced:
        term = F.pow(1 - F.exp(-F.col("_ce")), F.lit(gamma)) * F.col("_ce")
        return _class_mean(v, term).select(F.coalesce("loss", F.lit(0.0)).alias("loss"))
    alpha = F.lit(1.0)
    if weights is not None:
        v = _with_weights(v, weights)
        alpha = F.col("_w")
    term = alpha * F.pow(1 - F.exp(-F.col("_ce")), F.lit(gamma)) * F.col("_ce")
    return v.agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("loss"))


def smoothed_ce(df: DataFrame, eps: float = 0.1, logits: str = "logits", label: str = "label_id") -> DataFrame:
    """Mean of (1 - eps) * NLL + eps * mean_j(-log p_j); 0.0 when no row
    has a label."""
    v = _valid(df, logits, label)
    mean_neg_logp = log_sum_exp(F.col("_l")) - F.aggregate("_l", F.lit(0.0), lambda a, x: a + x) / F.size("_l")
    term = (1 - eps) * F.col("_ce") + eps * mean_neg_logp
    return v.agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("loss"))


def class_weights_from_ids(df: DataFrame, label: str = "label_id", n_classes: int | None = None) -> DataFrame:
    """L4 on integer ids: N / (C * count_c) over rows with a label; C is the
    number of classes seen unless given."""
    counts = df.where(F.col(label) != IGNORE_ID).groupBy(F.col(label).alias("label_id")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.select(F.sum("n")).scalar()
    c = F.lit(n_classes) if n_classes else counts.select(F.count(F.lit(1))).scalar()
    return counts.select("label_id", "n", (total / (c * F.col("n"))).alias("weight"))
