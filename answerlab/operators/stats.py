"""Splits, label maps and label statistics (L1-L11), buckets.

Scalars that every row needs (thresholds, totals, min/max) are attached as
scalar subqueries (``DataFrame.scalar()``): Spark runs the one-row aggregate
first and inlines the value, so no join and no single-partition window over
the data is involved. Quantiles are exact and located by histograms (``quantiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlab.functions.text import py_strip, word_count
from answerlab.operators.quantiles import exact_quantiles
from answerlab.operators.ranking import join_null_safe, smallest_k
from answerlab.session import cut_lineage


def split_hash(id_col: str | Column, seed: int = 42) -> Column:
    """Stateless uniform value in [0, 1) from an id and a seed: the first 32
    bits of md5(id|seed). Partition-independent and shuffle-free."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    hexpart = F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8)
    return F.conv(hexpart, 16, 10).cast("double") / F.lit(4294967296.0)


def split_examples(df: DataFrame, id_col: str = "doc_id", test_size: float = 0.2, seed: int = 42,
                   out: str = "split") -> DataFrame:
    """L1: the same seed always gives the same train/validation split."""
    return df.withColumn(out, F.when(split_hash(id_col, seed) < test_size, F.lit("validation"))
                         .otherwise(F.lit("train")))


def split_hash_int(id_col: str | Column, seed: int = 42) -> Column:
    """The same hash as ``split_hash`` as an integer in [0, 2^32)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")


def exact_split(df: DataFrame, id_col: str = "doc_id", test_size: float = 0.2, seed: int = 42,
                out: str = "split", strata: Sequence[str] = ()) -> DataFrame:
    """L2: exactly ceil(test_size * n) rows (per stratum) go to validation: the
    rows with the smallest (hash, id), found by two bounded hash histograms
    (ranking.smallest_k: no sort of the data, nothing materialised)."""
    grp = list(strata) or ["_all"]
    h = df.withColumn("_hk", split_hash_int(id_col, seed))
    if not strata:
        h = h.withColumn("_all", F.lit(0))
    flagged = smallest_k(h, grp, "_hk", id_col, lambda n: F.ceil(n * F.lit(test_size)))
    return (flagged.withColumn(out, F.when(F.col("in_k"), F.lit("validation")).otherwise(F.lit("train")))
            .drop("_hk", "in_k", "_all"))


def label_map(train: DataFrame, col: str) -> DataFrame:
    """L3: distinct non-blank labels, alphabetical, dense ids from 0. The
    window runs on the distinct labels only (one row per class)."""
    labels = train.where(F.col(col).isNotNull() & (py_strip(col) != "")).select(F.col(col).alias("label")).distinct()
    return labels.withColumn("label_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))


def class_weights(train: DataFrame, lmap: DataFrame, col: str) -> DataFrame:
    """L4: N / (C * count_c); a class without rows gets 0.0; rows with an
    unmapped label are not counted in N."""
    counts = train.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = lmap.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy()  # one row per class
    total, classes = F.sum("n").over(w), F.count(F.lit(1)).over(w)
    return t.select("label", "label_id", F.col("n").cast("long").alias("n"),
                    F.when(F.col("n") > 0, total / (classes * F.col("n"))).otherwise(F.lit(0.0)).alias("weight"))


def label_distribution(df: DataFrame, lmap: DataFrame, col: str, split_col: str = "split",
                       splits: Sequence[str] = ("train", "validation")) -> DataFrame:
    """Count per split and label; every mapped label present (0 filled) and
    ``<unmapped>`` for rows whose label has no id (only when there are such rows)."""
    m = F.broadcast(lmap.select(F.col("label").alias("_l")))
    tagged = df.join(m, df[col] == m["_l"], "left").select(
        split_col, F.coalesce(F.col("_l"), F.lit("<unmapped>")).alias("label"))
    wide = tagged.groupBy("label").pivot(split_col, list(splits)).agg(F.count(F.lit(1)))
    full = (lmap.select("label").unionByName(wide.where(F.col("label") == "<unmapped>").select("label"))
            .join(wide, "label", "left").na.fill(0, list(splits)))
    long = full.unpivot("label", list(splits), split_col, "n")
    return long.where((F.col("label") != "<unmapped>") | (F.col("n") > 0)).select(
        split_col, "label", F.col("n").cast("long").alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count and share per value. The total is a scalar subquery."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("share", F.col("n") / total))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Contingency counts, one column per value of ``b`` (values given, so
    the pivot needs no extra job)."""
    return df.groupBy(F.col(a)).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0)


def crosstab_pct(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Contingency table normalised per row, in percent."""
    ct = crosstab(df, a, b, values)
    row_sum = sum((F.col(f"`{v}`") for v in values), F.lit(0))
    return ct.select(a, *[(F.col(f"`{v}`") * 100.0 / row_sum).alias(v) for v in values])


def describe_lengths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max
    per column, in long form (one row per column). The columns are stacked, so
    that one selection finds the quartiles of all of them."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in cols])))
    plain = long.groupBy("column").agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
                                       F.min("_x").alias("min"), F.max("_x").alias("max"))
    q = exact_quantiles(long, "_x", [0.25, 0.5, 0.75], ["column"], "_q")
    return join_null_safe(plain, q, ["column"]).select(
        "column", "count", "mean", "std", "min", *[F.col("_q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def length_stats_by_label(df: DataFrame, label: str, text: str, limits: Sequence[int] = (300, 500)) -> DataFrame:
    """Per label mean, median, min, max of the text length in characters
    and the share of rows within each limit."""
    ln = F.char_length(F.col(text))
    lengths = df.select(F.col(label).alias("label"), ln.alias("_n"))
    plain = lengths.groupBy("label").agg(
        F.avg("_n").alias("mean"), F.min("_n").alias("min"),
        F.max("_n").alias("max"), *[F.avg((F.col("_n") <= n).cast("double")).alias(f"share_within_{n}") for n in limits])
    q = exact_quantiles(lengths, "_n", [0.5], ["label"], "_q")
    return join_null_safe(plain, q, ["label"]).select(
        "label", "mean", F.col("_q")[0].alias("median"), "min", "max", *[f"share_within_{n}" for n in limits])


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; every bin listed.
    Integer columns are binned with integer arithmetic (exact)."""
    x = F.col(col)
    # staged as one column, so that the range is one subquery however often it is used
    mm = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = F.col("_mm.lo"), F.col("_mm.hi")
    is_int = dict(df.dtypes)[col] in ("int", "bigint", "smallint", "tinyint")
    if is_int:
        b = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.floor(((x - lo) * bins) / (hi - lo)), F.lit(bins - 1)))
    else:
        b = F.when(hi == lo, F.lit(0)).otherwise(
            F.least(F.floor((x.cast("double") - lo) * bins / (hi - lo)), F.lit(bins - 1)))
    counts = df.where(x.isNotNull()).withColumn("_mm", mm).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo).cast("double") / bins
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), mm.alias("_mm"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def length_category(df: DataFrame, text: str, train_filter: Column | None = None,
                    out: str = "length_category") -> DataFrame:
    """B1: word-count tertiles of the training rows (linear interpolation at
    33.33 and 66.67) as thresholds; <= p33 Short, <= p67 Medium, else Large.
    Only rows matching ``train_filter`` are categorised; others get null."""
    base = df if train_filter is None else df.where(train_filter)
    p = exact_quantiles(base.select(word_count(text).alias("_wc")), "_wc", [0.3333, 0.6667]).select("q").scalar()
    wc = F.col("_wc")
    cat = F.when(wc <= F.col("_p")[0], F.lit("Short")).when(wc <= F.col("_p")[1], F.lit("Medium")).otherwise(F.lit("Large"))
    if train_filter is not None:
        cat = F.when(train_filter, cat)
    return df.withColumn("_wc", word_count(text)).withColumn("_p", p).withColumn(out, cat).drop("_wc", "_p")


def quantile_bins(df: DataFrame, col: str, q: int = 3, out: str = "qbin") -> tuple[DataFrame, DataFrame]:
    """B2: equal-frequency bins (right-closed, lowest value included); equal
    edges collapse. Returns (rows with bin index, edge table)."""
    x = F.col(col).cast("double")
    probs = [i / q for i in range(q + 1)]
    e = cut_lineage(exact_quantiles(df.select(x.alias("_x")), "_x", probs)).select("q").scalar()  # one row, read for each edge
    # bin = number of distinct interior edges strictly below x
    n_below = sum((F.when((e[i] > e[i - 1]) & (e[i] < x), 1).otherwise(0) for i in range(1, q)), F.lit(0))
    rows = df.withColumn(out, F.when(x.isNotNull(), n_below.cast("int")))
    edges = df.sparkSession.range(1).select(F.posexplode(F.array_distinct(e)).alias("edge_no", "edge"))
    return rows, edges


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 5) -> DataFrame:
    """Equal-width right-closed bins of x over its range (the lowest value
    falls in the first bin); mean of y per non-empty bin."""
    xc = F.col(x).cast("double")
    mm = df.agg(F.struct(F.min(xc).alias("lo"), F.max(xc).alias("hi"))).scalar()
    lo, hi = F.col("_mm.lo"), F.col("_mm.hi")
    w = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(0)).otherwise(F.greatest(F.least(F.ceil((xc - lo) / w) - 1, F.lit(bins - 1)), F.lit(0)))
    return (df.where(xc.isNotNull()).withColumn("_mm", mm).groupBy(b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("mean"), F.any_value("_mm").alias("_mm"))
            .select("bin", (lo + F.col("bin") * w).alias("lo"), (lo + (F.col("bin") + 1) * w).alias("hi"), "n", "mean"))
