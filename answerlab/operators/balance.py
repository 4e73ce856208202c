"""Class rebalancing.

Plan shape:
* targets (R1) come from one count per class: a table of C rows;
* down step (R2): an over-full class is cut into ``target`` clusters by k-means
  with many centres (``many_means``), each of which keeps the row nearest to its
  centre; with a given ``k``, Spark ML KMeans and a per-cluster quota by largest
  remainder. Exactly ``target`` distinct rows remain. The rank inside a cluster is the distributed ``rank_within`` over
  ids and distances only (a hot cluster is not one task);
* up step (R3): each source row is repeated ``needed div n`` times plus once
  more for the ``needed mod n`` rows with the smallest seeded hash (exact, by
  two bounded hash histograms, ``ranking.smallest_k``), via
  ``explode(sequence(..))``;
* rewrites (R4-R6): a native character-multiset bound decides most pairs;
  only pairs above it run the exact ratio in an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.operators.many_means import many_means, usable_vectors
from answerlab.operators.neighbours import centroids, dot, norm, sq_dist
from answerlab.operators.ranking import class_table, cut_lineage, join_null_safe, rank_within, smallest_k
from answerlab.operators.similarity import sequence_ratio
from answerlab.operators.stats import split_hash_int


# ------------------------------------------------------------------- R1

def class_targets(counts: DataFrame, strategy: str | int | float = "soft", down_ratio: float = 0.75,
                  label: str = "label", n: str = "n") -> DataFrame:
    """Per-class target counts from (label, n).
    soft: ceiling = int(max * ratio); n >= ceiling -> ceiling, else min(2n, ceiling).
    mean / median -> int of it; majority -> max; a number -> int(number)."""
    w = Window.partitionBy()  # one row per class
    cnt = F.col(n)
    if strategy == "soft":
        ceiling = F.floor(F.max(cnt).over(w) * F.lit(down_ratio)).cast("long")
        target = F.when(cnt >= ceiling, ceiling).otherwise(F.least(cnt * 2, ceiling))
    elif strategy == "mean":
        target = F.floor(F.avg(cnt).over(w)).cast("long")
    elif strategy == "median":
        target = F.floor(F.percentile(cnt, 0.5).over(w)).cast("long")
    elif strategy == "majority":
        target = F.max(cnt).over(w).cast("long")
    else:
        target = F.lit(int(strategy)).cast("long")
    return counts.select(label, cnt.cast("long").alias("n"), target.alias("target"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- R2

def assign_clusters(df: DataFrame, targets: DataFrame, label: str, vec: str, k: int | None = None, seed: int = 42,
                    out: str = "cluster", block: int = 8192) -> DataFrame:
    """Each over-full class in as many clusters as its target, by k-means
    with many centres (:func:`many_means`); rows of other classes get cluster 0; a
    null label is a class; a vector that cannot be used (null, of another length,
    with a null or NaN) counts as the zero vector. With a given ``k`` (never
    lowered) KMeans, one distributed fit per over-full class (classes are few)."""
    targets = class_table(targets)
    if k is None:
        fitting = targets.where(F.col("n") <= F.col("target")).select(F.col("label").alias(label))
        return (join_null_safe(df, fitting, [label]).withColumn(out, F.lit(0))
                .unionByName(many_means(df, targets, label, vec, out, block, seed=seed)))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = usable_vectors(df, vec)
    over = [r["label"] for r in targets.where(F.col("n") > F.col("target")).select("label").collect()]  # C rows at most
    fitting = targets.where(F.col("n") <= F.col("target")).select(F.col("label").alias(label))
    parts = [join_null_safe(df, fitting, [label]).withColumn(out, F.lit(0))]
    for lbl in over:
        rows = df.where(F.col(label).eqNullSafe(F.lit(lbl))).withColumn("_features", array_to_vector(usable))
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out, maxIter=20).fit(rows)
        parts.append(model.transform(rows).drop("_features").withColumn(out, F.col(out).cast("int")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def representatives(df: DataFrame, targets: DataFrame, label: str, cluster: str, vec: str, id_col: str,
                    one_each: bool = False) -> DataFrame:
    """Classes at or below target unchanged; an over-full class keeps
    exactly ``target`` rows: with ``one_each`` (as many clusters as the target)
    the row of each cluster nearest to its centre, else each cluster gets a quota proportional to its size
    (largest remainder, smaller cluster id first on ties) and keeps its rows
    nearest to the cluster centre (distance rounded to 6 places, then id)."""
    t = class_table(targets.select(F.col("label").alias(label), F.col("n").alias("_n"), F.col("target").alias("_t")))
    tagged = join_null_safe(df, t, [label])
    keep_all = tagged.where(F.col("_n") <= F.col("_t")).drop("_n", "_t")
    over = tagged.where(F.col("_n") > F.col("_t"))
    keyed = over.withColumn("_key", F.struct(label, cluster)).withColumn("_v", usable_vectors(df, vec))
    cents = centroids(keyed, "_key", "_v").select(F.col("label").alias("_key"), "centroid")
    dist = keyed.join(cents, "_key").withColumn("_dist", F.round(F.sqrt(sq_dist(F.col("_v"), F.col("centroid"))), 6)).drop("_v")
    if one_each:
        ids = (dist.where(F.col(cluster) < F.col("_t")).groupBy(label, cluster).agg(F.min(F.struct("_dist", id_col)).alias("_first"))
               .select(F.col("_first")[id_col].alias(id_col)))
        # one id a cluster, written once: the filter is put into both branches of the clustering
        return keep_all.unionByName(over.join(cut_lineage(ids), id_col, "left_semi").drop("_n", "_t"))
    sizes = over.groupBy(label, cluster, "_n", "_t").agg(F.count(F.lit(1)).alias("_s"))
    prod = F.col("_t") * F.col("_s")
    sizes = (sizes.withColumn("_base", F.floor(prod / F.col("_n")).cast("long"))
             .withColumn("_rem", prod % F.col("_n")))
    wl = Window.partitionBy(label)  # clusters of one class
    sizes = (sizes.withColumn("_left", F.col("_t") - F.sum("_base").over(wl))
             .withColumn("_rr", F.row_number().over(wl.orderBy(F.desc("_rem"), cluster)))
             .withColumn("_quota", F.col("_base") + F.when(F.col("_rr") <= F.col("_left"), 1).otherwise(0)))
    ranked = rank_within(dist, [label, cluster], ["_dist", id_col], out="_rank")
    ids = (join_null_safe(ranked, sizes.select(label, cluster, "_quota"), [label, cluster])
           .where(F.col("_rank") <= F.col("_quota")).select(id_col))
    return keep_all.unionByName(over.join(ids, id_col, "left_semi").drop("_n", "_t"))


# ------------------------------------------------------------------- R3

def upsample_sources(df: DataFrame, targets: DataFrame, label: str, id_col: str, max_multiplier: float = 2.0,
                     seed: int = 42) -> DataFrame:
    """Rows of classes below target, each with ``copies`` synthetic copies
    to make: needed = min(target, int(n * mult)) - n; every row is used
    needed div n times, plus once for the needed mod n rows with the smallest
    seeded hash. Output: source rows exploded to (.., copy_no)."""
    t = class_table(targets.select(F.col("label").alias(label), F.col("n").alias("_n"),
                                   (F.least(F.col("target"), F.floor(F.col("n") * F.lit(max_multiplier))) - F.col("n")).alias("_need")))
    under = join_null_safe(df, t.where(F.col("_need") > 0), [label]).withColumn("_h", split_hash_int(id_col, seed))
    rem = t.where(F.col("_need") > 0).select(label, (F.col("_need") % F.col("_n")).alias("k"))  # one row per class
    flagged = smallest_k(under, [label], "_h", id_col, rem, out="_extra")
    copies = F.floor(F.col("_need") / F.col("_n")) + F.when(F.col("_extra"), 1).otherwise(0)
    return (flagged.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0)
            .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .drop("_n", "_need", "_h", "_extra"))


# ------------------------------------------------------------------- R4

def character_overlap(a: str, b: str) -> int:
    """Size of the multiset of characters that two texts share."""
    if not a or not b:
        return 0
    one, two = (np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)) for t in (a, b))
    n = min(len(one), len(two))
    return int(np.minimum(one[:n], two[:n]).sum())


@F.arrow_udf(T.LongType())
def _character_overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((character_overlap(x.as_py(), y.as_py()) for x, y in zip(a, b)), pa.int64(), size=len(a))


def with_surface_bound(df: DataFrame, a: str, b: str, out: str = "surface_bound") -> DataFrame:
    """Adds ``out``: upper bound of the difflib ratio of two lower-cased texts,
    2 * (character multiset overlap) / (len a + len b) (difflib's quick_ratio).
    The overlap is counted in one pass over each text."""
    la, lb = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in (a, b))
    total = F.char_length(la) + F.char_length(lb)
    return (df.withColumn("_o", _character_overlap(la, lb))
            .withColumn(out, F.when(total > 0, 2.0 * F.col("_o") / total).otherwise(F.lit(1.0))).drop("_o"))


@F.arrow_udf(T.DoubleType())
def _sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = ((x.as_py(), y.as_py()) for x, y in zip(a, b))
    return pa.array((None if x is None or y is None else sequence_ratio(x.lower(), y.lower()) for x, y in pairs), pa.float64(), size=len(a))


def accept_pairs(df: DataFrame, original: str, rewrite: str, min_div: float = 0.15,
                 vec_a: str | None = None, vec_b: str | None = None, lo: float = 0.6, hi: float = 0.9) -> DataFrame:
    """Accept a rewrite if its character similarity to the original is at
    most 1 - min_div and, when both vectors are present, their cosine lies in
    [lo, hi]. The exact similarity (difflib's ratio, found by hashed windows: ``sequence_ratio``) is computed only for pairs
    whose upper bound exceeds the limit: the others reach the UDF as
    nulls, which it skips (a UDF under ``when`` alone would run on every row)."""
    limit = 1.0 - min_div
    out = with_surface_bound(df, original, rewrite)
    above = F.col("surface_bound") > limit
    a, b = (F.when(above, F.coalesce(F.col(c), F.lit(""))) for c in (original, rewrite))
    out = out.withColumn("surface_ratio", _sequence_ratio(a, b))
    surface_ok = F.col("surface_bound") <= limit
    surface_ok = surface_ok | (F.col("surface_ratio") <= limit)
    ok = surface_ok
    if vec_a and vec_b:
        cos = dot(F.col(vec_a), F.col(vec_b)) / (norm(F.col(vec_a)) * norm(F.col(vec_b)))
        out = out.withColumn("cosine", cos)
        ok = ok & (F.col("cosine").isNull() | F.col("cosine").between(lo, hi))
    return out.withColumn("accepted", F.coalesce(ok, F.lit(False)))


# ------------------------------------------------------------------- R5, R6, R8, R9, P12

def choose_rewrites(cands: DataFrame, id_cols: Sequence[str], attempt: str = "attempt",
                    accepted: str = "accepted") -> DataFrame:
    """First accepted attempt, else the first-pass attempt (0). Groups hold
    the attempts of one row (a handful)."""
    w = Window.partitionBy(*id_cols).orderBy(F.desc(F.col(accepted).cast("int")), attempt)
    return cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def retry_sources(first: DataFrame, cands: DataFrame, rows: DataFrame, id_col: str, source: str = "source_id",
                  attempt: str = "attempt", accepted: str = "accepted", text: str = "rewrite") -> DataFrame:
    """R5 with retries on other rows: ``first`` holds one rewrite per synthetic
    row (``id_col``, ``source``, ``accepted``, ``text``), ``cands`` the retries
    (``id_col``, ``attempt``, ``source`` tried instead, ``accepted``, ``text``).
    An accepted first rewrite stays, else the first accepted retry replaces the
    text and its source, else the first rewrite stays. All columns of ``rows``
    (keyed by ``source``) are carried over from the source that was used."""
    tries = (cands.where(F.coalesce(F.col(accepted), F.lit(False))).groupBy(id_col)
             .agg(F.min_by(F.struct(F.col(source).alias("s"), F.col(text).alias("t")), F.col(attempt)).alias("_retry")))
    use = ~F.coalesce(F.col(accepted), F.lit(False)) & F.col("_retry").isNotNull()
    chosen = first.join(tries, id_col, "left").select(
        id_col, F.when(use, F.col("_retry.s")).otherwise(F.col(source)).alias(source),
        F.when(use, F.col("_retry.t")).otherwise(F.col(text)).alias(text), use.alias("retried"))
    return chosen.join(rows, source, "left")


def augmented_flag(dfs: Sequence[DataFrame], col: str = "is_augmented") -> list[DataFrame]:
    """Add ``col = false`` where missing, only if some input has it."""
    if not any(col in d.columns for d in dfs):
        return list(dfs)
    return [d if col in d.columns else d.withColumn(col, F.lit(False)) for d in dfs]


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def upsample(originals: DataFrame, sources: DataFrame, rewrites: DataFrame, id_col: str, text: str,
             rewrite: str = "rewrite") -> DataFrame:
    """Originals kept; each source copy becomes a synthetic row with the
    chosen rewrite as its text and ``is_augmented = true``. ``rewrites`` may
    hold one text for each copy (``copy_no``) or one for all copies of a row."""
    by = [id_col, "copy_no"] if "copy_no" in rewrites.columns else [id_col]
    syn = (join_null_safe(sources, rewrites.select(*by, F.col(rewrite).alias("_rw")), by, "left")
           .withColumn(text, F.coalesce(F.col("_rw"), F.lit("")))
           .drop("_rw", "copies").withColumn("is_augmented", F.lit(True)))
    syn = syn.select(*[c for c in originals.columns if c in syn.columns], "copy_no", "is_augmented")
    return union_all(augmented_flag([originals, syn]))


def growth_report(df: DataFrame, label: str, flag: str = "is_augmented") -> DataFrame:
    """Per class original + synthetic = total."""
    f = F.coalesce(F.col(flag), F.lit(False))
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(~f).alias("n_original"), F.count_if(f).alias("n_synthetic"), F.count(F.lit(1)).alias("n_total"))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Reproducible order by md5(id|seed): a distributed range sort."""
    return df.withColumn("shuffle_key", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))) \
        .orderBy("shuffle_key", id_col)


def permuted(position: Column, n: int, seed: int = 42, rounds: int = 4) -> Column:
    """A seeded permutation of 0 .. n - 1 as a column expression: a Feistel
    network on the least even number of bits that hold n - 1, walked again while
    the result is n or more (less than four times on average)."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = (1 << half) - 1

    def network(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(mask)
        for r in range(rounds):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(r)).bitwiseAND(mask))
        return F.shiftleft(left, half).bitwiseOR(right)

    # at most three quarters of the numbers are n or more: 96 further walks leave one row in 10^12, which stops with an error
    start = F.struct(network(position.cast("long")).alias("x"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(96)), start,
                         lambda a, _: F.struct(F.when(a["x"] < n, a["x"]).otherwise(network(a["x"])).alias("x")), lambda a: a["x"])
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("no place found")).cast("long"))


def seeded_positions(df: DataFrame, id_col: str, seed: int = 42, out: str = "position") -> DataFrame:
    """R9 without a global sort: each row's place (0 .. n - 1) in a seeded random
    order. Rows are numbered by ids inside hash partitions, which per-partition
    counts make one numbering; a keyed permutation of the numbers gives the
    places. Ids must be unique; the order does not depend on how ``df`` lies."""
    n = df.count()
    buckets = max(64, n >> 20)  # by the number of rows alone: the numbering does not follow the cluster
    rows = df.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = cut_lineage(before)  # a row for each bucket
    at = F.row_number().over(Window.partitionBy("_b").orderBy(id_col)) - 1
    return (rows.withColumn("_at", at).join(F.broadcast(before.select("_b", "_off")), "_b")
            .withColumn(out, permuted(F.col("_off") + F.col("_at"), n, seed)).drop("_b", "_at", "_off"))


def rebalance(df: DataFrame, label: str, id_col: str, vec: str, text: str, rewrites: DataFrame,
              strategy: str | int = "soft", down_ratio: float = 0.75, split_col: str = "split",
              k: int | None = None, max_multiplier: float = 2.0, seed: int = 42) -> DataFrame:
    """Targets once from the train split; down step where a class is above
    target, up step where below; other splits untouched."""
    train = cut_lineage(df.where(F.col(split_col) == "train"))  # six steps read it
    rest = df.where(~F.col(split_col).eqNullSafe("train"))
    targets = class_table(class_targets(class_counts(train, label), strategy, down_ratio))  # every step reads it
    clustered = assign_clusters(train, targets, label, vec, k, seed)
    down = representatives(clustered, targets, label, "cluster", vec, id_col, one_each=k is None).drop("cluster")
    sources = upsample_sources(train, targets, label, id_col, max_multiplier, seed)
    chosen = choose_rewrites(rewrites, [id_col, *[c for c in ("copy_no",) if c in rewrites.columns]])
    up = upsample(down, sources, chosen, id_col, text)
    return union_all(augmented_flag([up, rest]))


# ------------------------------------------------------------------- R10

TransformFn = Callable[..., DataFrame]


def apply_transforms(df: DataFrame, names: Sequence[str], registry: dict[str, TransformFn],
                     label: str | None = None, **params) -> DataFrame:
    """Run the named DataFrame transforms in order (``DataFrame.transform``).
    An unknown name raises KeyError listing the known names; when ``label`` is
    given but missing from the table, the chain is skipped unchanged."""
    for n in names:
        if n not in registry:
            raise KeyError(f"transform {n!r} not found; available: {', '.join(registry)}")
    if label is not None and label not in df.columns:
        return df
    out = df
    for n in names:
        out = out.transform(lambda d, fn=registry[n]: fn(d, **params))
    return out
