"""Exact ranks and k-smallest selection within groups, without a group in one task.

``rank_within`` range-partitions narrow rows on (group, key), so a hot group is
spread over many balanced partitions; per (partition, group) counts give each
partition's offset, and the row number is offset + position in the partition.
Positions come from ``monotonically_increasing_id`` on sorted partitions, which
is stable only while the partitioning is; the narrow rows are therefore written
to the shared checkpoint folder first.

``smallest_k`` finds the cut of an integer key by two bounded histograms, which
combine on the map side: no sort.

Both have one plan whatever the size. Joins match null groups with null groups;
which side is broadcast is left to Spark's own size check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerlab.session import cut_lineage


def join_null_safe(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which null matches null; keeps the left's columns of that name."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


#: Bytes of a class table that may go to every task.
CLASS_BYTES = 32 << 20


def class_table(rows: DataFrame, limit: int = CLASS_BYTES) -> DataFrame:
    """A table of one row per class, written once. It goes to every task of the
    joins that read it, so that no class of rows meets in one task, if its size,
    summed over all its rows, is within ``limit`` bytes; beyond it Spark chooses."""
    rows = cut_lineage(rows)
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(rows) if size <= limit else rows


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rn") -> DataFrame:
    """The columns ``group`` and ``order`` with ``out`` = 1-based row number of
    each row inside its group when sorted by ``order`` (which must make the
    order total, e.g. end with an id). Only these columns are moved; join the
    result back by the id."""
    keys = [*group, *order]
    placed = (df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)))
    placed = cut_lineage(placed)
    counts = placed.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    return (join_null_safe(placed, offsets.select("_pid", *group, "_off", "_first"), ["_pid", *group])
            .withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first") + 1)
            .drop("_pid", "_pos", "_off", "_first"))


def smallest_k(df: DataFrame, group: Sequence[str], key: str, tiebreak: str, k, out: str = "in_k") -> DataFrame:
    """Flag ``out`` = true for the k rows of each group with the smallest
    (key, tiebreak); ``key`` is an integer in [0, 2^32). ``k`` is either a
    small DataFrame (group columns + ``k``) or a function from the group size
    column to k (e.g. ``lambda n: ceil(n * 0.2)``).

    A histogram of the high 16 bits per group (at most groups x 65,536 rows,
    combined map-side; it also gives the group size) locates the bucket where
    the k-th row lies; a histogram of the low 16 bits inside that bucket locates
    the exact key; only rows with exactly that key (hash collisions, a handful)
    are ordered by ``tiebreak``. Group, key and tiebreak are written once; these
    narrow rows are read three times, map-side, and ``df`` once more for the flag.
    """
    g = list(group)
    base = cut_lineage(df.select(*g, key, tiebreak)).withColumn("_hi", F.shiftright(F.col(key), 16)).withColumn("_lo", F.col(key).bitwiseAND(0xFFFF))
    # level 1: bucket of the high bits holding the k-th row
    h1 = base.groupBy(*g, "_hi").agg(F.count(F.lit(1)).alias("_c"))
    wg = Window.partitionBy(*g)
    if isinstance(k, DataFrame):
        h1 = join_null_safe(h1, k.select(*g, F.col("k").cast("long").alias("_k")), g)
    else:
        h1 = h1.withColumn("_k", k(F.sum("_c").over(wg)).cast("long"))
    h1 = (h1.withColumn("_cum", F.sum("_c").over(wg.orderBy("_hi")))
          .withColumn("_before", F.col("_cum") - F.col("_c")))
    b1 = (h1.where((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
          .select(*g, F.col("_hi").alias("_bhi"), F.col("_before").alias("_b1"), "_k"))
    b1 = cut_lineage(b1)  # a row for each group
    # level 2: exact key inside that bucket
    inb = join_null_safe(base, b1, g).where(F.col("_hi") == F.col("_bhi"))
    h2 = inb.groupBy(*g, "_lo", "_b1", "_k", "_bhi").agg(F.count(F.lit(1)).alias("_c"))
    h2 = (h2.withColumn("_cum", F.col("_b1") + F.sum("_c").over(wg.orderBy("_lo")))
          .withColumn("_before", F.col("_cum") - F.col("_c")))
    cut = (h2.where((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
           .select(*g, (F.col("_bhi") * 65536 + F.col("_lo")).alias("_kkey"), (F.col("_k") - F.col("_before")).alias("_take")))
    cut = cut_lineage(cut)
    # rows with exactly the cut key: the first _take by tiebreak
    ties = (join_null_safe(base, cut, g).where(F.col(key) == F.col("_kkey"))
            .withColumn("_r", F.row_number().over(Window.partitionBy(*g).orderBy(tiebreak)))
            .where(F.col("_r") <= F.col("_take")).select(*g, tiebreak).withColumn("_tie", F.lit(True)))
    flagged = join_null_safe(join_null_safe(df, cut.select(*g, "_kkey"), g, "left"), ties, [*g, tiebreak], "left")
    flag = F.coalesce(F.col(key) < F.col("_kkey"), F.lit(False)) | F.coalesce(F.col("_tie"), F.lit(False))
    return flagged.withColumn(out, flag).drop("_kkey", "_tie")
