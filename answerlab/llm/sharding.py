"""Extendible hashing into shards below a byte limit.

A row's key is 60 bits of an MD5 over all its columns, so only equal rows share
a key. The directory is the binary trie of key prefixes: a bucket above the
limit splits on its next bit, others stay. All bucket sizes come from two
grouped sums: over cells of a prefix length that suits the total (every level
above is summed from the cells), and, for the few cells that are still too
large there, over keys. Nothing but the total size reaches the driver.

Equal rows cannot be told apart by bits; when they exceed the limit together
they fill overflow pages of one bucket (counted, then dealt out again, so a row
that makes up a third of the table is never gathered). One row above the limit
is a shard of its own.

Defined results: null values count as such (not as empty text); null or empty
text has only the fixed row size; an empty table gives no shards; extra columns
are part of the key, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlab.llm.common import salted_join

KEY_BITS = 60
#: Levels of cells below the expected depth of the directory.
_FINER = 5


def key_of(columns: list[str]) -> Column:
    """60 bits of the MD5 over the columns as text."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def _leaves(cells: DataFrame, cell: str, width: int, first: int, limit: int) -> DataFrame:
    """``cell, depth``: the least depth at which the cell's bucket is within the
    limit or holds one key; null where it is so at no depth up to ``width``."""
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(width))))
    levels = levels.withColumn("prefix", F.expr(f"shiftright({cell}, {width} - depth)"))
    fits = (levels.groupBy("depth", "prefix").agg(F.sum("b").alias("_b"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
            .select("depth", "prefix", ((F.col("_b") <= limit) | (F.col("_lo") == F.col("_hi"))).alias("_fits")))
    return (salted_join(levels, fits, ["depth", "prefix"], [cell]).groupBy(cell)
            .agg(F.min(F.when(F.col("_fits"), F.col("depth"))).alias("depth")))


def assign_shards(docs: DataFrame, limit_bytes: int, text_col: str = "text", row_bytes: int = 32,
                  keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and ``n_bytes`` (UTF-8 text plus
    ``row_bytes``), ``depth``, ``bucket`` (prefix bits as text) and ``page`` (0
    but in overflow pages); (bucket, page) names the shard."""
    columns = docs.columns
    keep = keep or columns
    out_cols = [F.col(f"_row.`{c}`").alias(c) for c in keep]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), key_of(columns).alias("_k"),
        (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long") + row_bytes).alias("_b"))
    total = rows.agg(F.sum("_b")).first()[0] or 0
    width = max(1, min(KEY_BITS, math.ceil(math.log2(max(1.0, total / limit_bytes))) + _FINER))
    rows = rows.withColumn("_c", F.shiftright("_k", KEY_BITS - width))

    cells = rows.groupBy("_c").agg(F.sum("_b").alias("b"), F.min("_k").alias("lo"), F.max("_k").alias("hi"))
    by_cell = _leaves(cells, "_c", width, 0, limit_bytes)
    placed = rows.join(by_cell, "_c")
    # Cells that are too large at full width: the same again over their keys.
    large = by_cell.where(F.col("depth").isNull()).select("_c")
    keys = (rows.join(large, "_c").groupBy("_k").agg(F.sum("_b").alias("b"))
            .withColumns({"lo": F.col("_k"), "hi": F.col("_k")}))
    by_key = _leaves(keys, "_k", KEY_BITS, width + 1, limit_bytes).withColumnRenamed("depth", "_deep")
    # Equal rows above the limit (only in cells above it): rows for each overflow page.
    crowded = (rows.join(cells.where(F.col("b") > limit_bytes).select("_c"), "_c").groupBy("_k").agg(F.sum("_b").alias("_kb"), F.count(F.lit(1)).alias("_n"), F.max("_b").alias("_one"))
               .where((F.col("_kb") > limit_bytes) & (F.col("_n") > 1))
               .select("_k", F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.col("_one"))).cast("long").alias("_per")))
    placed = (placed.join(by_key, "_k", "left").join(crowded, "_k", "left")
              .withColumn("depth", F.coalesce("depth", "_deep").cast("int")))
    single = placed.where(F.col("_per").isNull()).select("_row", "_k", "_b", "depth", F.lit(0).cast("long").alias("page"))
    many = (placed.where(F.col("_per").isNotNull()).groupBy("_row", "_k", "_b", "depth", "_per").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("page", F.explode(F.expr("sequence(0L, (_n - 1) div _per)")))
            .withColumn("_i", F.explode(F.expr("sequence(1L, least(_per, _n - page * _per))")))
            .select("_row", "_k", "_b", "depth", "page"))
    bits = F.expr(f"case when depth = 0 then '' else lpad(conv(shiftright(_k, {KEY_BITS} - depth), 10, 2), depth, '0') end")
    return single.union(many).select(*out_cols, F.col("_b").alias("n_bytes"), "depth", bits.alias("bucket"), "page")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, text_col: str = "text", row_bytes: int = 32) -> None:
    """Write every shard as one Parquet file below ``path/bucket=../page=..``."""
    placed = assign_shards(docs, limit_bytes, text_col, row_bytes)
    (placed.withColumn("bucket", F.concat(F.lit("b"), F.col("bucket")))  # not to be read as a number
     .repartition("bucket", "page").write.partitionBy("bucket", "page").parquet(path))
