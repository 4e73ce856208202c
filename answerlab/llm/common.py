"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlab.session import checkpoint_dir

#: Word separators of the contracts: space and the ASCII controls 9 to 13.
WORD_GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan of one whole table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder of ``spark.checkpoint.dir``
    and read it back: cuts the lineage, and a lost executor loses nothing.
    ``files``: at most so many files, for tables known to be small (many tiny
    files cost more memory and time than their rows)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/answerlab-{label}-{uuid.uuid4().hex}"
    (df if files is None else df.coalesce(files)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_array(text: Column) -> Column:
    """Words (maximal runs of non-separators) of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def own_names(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Select the columns an operator needs under names of its own, by position,
    so that extra columns of the input, whatever their names, cannot clash."""
    at = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return at.select(*[F.col(f"c{df.columns.index(src)}").alias(own) for own, src in wanted.items()])


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str] | None = None, how: str = "inner",
                salts: int = 8) -> DataFrame:
    """Join a side that may be hot in ``keys`` to a side unique in them: left
    rows are salted by the columns ``spread`` (default: by row), right rows
    copied once per salt, so one key's rows go to ``salts`` tasks."""
    by = F.xxhash64(*spread) if spread else F.monotonically_increasing_id()
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (left.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int"))
            .join(salted, [*keys, "_salt"], how).drop("_salt"))
