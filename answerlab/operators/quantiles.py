"""Exact quantiles of any numeric column, without a group in one task.

``F.percentile`` keeps a map of all distinct values of a group in one task. Here
values become 64-bit keys of the same order, and every wanted rank is located by
histograms of 16 bits at a time: at most 65,536 counts for each group and rank,
combined on the map side. Integers of a small range need one histogram, doubles
four at most. Group and key are written once (narrow rows) and read once for each
histogram.

The result is that of ``F.percentile`` (linear interpolation between the two
ranks around p (n - 1)); nulls are left out, NaN is the largest value, a group
without values has null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlab.operators.ranking import join_null_safe
from answerlab.session import cut_lineage

_LOW, _SIGN, _BITS = (1 << 63) - 1, -(1 << 63), 16


def _java(method: str, x: Column) -> Column:
    return F.reflect(F.lit("java.lang.Double"), F.lit(method), x)


def order_key(x: Column, integral: bool) -> Column:
    """64 bits whose unsigned order is the order of the values."""
    if integral:
        return x.cast("long").bitwiseXOR(F.lit(_SIGN))
    bits = _java("doubleToLongBits", F.coalesce(x.cast("double"), F.lit(0.0)) + F.lit(0.0)).cast("long")  # -0.0 is 0.0
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(-1))).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def key_value(key: Column, integral: bool) -> Column:
    """The value of a key, as a double."""
    if integral:
        return key.bitwiseXOR(F.lit(_SIGN)).cast("double")
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_SIGN))).otherwise(key.bitwiseXOR(F.lit(-1)))
    return _java("longBitsToDouble", bits).cast("double")


def _above(key: str, shift: int) -> Column:
    """The bits above ``shift``."""
    return F.shiftrightunsigned(F.col(key), shift) if shift < 64 else F.lit(0).cast("long")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], group: Sequence[str] = (), out: str = "q") -> DataFrame:
    """One row per group (``group`` columns; one row without any): ``out``, the
    quantiles ``probs`` as array<double>."""
    integral = isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    names = [f"_g{i}" for i in range(len(group))] or ["_g0"]
    keys = [F.col(c).alias(n) for c, n in zip(group, names)] or [F.lit(0).alias("_g0")]
    rows = cut_lineage(df.select(*keys, F.when(F.col(col).isNotNull(), order_key(F.col(col), integral)).alias("_key")))
    # no sum over groups here: extremes only, to skip leading bits that all keys share
    ends = rows.agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).first()
    groups = rows.groupBy(*names).agg(F.count("_key").alias("_n"))
    if ends["lo"] is None:
        found = groups.select(*names, F.lit(None).cast("array<double>").alias(out))
        return found.select(*[F.col(n).alias(c) for n, c in zip(names, group)], out)
    differ = (ends["lo"] ^ ends["hi"]) & ((1 << 64) - 1)
    if ends["lo"] < 0 <= ends["hi"]:
        differ = (1 << 64) - 1  # signed extremes do not bound the unsigned order
    shifts = [_BITS * i for i in reversed(range(max(1, -(-differ.bit_length() // _BITS))))]

    def place(p: float, up: bool) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        return (F.ceil(at) if up else F.floor(at)).cast("long")

    state = (groups.where(F.col("_n") > 0)
             .select(*names, F.explode(F.array_distinct(F.array(*[place(p, up) for p in probs for up in (False, True)]))).alias("_want"))
             .withColumn("_rank", F.col("_want")).withColumn("_pre", F.lit((ends["lo"] & ((1 << 64) - 1)) >> (shifts[0] + _BITS)).cast("long")))
    for shift in shifts:
        state = cut_lineage(state)  # groups x ranks
        part = rows.where(F.col("_key").isNotNull()).withColumn("_pre", _above("_key", shift + _BITS)) \
            .withColumn("_digit", _above("_key", shift).bitwiseAND(0xFFFF))
        if shift != shifts[0]:
            part = join_null_safe(part, state.select(*names, "_pre").distinct(), [*names, "_pre"])
        counts = part.groupBy(*names, "_pre", "_digit").agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*names, "_pre").orderBy("_digit"))
        counts = counts.withColumn("_cum", upto).withColumn("_before", F.col("_cum") - F.col("_c"))
        state = (join_null_safe(state, counts, [*names, "_pre"]).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_cum")))
                 .select(*names, "_want", (F.col("_rank") - F.col("_before")).alias("_rank"),
                         F.shiftleft("_pre", _BITS).bitwiseOR(F.col("_digit")).alias("_pre")))
    values = (state.withColumn("_value", key_value(F.col("_pre"), integral))
              .groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_want", "_value"))).alias("_at")))

    def quantile(p: float) -> Column:
        at, low, high = F.lit(float(p)) * (F.col("_n") - 1), place(p, False), place(p, True)
        one, two = F.col("_at")[low], F.col("_at")[high]
        return F.when((low == high) | (one == two), one).otherwise((high - at) * one + (at - low) * two)

    both = join_null_safe(groups, values, names, "left")
    done = F.when(F.col("_n") > 0, F.array(*[quantile(p) for p in probs]))
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, group)], done.alias(out))
