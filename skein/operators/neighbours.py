"""The row before each row within a key, where one key may hold a third of all rows.

A window over a key puts the whole key into one task. Here the key is split into buckets of its
order first: a window inside (key, bucket) finds most neighbours, and a second window over one
row per (key, bucket) finds the last row of the bucket before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, bucket: Column, order: list[str], carry: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds prefix + c for every c of carry: its value in the row before in `order` within `key`.

    bucket must not decrease along the order and should keep buckets small; `order` must be
    total within the key for a defined result. The first row of a key gets nulls, as does a row
    whose predecessor's value is null. Null keys form one group of their own.
    """
    row = F.struct(*(F.col(c).alias(c) for c in carry))
    rows = df.withColumn("__b", bucket)
    inner = Window.partitionBy(key, "__b").orderBy(*order)
    rows = rows.withColumn("__p", F.lag(row).over(inner)).withColumn("__first", F.row_number().over(inner) == 1)
    place = F.struct(*(F.col(c) for c in order))
    last = rows.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__kb")).agg(F.max_by(row, place).alias("__last"))
    before = last.select("__k", "__kb", F.lag("__last").over(Window.partitionBy("__k").orderBy("__kb")).alias("__before"))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
    previous = F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__p"))
    return joined.select(*(F.col(c) for c in df.columns), *(previous[c].alias(prefix + c) for c in carry))


def with_running(df: DataFrame, key: str, bucket: Column, order: list[str], amount: Column, out: str) -> DataFrame:
    """Adds out: the sum of `amount` over the rows before this one in `order` within `key`, 0 for the first.

    Split by buckets like with_previous: sums inside (key, bucket) plus the totals of the buckets
    before. Null amounts count as 0.
    """
    value = F.coalesce(amount, F.lit(0)).cast("bigint")
    rows = df.withColumn("__b", bucket).withColumn("__a", value)
    inner = Window.partitionBy(key, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__s", F.coalesce(F.sum("__a").over(inner), F.lit(0)))
    totals = rows.groupBy(F.col(key).alias("__k"), F.col("__b").alias("__kb")).agg(F.sum("__a").alias("__t"))
    outer = Window.partitionBy("__k").orderBy("__kb").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__k", "__kb", F.coalesce(F.sum("__t").over(outer), F.lit(0)).alias("__before"))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__kb")), "left")
    return joined.select(*(F.col(c) for c in df.columns), (F.col("__s") + F.col("__before")).alias(out))
