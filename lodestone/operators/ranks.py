"""Ranks over whole tables or large groups, without one task that sorts a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import settle


def indexed(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """df with `__i`, the position from 0 of a row among those of its keys in this order, and
    `__n`, their number. Rows are dealt to ranges of (keys, order), numbered within each range,
    and moved on by the counts of the ranges before: a row for each range and key."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy(*keys, "__part").orderBy(*order)
    # kept, so that ranges drawn twice can't differ
    rows = settle(ranged.withColumn("__i", F.row_number().over(within) - 1))
    counts = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__count"))
    by_key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__count").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = [F.col(k).alias(f"__key_{k}") for k in keys]
    offsets = counts.select(*named, F.col("__part").alias("__of"), before.alias("__before"), F.sum("__count").over(by_key).alias("__n"))
    same = F.col("__part") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return rows.join(offsets, same).select(*df.columns, (F.col("__i") + F.col("__before")).alias("__i"), "__n")
