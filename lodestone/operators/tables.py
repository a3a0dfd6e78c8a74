"""Keep-latest, upsert and delete over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in `order`. Ranked per key before the shuffle ends (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Partial-column upsert: for each key and column the latest value that isn't null."""
    rows = old.unionByName(new, allowMissingColumns=True)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*last)


def first_per_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-ignore: the earliest row of each id stands."""
    return keep_latest(df, [key], F.col(order))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Batched delete by key; null keys are kept, unlike NOT IN."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def schema_gaps(declared: DataFrame, actual: DataFrame) -> list[tuple[str, str]]:
    """Declared columns, by name and type, that a table lacks."""
    have = {f.name for f in actual.schema}
    return [(f.name, f.dataType.simpleString()) for f in declared.schema if f.name not in have]
