"""Usage, cost and latency roll-ups over the journal and the call log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranks import indexed


def token_usage(journal: DataFrame) -> DataFrame:
    """token_usage events as typed rows. A cache-hit counter that wasn't reported stays null."""
    number = lambda k: F.expr(f"try_cast(payload['{k}'] AS BIGINT)")
    return journal.where("type = 'token_usage'").select(
        "at",
        "session_id",
        F.coalesce(F.col("payload")["scene"], F.lit("unknown")).alias("scene"),
        F.coalesce(F.col("payload")["provider"], F.lit("unknown")).alias("provider"),
        (F.col("payload")["mode"] == "degraded").alias("degraded"),
        F.coalesce(number("input_tokens"), F.lit(0)).alias("input"),
        F.coalesce(number("output_tokens"), F.lit(0)).alias("output"),
        number("cache_hit_tokens").alias("cache_hit"),
    )


def cost_columns() -> dict[str, Column]:
    """Turns, tokens and cache hits, each hit held between 0 and its row's input."""
    hit = F.least("input", F.greatest(F.lit(0), F.coalesce("cache_hit", F.lit(0))))
    return {
        "turns": F.count("*"),
        "input_tokens": F.sum("input"),
        "cache_hit_tokens": F.sum(hit),
        "billed_tokens": F.sum(F.col("input") - hit),
        "output_tokens": F.sum("output"),
        "degraded": F.count_if(F.coalesce("degraded", F.lit(False))),
    }


def monthly_cost(usage: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """The sums of the UTC month of `as_of`, in all or by scene, provider or day."""
    month = usage.where(F.date_trunc("month", "at") == F.date_trunc("month", as_of))
    return month.groupBy(*(by or [])).agg(*[c.alias(n) for n, c in cost_columns().items()])


def price(billed: Column, hits: Column, output: Column, rate_in: float, rate_hit: float | None, rate_out: float) -> Column:
    """Dollars at rates per million; without a hit rate, hits cost as input."""
    return (billed * rate_in + hits * (rate_in if rate_hit is None else rate_hit) + output * rate_out) / 1_000_000


def percentile_at(df: DataFrame, keys: list[str], value: str, share: float, kind: str = "floor_n") -> DataFrame:
    """Percentile by rank. floor_n: element floor(n * share); floor_n1: floor((n - 1) * share),
    both counted from 0 and held to the last; median: mean of the middle two; upper: element floor(n / 2)."""
    ranked = indexed(df.where(F.col(value).isNotNull()).select(*keys, value), keys, F.col(value))
    n = F.col("__n")
    at = {
        "floor_n": F.least(n - 1, F.floor(n * share)),
        "floor_n1": F.least(n - 1, F.floor((n - 1) * share)),
        "upper": F.floor(n / 2),
    }
    hit = F.col("__i").between(F.floor((n - 1) / 2), F.floor(n / 2)) if kind == "median" else F.col("__i") == at[kind]
    return ranked.where(hit).groupBy(*keys).agg(F.avg(value).alias("percentile"))


def keyed_top(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Count by key, the most frequent first, ties by key: a distributed top-k."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(limit)


def gap_bands(calls: DataFrame, keys: list[str], at: str, bands: list[tuple[str, int]]) -> DataFrame:
    """Calls with the seconds since the one before within their keys, and the band they fall into."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at, "ord"))
    gap = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))
    band = F.when(gap.isNull(), "first")
    for name, below in bands:
        band = band.when(gap < below, name)
    return calls.withColumn("gap", gap).withColumn("band", band.otherwise("longer"))
