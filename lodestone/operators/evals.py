"""Scores of retrieval runs, classifiers and experiment arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_score(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """cases (id, gold array), hits (id, rank, path) -> hit@k, mean recall and negatives with hits."""
    found = hits.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("path").alias("paths"))
    rows = cases.join(found, "id", "left").select("gold", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
    good = F.size(F.array_intersect("gold", "paths"))
    positive = F.size("gold") > 0
    return rows.agg(
        F.count_if(positive).alias("positives"),
        F.count_if(positive & (good > 0)).alias("hit"),
        F.avg(F.when(positive, good / F.size("gold"))).alias("recall"),
        F.count_if(~positive).alias("negatives"),
        F.count_if(~positive & (F.size("paths") > 0)).alias("negatives_hit"),
    )


def arm_summary(rows: DataFrame, arm: str, success: str, duration: str, tokens: str) -> DataFrame:
    """Attempts, success rate, durations and tokens by arm; missing tokens are counted apart."""
    return rows.groupBy(arm).agg(
        F.count("*").alias("attempts"),
        F.avg(F.col(success).cast("double")).alias("success_rate"),
        F.max(duration).alias("max_duration"),
        F.sum(tokens).alias("tokens"),
        F.count_if(F.col(tokens).isNull()).alias("tokens_missing"),
    )


def paired_medians(rows: DataFrame, pair: str, arm: str, base: str, other: str, value: str) -> DataFrame:
    """Medians of the difference and the ratio of two arms over the pairs that have both."""
    side = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    both = rows.groupBy(pair).agg(side(base).alias("x"), side(other).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return both.agg(
        F.count("*").alias("pairs"),
        F.percentile(F.col("y") - F.col("x"), 0.5).alias("median_difference"),
        F.percentile(F.when(F.col("x") != 0, F.col("y") / F.col("x")), 0.5).alias("median_ratio"),
    )


def precision_recall(sides: DataFrame) -> DataFrame:
    """Of edges by `side` (shared, left, right), left being found and right true ones only."""
    n = {s: F.count_if(F.col("side") == s) for s in ("shared", "left", "right")}
    return sides.agg(
        n["shared"].alias("shared"), n["left"].alias("left_only"), n["right"].alias("right_only"),
        (n["shared"] / F.nullif(n["shared"] + n["left"], F.lit(0))).alias("precision"),
        (n["shared"] / F.nullif(n["shared"] + n["right"], F.lit(0))).alias("recall"),
    )
