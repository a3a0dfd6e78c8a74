"""Learner model: attempts, mastery replay, scaffolding and review plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import learning as L


def with_attempt_kind(results: DataFrame) -> DataFrame:
    """`attempt`: the given attempt_kind, else `first` for the first result of an exercise
    and `retry` after. To be applied before rows are filtered."""
    nth = F.row_number().over(Window.partitionBy("exercise").orderBy("at", "ord"))
    return results.withColumn("attempt", F.coalesce("attempt_kind", F.when(nth == 1, "first").otherwise("retry")))


def mastery(results: DataFrame, key: str = "unit") -> DataFrame:
    """Mastery by key: the clamped fold of weighted answers in order of time."""
    mode = F.col("grading_mode") if "grading_mode" in results.columns else F.lit(None).cast("string")
    delta = L.evidence_weight(mode, F.col("kind")) * L.answer_weight(F.col("attempt"), F.col("passed"))
    rows = results.select(key, "at", "ord", "passed", delta.alias("delta"))
    # ranges of the history, so that a key with very many rows is folded in several tasks
    ranged = rows.repartitionByRange(key, "at", "ord").withColumn("part", F.spark_partition_id())
    runs = ranged.groupBy(key, "part").agg(
        L.clamped_run(F.transform(F.sort_array(F.collect_list(F.struct("at", "ord", "delta"))), lambda r: r["delta"])).alias("run"),
        F.count("*").alias("attempts"),
        F.count_if("passed").alias("successes"),
        F.max("at").alias("last_at"),
    )
    # one row for each range that holds the key
    whole = runs.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("part", "run"))).alias("runs"), F.sum("attempts").alias("attempts"), F.sum("successes").alias("successes"), F.max("last_at").alias("last_at")
    )
    score = L.composed(F.transform("runs", lambda r: r["run"]))
    return whole.select(
        key, "attempts", "successes", score.alias("score"), (F.col("successes") / F.col("attempts")).alias("success_rate"),
        L.confidence(F.col("attempts")).alias("confidence"), L.level(score).alias("level"), "last_at",
    )


def current_mastery(units: DataFrame) -> DataFrame:
    """The level of the unit practised last, 1 before any."""
    return units.agg(F.coalesce(F.max_by("level", F.struct("last_at", "unit")), F.lit(1)).alias("level"))


def faded_support(results: DataFrame, key: str) -> DataFrame:
    """Counts of samples and hints that fade with passes of 0.8 or more, sample first,
    and come back, hint first, with a failure after that. Starts at 2 and 3."""
    row = F.struct("at", "ord", F.col("passed"), F.coalesce("score", F.lit(1.0)).alias("score"))
    rows = results.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    start = F.struct(F.lit(2).alias("sample"), F.lit(3).alias("hint"), F.lit(False).alias("mastered"))

    def step(s, r):
        good = r["passed"] & (r["score"] >= 0.8)
        sample = F.when(good & (s["sample"] > 0), s["sample"] - 1).when(~r["passed"] & s["mastered"] & (s["hint"] >= 3), F.least(s["sample"] + 1, F.lit(2))).otherwise(s["sample"])
        hint = F.when(good & (s["sample"] == 0), F.greatest(s["hint"] - 1, F.lit(0))).when(~r["passed"] & s["mastered"], F.least(s["hint"] + 1, F.lit(3))).otherwise(s["hint"])
        return F.struct(sample.alias("sample"), hint.alias("hint"), (s["mastered"] | good).alias("mastered"))

    folded = F.aggregate("rows", start, step)
    return rows.select(key, folded["sample"].alias("sample"), folded["hint"].alias("hint"))


def review_plan(reviews: DataFrame, key: str) -> DataFrame:
    """SM-2 over each key's qualities in order of time, and the day the next review is due."""
    rows = reviews.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("at", "ord", F.col("quality").cast("double").alias("q")))).alias("rows"), F.max("at").alias("last_at")
    )
    state = L.sm2_fold(F.transform("rows", lambda r: r["q"]))
    return rows.select(key, state.alias("s"), "last_at").select(
        key, "s.repetitions", "s.interval", "s.easiness", F.date_add(F.to_date("last_at"), F.col("s.interval")).alias("due")
    )


def next_exercise(bank: DataFrame, level: int) -> DataFrame:
    """The exercise within one of the level that is nearest to it."""
    off = F.abs(F.col("difficulty") - level)
    return bank.where(off <= 1).orderBy(off, "difficulty", "external_deps", "id").limit(1)


def set_grade(expected, given):
    """(matched, missing, unexpected, score) of two arrays; the score is 1 if both are empty."""
    matched, missing, extra = F.array_intersect(expected, given), F.array_except(expected, given), F.array_except(given, expected)
    total = F.size(F.array_distinct(expected)) + F.size(extra)
    return F.struct(
        F.size(matched).alias("matched"), F.size(missing).alias("missing"), F.size(extra).alias("unexpected"),
        F.when(total == 0, 1.0).otherwise(F.size(matched) / total).alias("score"),
    )
