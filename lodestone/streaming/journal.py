"""Structured Streaming over journals: idempotent contributions, daily usage, review state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.logs import JOURNAL, NAMES


def read_stream(spark: SparkSession, folder: str, schema: str = JOURNAL) -> DataFrame:
    """New journal files of a folder, each once; the checkpoint of the sink is the watermark."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder).where("id IS NOT NULL").withColumnsRenamed(NAMES)


def contributions(events: DataFrame, late: str = "1 day") -> DataFrame:
    """exercise_result events, each id once within the watermark, with a deterministic id."""
    p = F.col("payload")
    rows = events.where("type = 'exercise_result'").withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", "repository_id", "id"), 256), 1, 24).alias("contribution_id"), "at", "repository_id",
        p["exercise_id"].alias("exercise_id"), F.coalesce(p["unit_id"], p["target_unit_id"]).alias("unit_id"), F.coalesce(p["kind"], F.lit("unknown")).alias("kind"),
        p["score"].cast("double").alias("score"), (p["passed"] == "true").alias("passed"),
    )


def daily_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Tokens by UTC day in tumbling windows."""
    p = F.col("payload")
    rows = events.where("type = 'token_usage'").withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 day")).agg(
        F.count("*").alias("turns"), F.sum(p["input_tokens"].cast("long")).alias("input_tokens"), F.sum(p["output_tokens"].cast("long")).alias("output_tokens")
    ).select(F.to_date("window.start").alias("day"), "turns", "input_tokens", "output_tokens")


def _review(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    reps, interval, ease = state.get if state.exists else (0, 0, 2.5)
    rows = pd.concat(list(frames)).sort_values(["at", "contribution_id"])
    for score in rows["score"].fillna(0.0):
        q = 5 if score >= 0.95 else 4 if score >= 0.8 else 3 if score >= 0.6 else 2 if score >= 0.4 else 1 if score > 0 else 0
        ease = max(1.3, ease + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))
        reps = 0 if q < 3 else reps + 1
        interval = 1 if q < 3 or reps == 1 else 6 if reps == 2 else max(1, int(interval * ease + 0.5))
    state.update((reps, interval, ease))
    yield pd.DataFrame([(key[0], reps, interval, ease)], columns=["exercise_id", "repetitions", "interval", "easiness"])


def review_state(contributed: DataFrame) -> DataFrame:
    """SM-2 state by exercise, kept between batches; each batch returns the exercises it changed."""
    return contributed.groupBy("exercise_id").applyInPandasWithState(
        _review, "exercise_id string, repetitions int, interval int, easiness double", "reps int, interval int, ease double", "update", GroupStateTimeout.NoTimeout
    )
