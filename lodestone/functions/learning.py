"""Scores and weights of the learner model. The constants are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = {"execution": 1.0, "set_match": 0.8, "rubric": 0.5}
EXECUTED_KINDS = ("patch_edit", "author_function")
MAX_SCORE = 5.0


def evidence_weight(mode: Column, kind: Column) -> Column:
    """By how an answer was graded; older results without a known mode go by the exercise's kind."""
    out = F.when(kind == "llm_rubric", EVIDENCE["rubric"]).when(kind.isin(*EXECUTED_KINDS), EVIDENCE["execution"]).otherwise(EVIDENCE["set_match"])
    for name, weight in EVIDENCE.items():
        out = F.when(mode == name, weight).otherwise(out)
    return out


def answer_weight(attempt: Column, passed: Column) -> Column:
    """What an answer counts: a review that is passed counts half, one that is failed more than another failure."""
    review = attempt == "review"
    return F.when(passed, F.when(review, 0.5).otherwise(1.0)).otherwise(F.when(review, -1.0).otherwise(-0.6))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamped_fold(deltas: Column, low: float = 0.0, high: float = MAX_SCORE) -> Column:
    """A running sum held between the bounds at every step; the order of the array matters."""
    return F.aggregate(deltas, F.lit(0.0), lambda acc, d: clamp(acc + d, low, high))


# A run of clamped steps x -> min(high, max(low, x + d)) is itself of the form min(hi, max(lo, x + add)),
# so runs of a long history are folded apart and then composed in order.
def clamped_run(deltas: Column, low: float = 0.0, high: float = MAX_SCORE) -> Column:
    """The steps of an array as one struct (lo, hi, add)."""
    start = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0.0).alias("add"))
    step = lambda f, d: F.struct(clamp(f["lo"] + d, low, high).alias("lo"), clamp(f["hi"] + d, low, high).alias("hi"), (f["add"] + d).alias("add"))
    return F.aggregate(deltas, start, step)


def composed(runs: Column, start: float = 0.0) -> Column:
    """The value that an array of runs, in order, leads to."""
    return F.aggregate(runs, F.lit(start), lambda x, f: F.least(f["hi"], F.greatest(f["lo"], x + f["add"])))


def level(score: Column) -> Column:
    """The nearest of the levels 0 to 5, halves upwards; sums of tenths are rounded first, so that their order doesn't matter."""
    return F.floor(F.round(score, 9) + 0.5).cast("int")


def confidence(attempts: Column) -> Column:
    return F.least(F.lit(1.0), attempts / 5)


def quality_for_score(score: Column) -> Column:
    """Recall quality 0-5 of a score 0-1."""
    return F.when(score >= 0.95, 5).when(score >= 0.8, 4).when(score >= 0.6, 3).when(score >= 0.4, 2).when(score > 0, 1).otherwise(0)


def sm2_step(state: Column, quality: Column) -> Column:
    """One SM-2 review: struct(repetitions, interval, easiness) -> the same after an answer."""
    q = clamp(F.floor(quality + 0.5), 0, 5).cast("double")
    miss = F.lit(5.0) - q
    ease = F.greatest(F.lit(1.3), state["easiness"] + 0.1 - miss * (F.lit(0.08) + miss * 0.02))
    reps = F.when(q < 3, 0).otherwise(state["repetitions"] + 1).cast("int")
    interval = (
        F.when(q < 3, F.lit(1)).when(reps == 1, 1).when(reps == 2, 6).otherwise(F.greatest(F.lit(1.0), F.floor(state["interval"] * ease + 0.5))).cast("int")
    )
    return F.struct(reps.alias("repetitions"), interval.alias("interval"), ease.alias("easiness"))


def sm2_fold(qualities: Column) -> Column:
    start = F.struct(F.lit(0).alias("repetitions"), F.lit(0).alias("interval"), F.lit(2.5).cast("double").alias("easiness"))
    return F.aggregate(qualities, start, sm2_step)
