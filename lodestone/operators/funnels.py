"""Readings of a journal and of the call log: ledgers, latency, and the funnels of asking and practice.

Counts are conditional aggregates with a map-side part: one row a repository (or scene, or
route), whatever the number of events. Percentiles go by rank over ranges, so that no task
sorts a route. Missing values are told apart from zeros where the readings do so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.usage import percentile_at

UNKNOWN = "(scene not recorded)"
# What the funnels count by.
FACETS = ("goal", "range")
CAUSES = ("expired", "new_question", "claim_missed")
SOURCES = ("llm", "cache", "rule", "review", "code")
STAGES = ("no_candidates", "no_target", "llm_generate", "guard", "no_provider", "provider_error", "proposal_shape", "sandbox_unavailable", "harness_validation")
FAMILIES = ("comprehension", "code", "llm")
OUTCOMES = ("accepted", "passed", "failed", "no-verdict")


def _p(key: str) -> Column:
    return F.col("payload")[key]


def _scene(scene: Column) -> Column:
    return F.coalesce(F.nullif(scene, F.lit("")), F.lit(UNKNOWN))


def token_ledger(journal: DataFrame) -> DataFrame:
    """Per repository and scene: turns and tokens, and how many turns did and didn't report cache hits. A
    count that isn't a number is zero; a payload without the key counts as reported, a null as not."""
    number = lambda key: F.coalesce(F.try_to_number(_p(key), F.lit("999999999999999999")).cast("long"), F.lit(0))
    silent = F.map_contains_key("payload", F.lit("cache_hit_tokens")) & _p("cache_hit_tokens").isNull()
    rows = journal.where("type = 'token_usage'").withColumn("scene", _scene(_p("scene")))
    return rows.groupBy("repository_id", "scene").agg(
        F.count("*").alias("calls"), F.sum(number("input_tokens")).alias("input"), F.sum(number("output_tokens")).alias("output"), F.count_if(silent).alias("cache_silent"), F.count_if(~silent).alias("cache_told")
    )


def with_percentiles(groups: DataFrame, rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups with a column for each share: the element floor(n * share) of the known values."""
    for name, share in shares.items():
        at = percentile_at(rows, keys, value, share).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("percentile").alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        groups = groups.join(at, same, "left").drop(*[f"__{k}" for k in keys])
    return groups


def call_profile(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls by scene, tier or both: failures, time-outs, retries, tokens, hit rate of the calls that report hits, p50, p90 and p95
    of milliseconds, and the most frequent error."""
    rows = calls.withColumn("scene", _scene(F.col("scene"))) if "scene" in calls.columns else calls
    failed = F.col("ok") == F.lit(False)
    told = F.col("cache_hit").isNotNull()
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("failed"), F.count_if(F.coalesce("error", F.lit("")).contains("timeout")).alias("timeouts"),
        F.sum(F.greatest(F.coalesce("attempts", F.lit(1)) - 1, F.lit(0))).cast("long").alias("retries"), F.sum(F.coalesce("input", F.lit(0))).alias("input"), F.sum(F.coalesce("output", F.lit(0))).alias("output"),
        F.count_if(told).alias("told"), (F.sum("cache_hit") / F.greatest(F.lit(1), F.sum(F.coalesce("input", F.lit(0))))).alias("hit_rate"),
    )
    errors = rows.where("error IS NOT NULL").groupBy(*keys, "error").agg(F.count("*").alias("n"))
    worst = errors.groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(F.min(F.struct((-F.col("n")).alias("n"), "error")).alias("w"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    groups = groups.join(worst, same, "left").withColumn("top_error", F.col("w.error")).drop("w", *[f"e_{k}" for k in keys])
    return with_percentiles(groups, rows, keys, "ms", {"p50": 0.5, "p90": 0.9, "p95": 0.95})


def route_latency(requests: DataFrame, limit: int = 12) -> DataFrame:
    """(route, n, p50, p95) of the most frequent routes: requests (method, url, ms) with a duration, but the companion's."""
    route = F.concat_ws(" ", F.coalesce("method", F.lit("?")), T.mask_ids(F.coalesce("url", F.lit("?"))))
    rows = requests.where(F.col("ms").isNotNull() & ~F.contains(F.coalesce("url", F.lit("")), F.lit("/companion/"))).select(route.alias("route"), "ms")
    top = rows.groupBy("route").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "route").limit(limit)
    shown = rows.join(top.select("route"), "route", "left_semi")
    return with_percentiles(top, shown, ["route"], "ms", {"p50": 0.5, "p95": 0.95})


def _counts(kind: str, key: str, values: tuple[str, ...], prefix: str, also: Column | None = None) -> list[Column]:
    when = F.col("type") == kind
    when = when if also is None else when & also
    return [F.count_if(when & (_p(key) == v)).alias(f"{prefix}_{v}".replace("-", "_")) for v in values]


def ask_funnel(journal: DataFrame) -> DataFrame:
    """Per repository: map turns, questions asked by facet, refused, claimed, and discarded by cause; the share of turns that asked and
    of questions that were claimed."""
    ask = lambda outcome: (F.col("type") == "turn_asked") & (_p("outcome") == outcome)
    turns, asked, claimed = F.count_if((F.col("type") == "turn_text") & (_p("scene") == "map_chat")), F.count_if(ask("asked")), F.count_if(ask("claimed"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return journal.groupBy("repository_id").agg(
        turns.alias("turns"), asked.alias("asked"), *_counts("turn_asked", "facet", FACETS, "asked", _p("outcome") == "asked"), F.count_if(ask("refused")).alias("refused"), claimed.alias("claimed"),
        F.count_if(ask("discarded")).alias("discarded"), *_counts("turn_asked", "reason", CAUSES, "discarded", _p("outcome") == "discarded"), share(asked, turns).alias("asked_share"), share(claimed, asked).alias("claimed_share"),
    )


def practice_funnel(journal: DataFrame) -> DataFrame:
    """Per repository: exercises delivered by source, submitted, graded, passed; declined by family and stage; sandbox runs by
    purpose and outcome, time-outs, and runs without a verdict."""
    n = lambda kind, also=None: F.count_if((F.col("type") == kind) if also is None else (F.col("type") == kind) & also)
    return journal.groupBy("repository_id").agg(
        n("exercise_generated").alias("generated"), *_counts("exercise_generated", "source", SOURCES, "from"), n("exercise_submitted").alias("submitted"), n("exercise_result").alias("graded"),
        n("exercise_result", _p("passed") == "true").alias("passed"), n("exercise_declined").alias("declined"), *_counts("exercise_declined", "family", FAMILIES, "family"),
        n("exercise_declined", _p("family").isNull()).alias("family_unknown"), *_counts("exercise_declined", "stage", STAGES, "stage"),
        n("exercise_run").alias("runs"), n("exercise_run", _p("stage") == "validate-proposal").alias("proved"), n("exercise_run", _p("stage") == "grade").alias("grading"), *_counts("exercise_run", "outcome", OUTCOMES, "run"),
        n("exercise_run", _p("timed_out") == "true").alias("timed_out"), n("exercise_run", F.map_contains_key("payload", F.lit("verdict_passed")) & _p("verdict_passed").isNull()).alias("no_verdict"),
    )


def coverage_low(summaries: DataFrame, latest: int, rule: str = "anchor-v2") -> DataFrame:
    """One row: files, those of low coverage, and both again for the rows judged by `rule`: over the newest row of each file among the
    newest `latest` rows (summary JSON, created_at). Rows that don't parse or name no file are skipped."""
    p = F.from_json("summary", "path string, coverage struct<low: boolean, rule: string>")
    newest = summaries.orderBy(F.desc("created_at"), F.desc("summary")).limit(latest).select(p.alias("p"), F.struct("created_at", "summary").alias("at")).where("p.path IS NOT NULL")
    rows = newest.groupBy(F.col("p.path").alias("path")).agg(F.max_by("p.coverage", "at").alias("c"))
    low, judged = F.coalesce(F.col("c.low"), F.lit(False)), F.coalesce(F.col("c.rule") == rule, F.lit(False))
    return rows.agg(F.count("*").alias("files"), F.count_if(low).alias("low"), F.count_if(judged).alias("judged"), F.count_if(low & judged).alias("judged_low"))


def spent_by_trace(journal: DataFrame, calls: DataFrame, scene: str) -> DataFrame:
    """(trace_id, events, calls, input, output, model): what the call log knows of the journal's traces, of scenes that begin with `scene`."""
    known = journal.where("trace_id IS NOT NULL").groupBy("trace_id").agg(F.count("*").alias("events"))
    spent = calls.where(F.col("scene").startswith(scene)).groupBy("trace_id").agg(
        F.count("*").alias("calls"), F.sum(F.coalesce("input", F.lit(0))).alias("input"), F.sum(F.coalesce("output", F.lit(0))).alias("output"), F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("ord"))).alias("model")
    )
    return known.join(spent, "trace_id")
