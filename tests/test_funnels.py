"""Ledgers and funnels: zeros and missing values told apart, empty journals."""

from __future__ import annotations

from lodestone.operators import funnels

SCHEMA = "ord long, type string, at timestamp, repository_id string, trace_id string, payload map<string,string>"


def journal(spark, rows):
    return spark.createDataFrame([(k, kind, None, "r", "t", p) for k, (kind, p) in enumerate(rows)], SCHEMA)


def test_ledger_tells_silent_from_told(spark):
    rows = [("token_usage", {"scene": "teach", "input_tokens": "10", "output_tokens": "2", "cache_hit_tokens": None}), ("token_usage", {"scene": "teach", "input_tokens": "x", "cache_hit_tokens": "0"}), ("token_usage", {"input_tokens": "1"}), ("turn_text", {})]
    got = {r.scene: (r.calls, r.input, r.output, r.cache_silent, r.cache_told) for r in funnels.token_ledger(journal(spark, rows)).collect()}
    assert got == {"teach": (2, 10, 2, 1, 1), funnels.UNKNOWN: (1, 1, 0, 0, 1)}


def test_funnels(spark):
    rows = [("turn_text", {"scene": "map_chat"})] * 4 + [("turn_asked", {"outcome": "asked", "facet": "goal"}), ("turn_asked", {"outcome": "claimed"}), ("turn_asked", {"outcome": "discarded", "reason": "expired"}), ("turn_asked", {"outcome": "refused"})]
    r = funnels.ask_funnel(journal(spark, rows)).first()
    assert (r.turns, r.asked, r.asked_goal, r.asked_range, r.claimed, r.discarded_expired, r.refused, r.asked_share, r.claimed_share) == (4, 1, 1, 0, 1, 1, 1, 0.25, 1.0)
    rows = [("exercise_generated", {"source": "llm"}), ("exercise_submitted", {}), ("exercise_result", {"passed": "true"}), ("exercise_declined", {"family": "code", "stage": "guard"}), ("exercise_declined", {"stage": "guard"}), ("exercise_run", {"outcome": "no-verdict", "verdict_passed": None}), ("exercise_run", {"timed_out": "true", "stage": "grade"})]
    r = funnels.practice_funnel(journal(spark, rows)).first()
    assert (r.generated, r.from_llm, r.submitted, r.graded, r.passed, r.declined, r.family_code, r.family_unknown, r.stage_guard, r.runs, r.grading, r.run_no_verdict, r.timed_out, r.no_verdict) == (1, 1, 1, 1, 1, 2, 1, 1, 2, 2, 1, 1, 1, 1)
    assert funnels.practice_funnel(journal(spark, [])).count() == 0


def test_latency_and_coverage(spark):
    rows = [("GET", f"/api/repo_{k:x}/files/0123abcd-0000-1111-2222-0123456789ab", k) for k in range(20)] + [(None, "/x", 5), ("GET", "/companion/a", 1), ("GET", "/x", None)]
    got = {r.route: (r.n, r.p50, r.p95) for r in funnels.route_latency(spark.createDataFrame(rows, "method string, url string, ms long")).collect()}
    assert got == {"GET /api/:repoId/files/:id": (20, 10, 19), "? /x": (1, 5, 5)}
    rows = [('{"path":"a","coverage":{"low":true,"rule":"anchor-v2"}}', 1), ('{"path":"a","coverage":{"low":false}}', 2), ("no json", 3), ('{"path":"b","coverage":{"low":true}}', 3), ('{"path":"old"}', 0)]
    r = funnels.coverage_low(spark.createDataFrame(rows, "summary string, created_at long"), 4).first()
    assert (r.files, r.low, r.judged, r.judged_low) == (2, 1, 0, 0)


def test_call_profile(spark):
    calls = spark.createDataFrame([(True, None, 1, 10, 5, None, 2, "s"), (False, "timeout x", 3, 30, None, 4, 1, "s"), (False, "timeout x", None, 20, 1, None, None, None)], "ok boolean, error string, attempts int, ms long, input long, cache_hit long, output long, scene string")
    got = {r.scene: (r.calls, r.failed, r.timeouts, r.retries, r.input, r.told, r.hit_rate, r.top_error, r.p50, r.p95) for r in funnels.call_profile(calls, ["scene"]).collect()}
    assert got == {"s": (2, 1, 1, 2, 5, 1, 0.8, "timeout x", 30, 30), funnels.UNKNOWN: (1, 1, 1, 0, 1, 0, None, "timeout x", 20, 20)}
