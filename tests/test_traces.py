"""Trace histories and orphan settlement: goldens."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import traces

T0 = datetime(2026, 1, 2, 3, 0)
SCHEMA = "ord long, type string, at timestamp, repository_id string, session_id string, trace_id string, payload map<string,string>"


def journal(spark, rows):
    return spark.createDataFrame([(k, kind, T0 + timedelta(minutes=m), "r", s, t, p) for k, (kind, m, s, t, p) in enumerate(rows)], SCHEMA)


ROWS = [
    ("turn_context", 0, None, "a", {"scene": "teach"}), ("file_read", 1, "s1", "a", {"path": "x", "denied": "true"}), ("code_search", 2, None, "a", {"query": "q", "occurred_at": "2026-01-02T03:00:30Z"}),
    ("loop_round", 3, None, "a", {"scene": "teach", "stopped_by": "budget", "tool_reads": "4"}), ("token_usage", 4, None, "a", {"scene": "teach", "input_tokens": "10", "output_tokens": "2"}),
    ("turn_text", 5, "s1", "a", {"scene": "teach", "question": "why?", "answer": "because"}),
    ("exercise_started", 10, None, "b", {"job_id": "j1"}), ("exercise_model_reply", 11, None, "b", {"reply": "one"}), ("mcp_call", 11, None, "b", {"server": "m", "tool": "t", "ok": "true"}),
    ("exercise_model_reply", 12, None, "b", {"finish_reason": "stop", "attempt": "2"}), ("exercise_model_reply", 12, None, "b", {}), ("exercise_declined", 13, None, "b", {"reason": "no"}),
    ("file_read", 20, None, "c", {"path": "only tools"}), ("turn_text", 21, "s2", "d", {"scene": "map_chat", "question": "gone", "answer": "x"}),
    ("turn_aborted", 22, "s2", "e", {}), ("turn_text", 22, "s2", "e", {"scene": "practice_chat", "question": "q"}), ("token_usage", 23, None, "f", {"scene": "map_chat", "input_tokens": "1"}),
    ("exercise_generated", 30, None, "g", {"title": "  A title "}), ("turn_text", 31, None, None, {"scene": "teach"}),
]


def test_runs_and_steps(spark):
    j = journal(spark, ROWS)
    deleted = spark.createDataFrame([("s2", "gone")], "session_id string, content string")
    runs = traces.trace_runs(j, deleted)
    got = {r.trace_id: (r.scene, r.status, r.thread_id, r.title, r.reads, r.searches, r.input_tokens) for r in runs.collect()}
    assert got == {
        "a": ("teaching.turn", "limited", "s1", None, 4, 1, 10), "b": ("practice.generate", "error", None, None, 0, 0, None),
        "e": ("practice.chat", "aborted", "s2", None, 0, 0, None), "f": ("map.chat", "ok", None, None, 0, 0, 1), "g": ("practice.generate", "ok", None, "A title", 0, 0, None),
    }
    steps = {}
    for r in traces.trace_steps(j, runs).orderBy("trace_id", "seq").collect():
        steps.setdefault(r.trace_id, []).append((r.kind, r.status, r.tool))
    assert steps["a"] == [("turn", "limited", None), ("tool", "ok", "search_code"), ("tool", "error", "read_file"), ("model", "ok", None)]
    assert steps["b"] == [("turn", "error", None), ("model", "ok", None), ("tool", "ok", "mcp__m__t"), ("model", "ok", None)]
    assert steps["f"] == [("turn", "ok", None), ("model", "ok", None)] and steps["g"] == [("turn", "ok", None)]
    purged = traces.trace_runs(j.union(journal(spark, [("message_deleted", 50, "s2", None, {})])), deleted)
    assert "e" not in {r.trace_id for r in purged.collect()}
    assert [r.trace_id for r in traces.history(runs, 2).collect()] == ["g", "f"]
    assert {r.trace_id for r in traces.history(runs, 9, "s2").collect()} == {"b", "e", "f", "g"}
    assert {r.trace_id for r in traces.history(runs, 9, scenes=("teaching.turn",)).collect()} == {"a"}


def test_orphans(spark):
    rows = [
        ("exercise_started", 0, None, "a", {"job_id": "j1", "tag": "t"}), ("exercise_model_reply", 1, None, "a", {}),
        ("exercise_started", 2, None, "b", {"job_id": "j2"}), ("exercise_generated", 3, None, "b", {}),
        ("exercise_started", 4, None, "c", {"job_id": "j3"}), ("token_usage", 5, None, "c", {}), ("exercise_started", 6, None, "d", {"job_id": "live"}),
        ("exercise_model_reply", 7, None, "old", {}), ("exercise_model_reply", 100, None, "new", {}), ("exercise_model_reply", 8, None, "done", {}), ("exercise_aborted", 9, None, "done", {}),
    ]
    now = F.lit(T0 + timedelta(minutes=110))
    active = spark.createDataFrame([("live",)], "job_id string")
    calls = spark.createDataFrame([(1, "a", "practice.generate.x", "", 5, 1), (2, "a", "practice.generate", "m", 7, None), (3, "c", "practice.generate", "m", 1, 1), (4, "old", "teach", "m", 1, 1)], "ord long, trace_id string, scene string, model string, input long, output long")
    got = {(r.type, r.trace_id, r.payload.get("job_id"), r.payload.get("input_tokens"), r.payload.get("provider")) for r in traces.settle_orphans(journal(spark, rows), now, active, calls).collect()}
    # the ending of `done` falls into the last start's stretch, which is live anyway
    assert got == {("exercise_aborted", "a", "j1", None, None), ("exercise_aborted", "c", "j3", None, None), ("exercise_aborted", "old", None, None, None), ("token_usage", "a", None, "12", "m")}
    assert traces.settle_orphans(journal(spark, [])  , now).count() == 0


def test_orphans_of_one_long_repository(spark):
    """Starts are counted by ranges of time, and rows are dealt without their payloads."""
    kinds = ("exercise_started", "exercise_generated", "exercise_model_reply", "exercise_started", "token_usage", "exercise_started")
    rows = [(kinds[(k * k + k // 6) % 6], k // 3, None, f"t{k}", {"job_id": f"j{k}", "tag": None if k % 2 else "t", "question": "x" * 50}) for k in range(300)]
    j = journal(spark, rows)
    marks = [(k, kind) for k, (kind, *_) in enumerate(rows) if kind != "exercise_model_reply"]
    starts = [i for i, (_, kind) in enumerate(marks) if kind == "exercise_started"]
    want = {f"j{marks[i][0]}" for i, end in zip(starts, [*starts[1:], len(marks)]) if not any(kind == "exercise_generated" for _, kind in marks[i:end])}
    got = traces.settle_orphans(j, F.lit(T0)).collect()
    assert {r.payload["job_id"] for r in got} == want and len(got) == len(want) > 9
    numbered = traces.numbered_starts(j.select("repository_id", "at", "ord", (F.col("type") == "exercise_started").alias("starts")))
    held = {k: sum(kinds[(x * x + x // 6) % 6] == "exercise_started" for x in range(k + 1)) for k in range(300)}
    assert {r.ord: r.segment for r in numbered.collect()} == held
