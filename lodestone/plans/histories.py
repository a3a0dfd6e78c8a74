"""Trace histories and orphaned generations over a journal written from `events`: an event's number
chooses its type and payload, a user's events among six hundred are a trace, every tenth user's events have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import traces
from lodestone.plans.registry import query, table

TYPES = (
    "exercise_started", "exercise_model_reply", "exercise_generated", "exercise_declined", "exercise_aborted", "turn_text", "loop_round", "token_usage", "file_read", "code_search", "mcp_call", "turn_asked",
)
SCENES = ("teach", "map_chat", "practice_chat", "other")
NOW = "2024-01-20 00:00:00"


def _journal(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, text = F.col("k"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    pick = lambda names, by: F.get(F.array(*map(F.lit, names)), (by % len(names)).cast("int"))
    kind = F.when((F.col("event_id") % 201 == 7) & (F.col("user_id") % 5 == 1), "message_deleted").otherwise(pick(TYPES, F.col("event_id")))
    late = F.when(k % 3 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 90 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    payload = {
        "scene": pick(SCENES, k), "stopped_by": pick(("budget", "rounds", "reads", "answer", "answer"), k), "aborted": (k % 11 == 0).cast("string"), "outcome": F.when(F.col("event_id") % 12 == 11, pick(("asked", "refused", "claimed"), k)).otherwise(F.when(k % 7 == 0, "failed").otherwise("ok")),
        "tool_reads": F.when(k % 2 == 0, k.cast("string")), "question": text("q", k % 20), "answer": F.when(k % 3 != 0, text("a", k)).otherwise(""), "denied": (k % 5 == 0).cast("string"), "error": F.when(k % 7 == 0, "gone"),
        "server": F.lit("m"), "tool": text("t", k % 4), "ok": (k % 2 == 0).cast("string"), "reply": F.when(k % 4 != 0, "reply"), "title": text(" title ", k), "job_id": text("j", F.col("event_id")), "tag": F.when(k % 2 == 0, "even"),
        "input_tokens": F.floor("value").cast("string"), "output_tokens": k.cast("string"), "provider": text("p", k % 3), "occurred_at": late,
    }
    trace = F.when(F.col("user_id") % 10 != 0, text(F.col("user_id"), "-", F.floor(F.col("event_id") / 600)))
    session = F.when(k % 6 != 0, text("s", F.col("user_id") % 30))
    m = F.create_map(*[c for name, value in payload.items() for c in (F.lit(name), value)])
    return e.select(F.col("event_id").alias("ord"), kind.alias("type"), F.col("ts").cast("timestamp").alias("at"), text("r", F.col("user_id") % 5).alias("repository_id"), session.alias("session_id"), trace.alias("trace_id"), m.alias("payload"))


def _deleted(spark, sf_dir):
    """Questions that were deleted: of every seventh text."""
    j = _journal(spark, sf_dir).where("type = 'turn_text' AND ord % 84 = 5")
    return j.select("session_id", F.col("payload")["question"].alias("content"))


_SRC = """WITH e AS (SELECT event_id AS ord, ts AS ts, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 12 AS c, event_id % 201 = 7 AND user_id % 5 = 1 AS del FROM events),
j AS (SELECT *, 'r' || (user_id % 5) AS repository_id, CASE WHEN k % 6 <> 0 THEN 's' || (user_id % 30) END AS session_id, CASE WHEN user_id % 10 <> 0 THEN user_id || '-' || (ord // 600) END AS trace_id,
  CASE k % 4 WHEN 0 THEN 'teaching.turn' WHEN 1 THEN 'map.chat' WHEN 2 THEN 'practice.chat' END AS shown FROM e),
gone AS (SELECT DISTINCT repository_id, trace_id FROM j WHERE c = 5 AND NOT del AND (session_id, k % 20) IN (SELECT (session_id, k % 20) FROM j WHERE c = 5 AND NOT del AND ord % 84 = 5 AND session_id IS NOT NULL)
  UNION SELECT repository_id, trace_id FROM j WHERE c = 5 AND NOT del AND session_id IS NULL AND k % 20 IN (SELECT k % 20 FROM j WHERE c = 5 AND NOT del AND ord % 84 = 5 AND session_id IS NULL)),
g AS (SELECT repository_id, trace_id, coalesce(arg_min(shown, (ts, ord)) FILTER (shown IS NOT NULL), CASE WHEN bool_or(NOT del AND c IN (0, 2, 3, 4)) THEN 'practice.generate' END) AS scene,
    bool_or(NOT del AND (c IN (0, 2, 3, 4, 5) OR (c IN (6, 7) AND shown IS NOT NULL))) AS turn, bool_or(NOT del AND c = 4) OR coalesce(arg_max(k % 11 = 0, (ts, ord)) FILTER (NOT del AND c = 6), false) AS aborted,
    bool_or(NOT del AND c = 3) OR coalesce(arg_max(k % 7 = 0, (ts, ord)) FILTER (NOT del AND c = 6), false) AS failed, arg_max(k % 5, (ts, ord)) FILTER (NOT del AND c = 6) AS stop,
    arg_min(session_id, (ts, ord)) FILTER (session_id IS NOT NULL) AS thread_id, arg_min('title ' || k, (ts, ord)) FILTER (NOT del AND c = 2) AS title,
    coalesce(arg_min(CASE WHEN k % 3 <> 0 THEN 'a' || k ELSE '' END, (ts, ord)) FILTER (NOT del AND c = 5), '') AS answer, min(ts) FILTER (NOT del AND c = 5) AS text_at, max(ts) FILTER (NOT del AND c = 7) AS usage_at,
    arg_max(CAST(floor(value) AS BIGINT), (ts, ord)) FILTER (NOT del AND c = 7) AS input_tokens, arg_max(k, (ts, ord)) FILTER (NOT del AND c = 7) AS output_tokens,
    coalesce(arg_max(CASE WHEN k % 2 = 0 THEN k ELSE -1 END, (ts, ord)) FILTER (NOT del AND c = 6), -1) AS told, count(*) FILTER (NOT del AND c = 8) AS reads, count(*) FILTER (NOT del AND c = 9) AS searches, min(ts) AS started_at, max(ts) AS ended_at
  FROM j WHERE trace_id IS NOT NULL AND (repository_id, trace_id) NOT IN (SELECT (repository_id, trace_id) FROM gone WHERE trace_id IS NOT NULL) GROUP BY 1, 2),
st AS (SELECT *, CASE WHEN aborted THEN 'aborted' WHEN failed THEN 'error' WHEN stop IN (0, 1, 2) THEN 'limited' ELSE 'ok' END AS status FROM g WHERE scene IS NOT NULL AND turn),
run AS (SELECT * FROM st WHERE NOT (status = 'aborted' AND repository_id IN (SELECT repository_id FROM j WHERE del))) """


@query(_SRC + """SELECT repository_id, trace_id, scene, status, thread_id, title, CASE WHEN told >= 0 THEN told ELSE reads END AS reads, searches, input_tokens, output_tokens, started_at, ended_at FROM run""")
def s215_trace_runs(spark, sf_dir):
    """Runs of the journal by trace, without those whose question was deleted."""
    runs = traces.trace_runs(_journal(spark, sf_dir), _deleted(spark, sf_dir))
    return runs.select("repository_id", "trace_id", "scene", "status", "thread_id", "title", "reads", "searches", "input_tokens", "output_tokens", "started_at", "ended_at")


@query(_SRC + """, mine AS (SELECT j.*, r.answer FROM j JOIN run r ON r.repository_id = j.repository_id AND r.trace_id = j.trace_id WHERE NOT del),
rep AS (SELECT repository_id, trace_id, ts, ord FROM mine WHERE c = 1 AND answer = '' AND k % 4 <> 0),
ev AS (SELECT repository_id, trace_id, 'turn' AS kind, status, NULL AS tool, started_at AS ts, 0 AS rank, 0 AS ord FROM run
  UNION ALL SELECT repository_id, trace_id, 'tool', CASE WHEN CASE c WHEN 8 THEN k % 5 <> 0 AND k % 7 <> 0 WHEN 9 THEN true WHEN 10 THEN k % 2 = 0 ELSE k % 3 = 0 END THEN 'ok' ELSE 'error' END,
    CASE c WHEN 8 THEN 'read_file' WHEN 9 THEN 'search_code' WHEN 10 THEN 'mcp__m__t' || (k % 4) ELSE 'ask_user' END, CASE WHEN k % 3 = 0 THEN ts - INTERVAL 90 SECOND ELSE ts END, 2, ord FROM mine WHERE c IN (8, 9, 10) OR (c = 11 AND k % 3 < 2)
  UNION ALL SELECT repository_id, trace_id, 'model', 'ok', NULL, text_at, 1, 0 FROM run WHERE answer <> '' UNION ALL SELECT repository_id, trace_id, 'model', 'ok', NULL, ts, 1, ord FROM rep
  UNION ALL SELECT repository_id, trace_id, 'model', 'ok', NULL, usage_at, 1, 0 FROM run WHERE answer = '' AND usage_at IS NOT NULL AND (repository_id, trace_id) NOT IN (SELECT (repository_id, trace_id) FROM rep))
SELECT repository_id, trace_id, CAST(row_number() OVER (PARTITION BY repository_id, trace_id ORDER BY rank <> 0, ts, rank, ord) - 1 AS INTEGER) AS seq, kind, status, tool, ts AS "at" FROM ev""")
def s215_trace_steps(spark, sf_dir):
    """The steps of each run: its opening, model replies and tools in the order in which they happened."""
    j = _journal(spark, sf_dir)
    return traces.trace_steps(j, traces.trace_runs(j, _deleted(spark, sf_dir)))


@query(f"""WITH e AS (SELECT event_id AS ord, ts AS ts, 'r' || (user_id % 5) AS r, CASE WHEN user_id % 10 <> 0 THEN user_id || '-' || (event_id // 600) END AS trace_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 201 = 7 AND user_id % 5 = 1 THEN -1 ELSE event_id % 12 END AS c FROM events),
m AS (SELECT *, lead(ts) OVER w AS next_at, lead(ord) OVER w AS next_ord FROM e WHERE c = 0 WINDOW w AS (PARTITION BY r ORDER BY ts, ord)),
orphan AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.r = m.r AND e.c IN (2, 3, 4) AND (e.ts, e.ord) > (m.ts, m.ord) AND (m.next_at IS NULL OR (e.ts, e.ord) < (m.next_at, m.next_ord))) AND ord % 24 <> 0),
old AS (SELECT r, trace_id, min(ts) FILTER (c = 1) AS ts FROM e WHERE trace_id IS NOT NULL GROUP BY 1, 2 HAVING NOT bool_or(c IN (0, 2, 3, 4)) AND min(ts) FILTER (c = 1) <= TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE)
SELECT r AS repository_id, trace_id, 'j' || ord AS job_id, CASE WHEN k % 2 = 0 THEN 'even' ELSE '' END AS tag, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS started_at FROM orphan
UNION ALL SELECT r, trace_id, NULL, '', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' FROM old""")
def s215_settled_orphans(spark, sf_dir):
    """Generations without an ending, but those still at work (every second job)."""
    j = _journal(spark, sf_dir)
    active = j.where("type = 'exercise_started' AND ord % 24 = 0").select(F.col("payload")["job_id"].alias("job_id"))
    p = F.col("payload")
    done = traces.settle_orphans(j, F.lit(NOW).cast("timestamp"), active)
    return done.select("repository_id", "trace_id", p["job_id"].alias("job_id"), p["tag"].alias("tag"), p["started_at"].alias("started_at"))
