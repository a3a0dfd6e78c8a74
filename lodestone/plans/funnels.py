"""Ledgers and funnels over a journal written from `events`: an event's number chooses its type, its k the payload;
the same events are the call log and the requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import funnels
from lodestone.plans.registry import query, table

TYPES = ("token_usage", "turn_asked", "turn_text", "exercise_generated", "exercise_submitted", "exercise_result", "exercise_declined", "exercise_run")


def _pick(values, by):
    return F.get(F.array(*map(F.lit, values)), (by % len(values)).cast("int"))


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.withColumns({"ord": F.col("event_id"), "q": F.floor(F.col("event_id") / 8), "c": F.col("event_id") % 8})


def _journal(spark, sf_dir):
    e = _events(spark, sf_dir)
    k, q, c = F.col("k"), F.col("q"), F.col("c")
    pairs = {
        "scene": _pick(("teach", "map_chat", "", "map_chat"), k), "input_tokens": F.when(k % 9 == 0, "many").otherwise(F.floor("value").cast("string")), "output_tokens": k.cast("string"), "cache_hit_tokens": F.when(k % 3 != 0, k.cast("string")),
        "outcome": F.when(c == 1, _pick(("asked", "refused", "claimed", "discarded", "asked"), q)).otherwise(_pick(funnels.OUTCOMES, q)), "facet": _pick((*funnels.FACETS, "other"), k), "reason": _pick((*funnels.CAUSES, "other"), k),
        "source": _pick(funnels.SOURCES, k), "passed": (k % 2 == 0).cast("string"), "family": F.when(k % 4 != 3, _pick(funnels.FAMILIES, k)), "stage": F.when(c == 6, _pick(funnels.STAGES, k)).otherwise(_pick(("validate-proposal", "grade", "other"), k)),
        "timed_out": (k % 10 == 0).cast("string"), "verdict_passed": F.when(k % 5 != 0, "true"),
    }
    m = F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value)])
    trace = F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / 600))
    return e.select("ord", _pick(TYPES, F.col("event_id")).alias("type"), F.col("ts").alias("at"), F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")).alias("repository_id"), trace.alias("trace_id"), m.alias("payload"))


def _calls(spark, sf_dir):
    e, k = _events(spark, sf_dir), F.col("k")
    trace = F.when(F.col("event_id") % 3 != 0, F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / 600)))
    return e.select(
        "ord", trace.alias("trace_id"), F.when(k % 7 != 0, F.col("event_type")).alias("scene"), _pick(("small", "large"), k).alias("tier"), F.when(k % 2 == 0, _pick(("m1", "m2", ""), k)).alias("model"), (k % 6 != 0).alias("ok"),
        F.when(k % 6 == 0, _pick(("timeout after 240 s", "refused"), k)).alias("error"), (1 + k % 3).cast("int").alias("attempts"), F.when(k % 8 != 0, F.floor(F.col("value") * 10).cast("long")).alias("ms"),
        F.floor("value").cast("long").alias("input"), F.when(k % 5 != 0, k).alias("output"), F.when(k % 4 == 0, k).alias("cache_hit"),
    )


_E = """WITH e AS (SELECT event_id AS ord, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id // 8 AS q, event_id % 8 AS c, 'r' || (user_id % 5) AS repository_id, user_id || '-' || (event_id // 600) AS trace_id FROM events) """


def _n(when: str, name: str) -> str:
    return f"count(*) FILTER ({when}) AS {name.replace('-', '_')}"


@query(_E + """SELECT repository_id, CASE k % 4 WHEN 0 THEN 'teach' WHEN 2 THEN '(scene not recorded)' ELSE 'map_chat' END AS scene, count(*) AS calls, CAST(sum(CASE WHEN k % 9 = 0 THEN 0 ELSE CAST(floor(value) AS BIGINT) END) AS BIGINT) AS input,
  CAST(sum(k) AS BIGINT) AS output, count(*) FILTER (k % 3 = 0) AS cache_silent, count(*) FILTER (k % 3 <> 0) AS cache_told FROM e WHERE c = 0 GROUP BY 1, 2""")
def a21_token_ledger(spark, sf_dir):
    return funnels.token_ledger(_journal(spark, sf_dir))


_ASK = ", ".join(
    [_n("c = 2 AND k % 4 IN (1, 3)", "turns"), _n("c = 1 AND q % 5 IN (0, 4)", "asked"), *(_n(f"c = 1 AND q % 5 IN (0, 4) AND k % 3 = {i}", f"asked_{f}") for i, f in enumerate(funnels.FACETS)), _n("c = 1 AND q % 5 = 1", "refused"),
     _n("c = 1 AND q % 5 = 2", "claimed"), _n("c = 1 AND q % 5 = 3", "discarded"), *(_n(f"c = 1 AND q % 5 = 3 AND k % 4 = {i}", f"discarded_{x}") for i, x in enumerate(funnels.CAUSES))]
)


@query(_E + f"""SELECT *, CASE WHEN turns > 0 THEN round(asked / turns, 6) END AS asked_share, CASE WHEN asked > 0 THEN round(claimed / asked, 6) END AS claimed_share FROM (SELECT repository_id, {_ASK} FROM e GROUP BY 1)""")
def a22_ask_funnel(spark, sf_dir):
    return funnels.ask_funnel(_journal(spark, sf_dir))


_PRACTICE = ", ".join(
    [_n("c = 3", "generated"), *(_n(f"c = 3 AND k % 5 = {i}", f"from_{x}") for i, x in enumerate(funnels.SOURCES)), _n("c = 4", "submitted"), _n("c = 5", "graded"), _n("c = 5 AND k % 2 = 0", "passed"), _n("c = 6", "declined"),
     *(_n(f"c = 6 AND k % 4 <> 3 AND k % 3 = {i}", f"family_{x}") for i, x in enumerate(funnels.FAMILIES)), _n("c = 6 AND k % 4 = 3", "family_unknown"), *(_n(f"c = 6 AND k % 9 = {i}", f"stage_{x}") for i, x in enumerate(funnels.STAGES)),
     _n("c = 7", "runs"), _n("c = 7 AND k % 3 = 0", "proved"), _n("c = 7 AND k % 3 = 1", "grading"), *(_n(f"c = 7 AND q % 4 = {i}", f"run_{x}") for i, x in enumerate(funnels.OUTCOMES)), _n("c = 7 AND k % 10 = 0", "timed_out"), _n("c = 7 AND k % 5 = 0", "no_verdict")]
)


@query(_E + f"SELECT repository_id, {_PRACTICE} FROM e GROUP BY 1")
def a23_practice_funnel(spark, sf_dir):
    return funnels.practice_funnel(_journal(spark, sf_dir))


@query("""WITH s AS (SELECT doc_id, text, 'f' || (doc_id % 400) AS path, doc_id % 7 = 0 AS low, doc_id % 2 = 0 AS v2, doc_id % 13 = 0 AS bad FROM documents ORDER BY doc_id DESC LIMIT 600),
l AS (SELECT path, arg_max(low, doc_id) AS low, arg_max(v2, doc_id) AS v2 FROM s WHERE NOT bad GROUP BY 1) SELECT count(*) AS files, count(*) FILTER (low) AS low, count(*) FILTER (v2) AS judged, count(*) FILTER (low AND v2) AS judged_low FROM l""")
def a24_coverage_low(spark, sf_dir):
    """The newest row of each file among the newest 600 summaries."""
    d = F.col("doc_id")
    json = F.format_string('{"path":"f%d","coverage":{"low":%s,"rule":"%s"}}', d % 400, (d % 7 == 0).cast("string"), F.when(d % 2 == 0, "anchor-v2").otherwise("v1"))
    rows = table(spark, sf_dir, "documents").select(F.when(d % 13 == 0, "no json").otherwise(json).alias("summary"), d.alias("created_at"))
    return funnels.coverage_low(rows, 600)


_CALLS = _E + """, x AS (SELECT *, coalesce(CASE WHEN k % 7 <> 0 THEN event_type END, '(scene not recorded)') AS scene, CASE k % 2 WHEN 0 THEN 'small' ELSE 'large' END AS tier, k % 6 <> 0 AS ok, CASE WHEN k % 6 = 0 THEN CASE k % 2 WHEN 0 THEN 'timeout after 240 s' ELSE 'refused' END END AS error,
  CASE WHEN k % 8 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS ms, CAST(floor(value) AS BIGINT) AS input, CASE WHEN k % 5 <> 0 THEN k END AS output, CASE WHEN k % 4 = 0 THEN k END AS hit FROM e),
r AS (SELECT scene, tier, ms, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY scene, tier) AS n FROM x WHERE ms IS NOT NULL WINDOW w AS (PARTITION BY scene, tier ORDER BY ms)),
p AS (SELECT scene, tier, avg(ms) FILTER (i = least(n - 1, floor(n * 0.5))) AS p50, avg(ms) FILTER (i = least(n - 1, floor(n * 0.9))) AS p90, avg(ms) FILTER (i = least(n - 1, floor(n * 0.95))) AS p95 FROM r GROUP BY 1, 2) """


@query(_CALLS + """SELECT x.scene, x.tier, count(*) AS calls, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (contains(error, 'timeout')) AS timeouts, CAST(sum(k % 3) AS BIGINT) AS retries, CAST(sum(input) AS BIGINT) AS input, CAST(sum(coalesce(output, 0)) AS BIGINT) AS output, count(hit) AS told,
  round(sum(hit) / greatest(1, sum(input)), 6) AS hit_rate, mode(error) AS top_error, any_value(p50) AS p50, any_value(p90) AS p90, any_value(p95) AS p95 FROM x LEFT JOIN p USING (scene, tier) GROUP BY 1, 2""")
def a25_call_profile(spark, sf_dir):
    return funnels.call_profile(_calls(spark, sf_dir), ["scene", "tier"]).withColumn("hit_rate", F.round("hit_rate", 6))


@query(r"""WITH h AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 10) AS BIGINT) END AS ms, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'GET' END AS method, CASE user_id % 20 WHEN 0 THEN '/companion/x' ELSE '/api/r' || (user_id % 20) || '/:repoId/s' END AS url FROM events),
x AS (SELECT coalesce(method, '?') || ' ' || url AS route, ms FROM h WHERE ms IS NOT NULL AND NOT contains(url, '/companion/')), r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM x)
SELECT route, n, avg(ms) FILTER (i = least(n - 1, floor(n * 0.5))) AS p50, avg(ms) FILTER (i = least(n - 1, floor(n * 0.95))) AS p95 FROM r GROUP BY 1, 2 ORDER BY n DESC, route LIMIT 12""")
def a20_route_latency(spark, sf_dir):
    """The twelve routes asked most, with their latency."""
    u, n = F.col("user_id"), F.col("event_id")
    url = F.when(u % 20 == 0, "/companion/x").otherwise(F.concat(F.lit("/api/r"), (u % 20).cast("string"), F.lit("/repo_"), F.hex(n), F.lit("/s")))
    rows = table(spark, sf_dir, "events").select(F.when(n % 4 != 0, "GET").alias("method"), url.alias("url"), F.when(n % 9 != 0, F.floor(F.col("value") * 10).cast("long")).alias("ms"))
    return funnels.route_latency(rows)


@query(_E + """, x AS (SELECT CASE WHEN ord % 3 <> 0 THEN trace_id END AS trace_id, ord, CASE WHEN k % 2 = 0 THEN CASE k % 3 WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' ELSE '' END END AS model, CAST(floor(value) AS BIGINT) AS input, CASE WHEN k % 5 <> 0 THEN k ELSE 0 END AS output FROM e WHERE k % 7 <> 0 AND starts_with(event_type, 'pur')),
s AS (SELECT trace_id, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, arg_min(model, ord) FILTER (model <> '') AS model FROM x GROUP BY 1) SELECT e.trace_id, count(*) AS events, any_value(calls) AS calls, any_value(s.input) AS input, any_value(s.output) AS output, any_value(s.model) AS model FROM e JOIN s ON s.trace_id = e.trace_id GROUP BY 1""")
def j15_spent_by_trace(spark, sf_dir):
    return funnels.spent_by_trace(_journal(spark, sf_dir), _calls(spark, sf_dir), "pur")
