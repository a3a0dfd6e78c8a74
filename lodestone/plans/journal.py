"""Usage, cost, latency and audit queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import usage as U
from lodestone.plans.registry import query, table

# an event is a model call: scene = event_type, provider = user_id % 5, input = 10 * value, output = value,
# cache hits = 7 * k where k is even, not reported where k is odd, degraded where k < 10
_SQL = """WITH usage AS (SELECT *, event_type AS scene, CAST(user_id % 5 AS VARCHAR) AS provider, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CAST(floor(10 * value) AS BIGINT) AS input, CAST(floor(value) AS BIGINT) AS output FROM events),
costed AS (SELECT *, CASE WHEN k % 2 = 0 THEN 7 * k END AS cache_hit, k < 10 AS degraded,
  least(input, greatest(0, coalesce(CASE WHEN k % 2 = 0 THEN 7 * k END, 0))) AS hit FROM usage) """
_SUMS = """count(*) AS turns, CAST(sum(input) AS BIGINT) AS input_tokens, CAST(sum(hit) AS BIGINT) AS cache_hit_tokens,
  CAST(sum(input - hit) AS BIGINT) AS billed_tokens, CAST(sum(output) AS BIGINT) AS output_tokens, count(*) FILTER (degraded) AS degraded """
AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.col("event_id").alias("ord"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("scene"), "value", "k",
        (F.col("user_id") % 5).cast("string").alias("provider"), (F.col("k") < 10).alias("degraded"),
        F.floor(10 * F.col("value")).cast("long").alias("input"), F.floor("value").cast("long").alias("output"),
        F.when(F.col("k") % 2 == 0, 7 * F.col("k")).alias("cache_hit"),
    )


@query(_SQL + f"SELECT {_SUMS} FROM costed WHERE date_trunc('month', ts) = date_trunc('month', {AS_OF})")
def a01_monthly_cost(spark, sf_dir):
    return U.monthly_cost(usage(spark, sf_dir), F.expr(AS_OF))


@query(_SQL + f"""SELECT provider, round((sum(input - hit) * 0.3 + sum(hit) * 0.03 + sum(output) * 0.6) / 1000000, 8) AS usd,
  round((sum(input - hit) * 0.3 + sum(hit) * 0.3 + sum(output) * 0.6) / 1000000, 8) AS usd_without_hit_rate FROM costed WHERE date_trunc('month', ts) = date_trunc('month', {AS_OF}) GROUP BY 1""")
def a02_price_by_provider(spark, sf_dir):
    c = U.monthly_cost(usage(spark, sf_dir), F.expr(AS_OF), ["provider"])
    usd = lambda hit: F.round(U.price(F.col("billed_tokens"), F.col("cache_hit_tokens"), F.col("output_tokens"), 0.3, hit, 0.6), 8)
    return c.select("provider", usd(0.03).alias("usd"), usd(None).alias("usd_without_hit_rate"))


@query(_SQL + f"SELECT scene, {_SUMS} FROM costed WHERE date_trunc('month', ts) = date_trunc('month', {AS_OF}) GROUP BY 1")
def a03_usage_by_scene(spark, sf_dir):
    return U.monthly_cost(usage(spark, sf_dir), F.expr(AS_OF), ["scene"])


@query(_SQL + f"SELECT CAST(ts AS DATE) AS day, {_SUMS} FROM costed WHERE date_trunc('month', ts) = date_trunc('month', {AS_OF}) GROUP BY 1")
def a04_daily_usage(spark, sf_dir):
    u = usage(spark, sf_dir).withColumn("day", F.to_date("at"))
    return U.monthly_cost(u, F.expr(AS_OF), ["day"])


@query(_SQL + "SELECT scene, sum(input + output) >= 1000000 AS over_budget FROM costed GROUP BY 1")
def a05_budget_gate(spark, sf_dir):
    return usage(spark, sf_dir).groupBy("scene").agg((F.sum(F.col("input") + F.col("output")) >= 1_000_000).alias("over_budget"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 30")
def a06_hotspots(spark, sf_dir):
    return U.keyed_top(table(spark, sf_dir, "events"), ["user_id"], 30)


@query(_SQL + """SELECT scene, count(*) AS calls, count(*) FILTER (degraded) AS failed, CAST(sum(input) AS BIGINT) AS input,
  CAST(sum(cache_hit) AS BIGINT) AS cache_hit, CAST(sum(input) FILTER (cache_hit IS NOT NULL) AS BIGINT) AS reported_input,
  count(*) FILTER (cache_hit IS NULL) AS not_reported, count(*) FILTER (cache_hit = 0) AS reported_zero FROM costed GROUP BY 1""")
def a19_call_profile(spark, sf_dir):
    hit = F.col("cache_hit")
    return usage(spark, sf_dir).groupBy("scene").agg(
        F.count("*").alias("calls"), F.count_if("degraded").alias("failed"), F.sum("input").alias("input"), F.sum(hit).alias("cache_hit"),
        F.sum(F.when(hit.isNotNull(), F.col("input"))).alias("reported_input"), F.count_if(hit.isNull()).alias("not_reported"),
        F.count_if(hit == 0).alias("reported_zero"),
    )


@query(_SQL + """SELECT scene, provider, count(*) AS calls, count(DISTINCT (user_id, k)) AS fingerprints,
  count(*) - count(DISTINCT (user_id, k)) AS duplicates, max(value) AS longest FROM costed GROUP BY 1, 2""")
def a25_duplicate_calls(spark, sf_dir):
    prints = F.countDistinct("user_id", "k")
    return usage(spark, sf_dir).groupBy("scene", "provider").agg(
        F.count("*").alias("calls"), prints.alias("fingerprints"), (F.count("*") - prints).alias("duplicates"), F.max("value").alias("longest")
    )


@query("""WITH gaps AS (SELECT *, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events)
SELECT CASE WHEN gap IS NULL THEN 'first' WHEN gap < 300 THEN 'warm' WHEN gap < 3600 THEN 'hour' ELSE 'longer' END AS band, count(*) AS calls FROM gaps GROUP BY 1""")
def a26_cache_gap_bands(spark, sf_dir):
    calls = usage(spark, sf_dir)
    return U.gap_bands(calls, ["user_id"], "at", [("warm", 300), ("hour", 3600)]).groupBy("band").agg(F.count("*").alias("calls"))


@query(_SQL + """SELECT k AS file, count(*) AS hits, max(input) AS max_chars, CAST(sum(input) AS BIGINT) AS chars, count(DISTINCT scene) AS scenes,
  string_agg(DISTINCT scene, ',' ORDER BY scene) AS scene_list, max(ts) AS last_at FROM costed GROUP BY 1""")
def a27_egress_by_file(spark, sf_dir):
    return usage(spark, sf_dir).groupBy(F.col("k").alias("file")).agg(
        F.count("*").alias("hits"), F.max("input").alias("max_chars"), F.sum("input").alias("chars"), F.countDistinct("scene").alias("scenes"),
        F.array_join(F.array_sort(F.collect_set("scene")), ",").alias("scene_list"), F.max("at").alias("last_at"),
    )


def _percentile_sql(index: str) -> str:
    return f"""WITH r AS (SELECT event_type AS scene, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT scene, round(avg(value), 8) AS percentile FROM r WHERE {index} GROUP BY 1"""


def _percentile(spark, sf_dir, share, kind):
    out = U.percentile_at(usage(spark, sf_dir), ["scene"], "value", share, kind)
    return out.withColumn("percentile", F.round("percentile", 8))


@query(_percentile_sql("i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))"))
def a30_percentile_floor_n(spark, sf_dir):
    return _percentile(spark, sf_dir, 0.95, "floor_n")


@query(_percentile_sql("i = least(n - 1, CAST(floor((n - 1) * 0.95) AS BIGINT))"))
def a30_percentile_floor_n1(spark, sf_dir):
    return _percentile(spark, sf_dir, 0.95, "floor_n1")


@query(_percentile_sql("i BETWEEN (n - 1) // 2 AND n // 2"))
def a30_percentile_median(spark, sf_dir):
    return _percentile(spark, sf_dir, 0.5, "median")


@query(_percentile_sql("i = n // 2"))
def a30_percentile_upper_median(spark, sf_dir):
    return _percentile(spark, sf_dir, 0.5, "upper")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
l AS (SELECT * FROM d ORDER BY day DESC LIMIT 14) SELECT day, n, round(100.0 * n / max(n) OVER (), 6) AS bar FROM l""")
def a43_daily_peak(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last = days.orderBy(F.desc("day")).limit(14)
    return last.select("day", "n", F.round(100.0 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))), 6).alias("bar"))


@query("""SELECT event_type, user_id % 7 AS grp, count(*) AS n, grouping(event_type) AS all_types FROM events GROUP BY CUBE (event_type, grp)""")
def n01_cube(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("grp", F.col("user_id") % 7)
    return e.cube("event_type", "grp").agg(F.count("*").alias("n"), F.grouping("event_type").cast("long").alias("all_types"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS started, count(*) AS events FROM s GROUP BY user_id, sid""")
def n02_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("events"))
    return s.select("user_id", "started", "events")


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events)
SELECT user_id, CAST(seg AS BIGINT) AS segment, count(*) AS events, bool_or(event_type = 'purchase') AS settled FROM m WHERE seg > 0 GROUP BY 1, 2""")
def w06_marker_segments(spark, sf_dir):
    """Half-open segments between signups, and whether a purchase falls into each."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = e.withColumn("segment", F.sum((F.col("event_type") == "signup").cast("long")).over(w)).where("segment > 0")
    return marked.groupBy("user_id", "segment").agg(F.count("*").alias("events"), F.bool_or(F.col("event_type") == "purchase").alias("settled"))


@query("""WITH t AS (SELECT user_id, ts, event_id, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, CAST(epoch_us(ts) - epoch_us(p) AS BIGINT) AS gap_us FROM t WHERE p IS NOT NULL""")
def w04_lag_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).alias("gap_us")).where("gap_us IS NOT NULL")


@query("""WITH g AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'background' ELSE CAST(user_id AS VARCHAR) END AS trace, ts, event_id, event_type, value FROM events)
SELECT trace, count(*) AS events, min(ts) AS started, max(ts) AS ended, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_type, (ts, event_id)) AS last_kind,
  CASE WHEN bool_or(event_type = 'error' AND value > 200) THEN 'aborted' WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'ok' END AS status FROM g GROUP BY 1""")
def a49_trace_runs(spark, sf_dir):
    """Traces with first and last step and a status by precedence."""
    e = table(spark, sf_dir, "events").withColumn("trace", F.when(F.col("user_id") % 10 == 0, "background").otherwise(F.col("user_id").cast("string")))
    at = F.struct("ts", "event_id")
    bad = F.col("event_type") == "error"
    status = F.when(F.bool_or(bad & (F.col("value") > 200)), "aborted").when(F.bool_or(bad), "error").otherwise("ok")
    return e.groupBy("trace").agg(
        F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min_by("event_type", at).alias("first_kind"),
        F.max_by("event_type", at).alias("last_kind"), status.alias("status"),
    )


@query("SELECT count(*) AS events, CAST(sum(length(props)) AS BIGINT) AS chars FROM events")
def s09_footprint(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count("*").alias("events"), F.sum(F.length("props")).alias("chars"))


@query("SELECT event_type AS kind, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def q09_kind_ranges(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS asked, count(*) FILTER (event_type = 'click') AS claimed,
  count(*) FILTER (event_type = 'purchase') AS passed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1""")
def a22_funnel(spark, sf_dir):
    kinds = {"asked": "view", "claimed": "click", "passed": "purchase", "failed": "error"}
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()])


@query("""WITH e AS (SELECT event_type || '-' || (user_id % 50) AS scene, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT scene, count(*) AS calls FROM e WHERE scene NOT IN (SELECT scene FROM e WHERE k < 5) GROUP BY 1""")
def j17_without_inventory(spark, sf_dir):
    """Scenes with calls of which none was taken into the inventory (k below 5)."""
    e = usage(spark, sf_dir).select(F.concat_ws("-", "scene", F.col("user_id") % 50).alias("scene"), "k")
    return e.join(e.where("k < 5").select("scene").distinct(), "scene", "left_anti").groupBy("scene").agg(F.count("*").alias("calls"))


@query("""SELECT event_type AS scene, count(*) AS calls FROM events e WHERE EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'signup' AND x.user_id = e.user_id) GROUP BY 1""")
def j16_attributable(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.where("event_type = 'signup'").select("user_id").distinct(), "user_id", "left_semi").groupBy(F.col("event_type").alias("scene")).agg(F.count("*").alias("calls"))
