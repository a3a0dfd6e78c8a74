"""Learner queries: events of type purchase are passed, errors failed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import learning as L
from lodestone.operators import learner as O
from lodestone.plans.registry import query, table

_SQL = """WITH results AS (SELECT event_id AS ord, ts AS ended, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'purchase' AS passed,
  least(1.0, value / 400) AS score, CASE WHEN user_id % 7 = 0 THEN 'execution' WHEN user_id % 7 = 1 THEN 'set_match' WHEN user_id % 7 = 2 THEN 'rubric' WHEN user_id % 7 = 3 THEN 'other' END AS grading_mode,
  CASE WHEN user_id % 3 = 0 THEN 'patch_edit' WHEN user_id % 3 = 1 THEN 'trace' ELSE 'llm_rubric' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'review' END AS attempt_kind
  FROM events WHERE event_type IN ('purchase', 'error')),
tried AS (SELECT *, coalesce(attempt_kind, CASE WHEN row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY ended, ord) = 1 THEN 'first' ELSE 'retry' END) AS attempt FROM results),
rated AS (SELECT *, (CASE WHEN grading_mode = 'execution' THEN 1.0 WHEN grading_mode = 'set_match' THEN 0.8 WHEN grading_mode = 'rubric' THEN 0.5
  WHEN kind = 'llm_rubric' THEN 0.5 WHEN kind IN ('patch_edit', 'author_function') THEN 1.0 ELSE 0.8 END)::DOUBLE *
  (CASE attempt WHEN 'review' THEN CASE WHEN passed THEN 0.5 ELSE -1.0 END ELSE CASE WHEN passed THEN 1.0 ELSE -0.6 END END)::DOUBLE AS delta FROM tried) """


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    k = F.get_json_object("props", "$.k").cast("long")
    mode = F.when(F.col("user_id") % 7 == 0, "execution").when(F.col("user_id") % 7 == 1, "set_match").when(F.col("user_id") % 7 == 2, "rubric").when(F.col("user_id") % 7 == 3, "other")
    kind = F.when(F.col("user_id") % 3 == 0, "patch_edit").when(F.col("user_id") % 3 == 1, "trace").otherwise("llm_rubric")
    rows = e.select(
        F.col("event_id").alias("ord"), F.col("ts").alias("at"), "user_id", k.alias("k"), (F.col("event_type") == "purchase").alias("passed"),
        F.least(F.lit(1.0), F.col("value") / 400).alias("score"), kind.alias("kind"), mode.alias("grading_mode"), F.when(F.col("event_id") % 5 == 0, "review").alias("attempt_kind"),
        F.concat_ws(":", "user_id", k % 20).alias("exercise"), F.col("user_id").alias("unit"),
    )
    return O.with_attempt_kind(rows)


_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, list(delta ORDER BY ended, ord)), lambda a, x: least(5.0::DOUBLE, greatest(0.0::DOUBLE, a + x)))"


@query(_SQL + "SELECT attempt, passed, count(*) AS n FROM tried GROUP BY 1, 2")
def w01_attempt_kinds(spark, sf_dir):
    return results(spark, sf_dir).groupBy("attempt", "passed").agg(F.count("*").alias("n"))


@query(_SQL + f"""SELECT user_id AS unit, count(*) AS attempts, count(*) FILTER (passed) AS successes, round({_FOLD}, 6) AS score,
  round(count(*) FILTER (passed) / count(*), 6) AS success_rate, round(least(1.0, count(*) / 5.0), 6) AS confidence,
  CAST(floor(round({_FOLD}, 9) + 0.5) AS INTEGER) AS level, max(ended) AS last_at FROM rated GROUP BY 1""")
def a11_mastery(spark, sf_dir):
    return O.mastery(results(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("score", "success_rate", "confidence")})


@query(_SQL + f"""SELECT CAST(arg_max(level, (last_at, unit)) AS INTEGER) AS level FROM
  (SELECT user_id AS unit, max(ended) AS last_at, floor(round({_FOLD}, 9) + 0.5) AS level FROM rated GROUP BY 1)""")
def a12_current_mastery(spark, sf_dir):
    return O.current_mastery(O.mastery(results(spark, sf_dir)))


@query(_SQL + f"""SELECT k % 10 AS topic, count(*) AS attempts, count(*) FILTER (grading_mode = 'execution') AS executions, round({_FOLD}, 6) AS score,
  max(ended) AS last_at FROM rated GROUP BY 1""")
def a13_topics(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("topic", F.col("k") % 10)
    counts = rows.groupBy("topic").agg(F.count_if(F.col("grading_mode") == "execution").alias("executions"))
    return O.mastery(rows, "topic").join(counts, "topic").select("topic", "attempts", "executions", F.round("score", 6).alias("score"), "last_at")


@query(_SQL + """SELECT user_id, count(*) AS attempts, count(*) FILTER (passed AND attempt = 'first') AS first_passes, max(ended) AS last_at FROM tried GROUP BY 1""")
def a15_snapshot(spark, sf_dir):
    return results(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("passed") & (F.col("attempt") == "first")).alias("first_passes"), F.max("at").alias("last_at")
    )


_SM2_STEP = """{'reps': CASE WHEN x.q < 3 THEN 0 ELSE a.reps + 1 END,
  'ivl': CASE WHEN x.q < 3 THEN 1 WHEN a.reps + 1 = 1 THEN 1 WHEN a.reps + 1 = 2 THEN 6 ELSE CAST(greatest(1, floor(a.ivl * greatest(1.3::DOUBLE, a.ease + 0.1::DOUBLE - (5 - x.q) * (0.08::DOUBLE + (5 - x.q) * 0.02::DOUBLE)) + 0.5)) AS BIGINT) END,
  'ease': greatest(1.3::DOUBLE, a.ease + 0.1::DOUBLE - (5 - x.q) * (0.08::DOUBLE + (5 - x.q) * 0.02::DOUBLE)), 'q': x.q}"""


@query(_SQL + f"""SELECT exercise, CAST(s.reps AS INTEGER) AS repetitions, CAST(s.ivl AS INTEGER) AS "interval", round(s.ease, 6) AS easiness,
  CAST(last_at AS DATE) + CAST(s.ivl AS INTEGER) AS due FROM (
  SELECT user_id || ':' || (k % 20) AS exercise, max(ended) AS last_at, list_reduce(list_prepend({{'reps': 0::BIGINT, 'ivl': 0::BIGINT, 'ease': 2.5::DOUBLE, 'q': 0::DOUBLE}},
    list({{'reps': 0::BIGINT, 'ivl': 0::BIGINT, 'ease': 0::DOUBLE, 'q': (CASE WHEN score >= 0.95 THEN 5 WHEN score >= 0.8 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END)::DOUBLE}} ORDER BY ended, ord)),
    lambda a, x: {_SM2_STEP}) AS s FROM tried GROUP BY 1)""")
def l01_review_plan(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("quality", L.quality_for_score(F.col("score")))
    return O.review_plan(rows, "exercise").withColumn("easiness", F.round("easiness", 6))


@query()
def l02_faded_support(spark, sf_dir):
    return O.faded_support(results(spark, sf_dir), "unit")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_size % 5 + 1 AS difficulty FROM part WHERE abs(p_size % 5 + 1 - 3) <= 1
  ORDER BY abs(p_size % 5 + 1 - 3), difficulty, p_size, id LIMIT 1""")
def l04_next_exercise(spark, sf_dir):
    bank = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 5 + 1).alias("difficulty"), F.col("p_size").alias("external_deps")
    )
    return O.next_exercise(bank, 3).select("id", "difficulty")


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey % 7)) AS given FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(list_intersect([0, 1, 2], given)) AS INTEGER) AS matched, CAST(3 - len(list_intersect([0, 1, 2], given)) AS INTEGER) AS missing,
  CAST(len(given) - len(list_intersect([0, 1, 2], given)) AS INTEGER) AS unexpected,
  round(len(list_intersect([0, 1, 2], given)) / (3 + len(given) - len(list_intersect([0, 1, 2], given))), 6) AS score FROM s""")
def l06_set_grading(spark, sf_dir):
    given = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 7).alias("given"))
    expected = F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)])
    g = O.set_grade(expected, F.col("given"))
    return given.select("l_orderkey", g.alias("g")).select("l_orderkey", "g.matched", "g.missing", "g.unexpected", F.round("g.score", 6).alias("score"))
