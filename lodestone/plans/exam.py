"""Exam landings, block ranks, notes and the bank over tables: parts are files of three lines with two symbols,
nations are points, events are notes, documents are declaration blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import code, exam
from lodestone.plans.registry import query, table


def _s(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _tree(spark, sf_dir):
    p, k = table(spark, sf_dir, "part").select("p_partkey").distinct(), F.col("p_partkey")
    path = _s("src/m", k, ".ts").alias("path")
    texts = F.array(_s("class T", k % 40, " {"), _s("  run(load", k % 25, "(x));"), F.when(k % 9 == 0, _s("  if (x) retry", k % 25, "(load(y));")).otherwise("}"))
    lines = p.select(path, F.posexplode(texts).alias("at", "content")).select("path", (F.col("at") + 1).alias("line"), "content")
    names = F.array(F.struct(_s("T", k % 40).alias("name"), F.lit(1).alias("line")), F.struct(_s("load", k % 25).alias("name"), F.lit(2).alias("line")))
    symbols = p.select(path, F.explode(names).alias("n")).select("path", "n.name", "n.line")
    return symbols, lines


@query(r"""WITH f AS (SELECT DISTINCT p_partkey AS k, 'src/m' || p_partkey || '.ts' AS path FROM part), n AS (SELECT n_nationkey AS n FROM nation)
SELECT 'p' || n AS point, path, 1 AS line, 'T' || n AS symbol, 0 AS signal FROM n JOIN f ON k % 40 = n AND k % 25 = n
UNION ALL SELECT 'p' || n, path, 3, NULL, 5 FROM n JOIN f ON k % 9 = 0 AND k % 25 = n""")
def t12_landings(spark, sf_dir):
    """Points with two groups of probes: a symbol and a text, or a text."""
    symbols, lines = _tree(spark, sf_dir)
    n = F.col("n_nationkey")
    points = table(spark, sf_dir, "nation").select(_s("p", n).alias("point"), _s("sym:t", n, r" & text:LOAD", n, r"\( & call:any; text:retry", n, r"\(; op:none").alias("probes"))
    return exam.landings(points, symbols, lines, code.signal(lines))


@query("""WITH b AS (SELECT doc_id, doc_id % 5 AS declared, lower(text) AS body FROM documents WHERE doc_id % 5 >= 2), c AS (SELECT DISTINCT lower(substr(text, 1, 6)) AS clue FROM benchmark),
m AS (SELECT doc_id, declared, clue, count(*) OVER (PARTITION BY clue) AS df FROM b JOIN c ON contains(body, clue)) SELECT doc_id, count(*) AS matched, round(sum(1.0 / df) + least(declared, 3) / 100.0, 9) AS score FROM m GROUP BY doc_id, declared""")
def t10_block_ranks(spark, sf_dir):
    """Blocks by the clues that they hold; a clue found everywhere weighs little."""
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("start"), (F.col("doc_id") % 5).alias("declared"), F.col("text").alias("body"))
    clues = table(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", 1, 6)).alias("clue"))
    return exam.block_ranks(blocks, clues).select(F.col("path").alias("doc_id"), "matched", F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT event_id AS ord, user_id % 60 AS f, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT 'f' || f AS file, CASE WHEN ord % 2 = 0 AND k % 4 = 0 THEN 'old' ELSE 'h' || (f % 3) END AS hash, ord % 2 AS side, ord, 'p' || (k % (5 + f)) AS point, k % 7 AS line, k % 3 AS level FROM e),
live AS (SELECT n.* FROM n JOIN (SELECT DISTINCT file FROM n WHERE side = 1) USING (file) WHERE side = 1 OR hash <> 'old'),
m AS (SELECT file, hash, point, line, (arg_min(level, (CASE WHEN level = 0 THEN 9 ELSE level END, side, ord))) AS level, min((side, ord)) AS came FROM live GROUP BY file, hash, point, line),
c AS (SELECT *, count(*) OVER (PARTITION BY file) AS n, row_number() OVER (PARTITION BY file, point ORDER BY came DESC) AS last, min(came) OVER (PARTITION BY file, point) AS pc FROM m),
d AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY pc DESC) AS place FROM c WHERE n > 12 AND last = 1) SELECT file, hash, point, line, level FROM c WHERE n <= 12 UNION ALL SELECT file, hash, point, line, level FROM d WHERE place <= 12""".replace("(arg_min(level, (CASE WHEN level = 0 THEN 9 ELSE level END, side, ord)))", "arg_min(level, {'a': CASE WHEN level = 0 THEN 9 ELSE level END, 'b': side, 'c': ord})").replace("min((side, ord)) AS came", "min({'b': side, 'c': ord}) AS came"))
def l11_merged_notes(spark, sf_dir):
    """Even events are the notes that a file has, odd ones those that come; some are of an older content."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    f, k = F.col("user_id") % 60, F.col("k")
    rows = e.select(
        _s("f", f).alias("file"), F.when((F.col("event_id") % 2 == 0) & (k % 4 == 0), "old").otherwise(_s("h", f % 3)).alias("hash"), F.col("event_id").alias("ord"),
        _s("p", k % (f + 5)).alias("point"), (k % 7).alias("line"), (k % 3).alias("level"),
    )
    return exam.merge_notes(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"))


@query("""WITH s AS (SELECT l_partkey % 700 AS exercise, arg_max(l_orderkey, {'a': l_shipdate, 'b': l_orderkey}) AS created FROM lineitem GROUP BY 1), d AS (SELECT p_partkey % 700 AS exercise, max(p_size) AS due FROM part WHERE p_partkey % 3 = 0 AND p_partkey < 600 GROUP BY 1)
SELECT exercise, created, due, row_number() OVER (ORDER BY due NULLS LAST, CASE WHEN due IS NULL THEN created END DESC, exercise) AS place FROM s LEFT JOIN d USING (exercise)""")
def j14_bank(spark, sf_dir):
    """Exercises with a review by due date, then the others, the newest first."""
    stored = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 700).alias("exercise"), F.col("l_orderkey").alias("created"), F.col("l_shipdate").alias("at"))
    due = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 AND p_partkey < 600").select((F.col("p_partkey") % 700).alias("exercise"), F.col("p_size").alias("due"))
    return exam.bank(stored, due)
