"""Further roll-ups, predicates and rankings over the star tables and the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import learning as L
from lodestone.functions import text as T
from lodestone.plans.registry import query, table


@query("SELECT p_brand AS path, count(*) AS symbols FROM part GROUP BY 1")
def a07_symbols_per_file(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("symbols"))


@query("SELECT l_partkey AS callee, count(*) AS calls, bool_or(l_linenumber = 1) AS by_entry FROM lineitem GROUP BY 1")
def a08_in_degree(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("callee")).agg(F.count("*").alias("calls"), F.bool_or(F.col("l_linenumber") == 1).alias("by_entry"))


@query("""SELECT CASE lang WHEN 'en' THEN 'anglo' WHEN 'de' THEN 'germanic' ELSE 'romance' END AS stack, count(*) AS files FROM documents GROUP BY 1""")
def a09_stacks(spark, sf_dir):
    stacks = F.create_map(F.lit("en"), F.lit("anglo"), F.lit("de"), F.lit("germanic"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(stacks[F.col("lang")], F.lit("romance")).alias("stack")).agg(F.count("*").alias("files"))


@query("SELECT c_mktsegment AS stack, count(*) AS attempts, max(o_orderdate) AS last_at FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def a14_stack_attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return o.groupBy(F.col("c_mktsegment").alias("stack")).agg(F.count("*").alias("attempts"), F.max("o_orderdate").alias("last_at"))


@query("""WITH w AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY), n AS (SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, min(event_id) AS first FROM w GROUP BY 1)
SELECT k, n FROM n ORDER BY n DESC, first LIMIT 1""")
def a16_recent_focus(spark, sf_dir):
    """The most opened item of the last seven days; a tie goes to the one seen first."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts")).first()[0]
    recent = e.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 7 DAYS")).groupBy(F.get_json_object("props", "$.k").alias("k"))
    return recent.agg(F.count("*").alias("n"), F.min("event_id").alias("first")).orderBy(F.desc("n"), "first").limit(1).select("k", "n")


@query("""WITH u AS (SELECT c_mktsegment AS unit, avg(c_acctbal) AS level, count(*) AS attempts FROM customer GROUP BY 1)
SELECT unit, CASE WHEN attempts < 5 THEN 'observe' WHEN level < 4400 THEN 'guided' WHEN level < 4600 THEN 'balanced' ELSE 'free' END AS setting FROM u""")
def a17_settings(spark, sf_dir):
    u = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("unit")).agg(F.avg("c_acctbal").alias("level"), F.count("*").alias("attempts"))
    setting = F.when(F.col("attempts") < 5, "observe").when(F.col("level") < 4400, "guided").when(F.col("level") < 4600, "balanced").otherwise("free")
    return u.select("unit", setting.alias("setting"))


@query("SELECT count(*) FILTER (o_orderdate <= TIMESTAMP '1997-01-01') AS due, count(*) AS scheduled FROM orders")
def a18_due_count(spark, sf_dir):
    due = F.col("o_orderdate") <= F.expr("TIMESTAMP_NTZ '1997-01-01'")
    return table(spark, sf_dir, "orders").agg(F.count_if(due).alias("due"), F.count("*").alias("scheduled"))


@query("""SELECT l_returnflag AS provider, l_linestatus AS model, count(*) AS calls, round(sum(l_quantity), 6) AS chars, count(*) FILTER (l_tax = 0) AS masked FROM lineitem GROUP BY 1, 2""")
def a28_egress_by_model(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model")).agg(
        F.count("*").alias("calls"), F.round(F.sum("l_quantity"), 6).alias("chars"), F.count_if(F.col("l_tax") == 0).alias("masked")
    )


@query("""WITH a AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (o_orderpriority = '1-URGENT') AS base, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (o_orderpriority = '5-LOW') AS trial FROM orders)
SELECT round(100 * (trial - base), 6) AS points, CASE WHEN trial < base - 0.05 THEN 'drop' WHEN trial > base + 0.05 THEN 'adopt' ELSE 'keep' END AS verdict FROM a""")
def a32_gate(spark, sf_dir):
    rate = lambda arm: F.avg(F.when(F.col("o_orderpriority") == arm, (F.col("o_orderstatus") == "F").cast("double")))
    arms = table(spark, sf_dir, "orders").agg(rate("1-URGENT").alias("base"), rate("5-LOW").alias("trial"))
    gain = F.col("trial") - F.col("base")
    return arms.select(F.round(100 * gain, 6).alias("points"), F.when(gain < -0.05, "drop").when(gain > 0.05, "adopt").otherwise("keep").alias("verdict"))


@query("""WITH c AS (SELECT unnest(['long', 'lettered', 'lined']) AS name, unnest([n_chars > 300, text SIMILAR TO '.*[a-z].*' OR regexp_matches(text, '[a-z]'), contains(text, chr(10))]) AS ok FROM documents)
SELECT name, count(*) AS checked, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 8) AS rate FROM c GROUP BY 1""")
def a35_invariant_rates(spark, sf_dir):
    checks = {"long": F.col("n_chars") > 300, "lettered": F.col("text").rlike("[a-z]"), "lined": F.contains("text", F.lit("\n"))}
    rows = table(spark, sf_dir, "documents").select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("ok")) for k, v in checks.items()])).alias("c"))
    return rows.groupBy("c.name").agg(F.count("*").alias("checked"), F.round(F.avg(F.col("c.ok").cast("double")), 8).alias("rate"))


@query("""SELECT source, round(count(*) FILTER (quality = 1) / count(*), 8) AS legal_rate, count(*) FILTER (toxic = 1) AS rejected FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def a39_acceptance(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 8).alias("legal_rate"), F.count_if(F.col("toxic") == 1).alias("rejected"))


@query("""SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) AS BIGINT) AS used FROM lineitem GROUP BY 1""")
def a45_usage_sum(spark, sf_dir):
    """Both sides missing stays missing."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))).alias("used"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS v, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, CAST(v AS INTEGER) AS version FROM e WHERE v > n - 3""")
def w10_last_versions(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").withColumns({"version": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")), "n": F.count("*").over(w)})
    return rows.where("version > n - 3").select("l_orderkey", "version")


@query("""WITH s AS (SELECT conv_id, turn * 2 AS at_turn, 'model' AS step FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn * 2 + 1, 'tool' FROM conversations WHERE role = 'user')
SELECT conv_id, step, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY at_turn, step) AS INTEGER) AS seq FROM s""")
def w13_interleaved_steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    steps = c.where("role = 'assistant'").select("conv_id", (F.col("turn") * 2).alias("t"), F.lit("model").alias("step")).unionByName(
        c.where("role = 'user'").select("conv_id", (F.col("turn") * 2 + 1).alias("t"), F.lit("tool").alias("step"))
    )
    return steps.select("conv_id", "step", F.row_number().over(Window.partitionBy("conv_id").orderBy("t", "step")).alias("seq"))


@query("SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey")
def u06_edges_without_loops(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


@query("""SELECT 'event' AS origin, event_type AS kind, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'turn', role, count(*) FROM conversations GROUP BY 2""")
def u05_evidence_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), F.col("event_type").alias("kind"))
    c = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("origin"), F.col("role").alias("kind"))
    return e.unionByName(c).groupBy("origin", "kind").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS left_only, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS right_only""")
def u07_partition_check(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).withColumn("l", F.lit(1))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("r", F.lit(1))
    return c.join(o, "k", "full_outer").agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'unknown' WHEN lang <> 'en' THEN 'stale' WHEN n_chars % 2 = 0 THEN 'fresh' ELSE 'drifted' END AS verdict FROM documents""")
def p08_freshness(spark, sf_dir):
    verdict = F.when(F.col("n_chars") == 0, "unknown").when(F.col("lang") != "en", "stale").when(F.col("n_chars") % 2 == 0, "fresh").otherwise("drifted")
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query("""SELECT p_partkey, CAST(least(5, greatest(1, 1 + p_size // 2)) AS INTEGER) AS difficulty, CASE WHEN p_retailprice >= 1500 THEN 5 WHEN p_retailprice >= 1000 THEN 4 WHEN p_retailprice >= 950 THEN 1 ELSE 0 END AS quality FROM part""")
def f23_unit_difficulty(spark, sf_dir):
    q = L.quality_for_score(F.when(F.col("p_retailprice") >= 1500, 1.0).when(F.col("p_retailprice") >= 1000, 0.8).when(F.col("p_retailprice") >= 950, 0.01).otherwise(0.0))
    return table(spark, sf_dir, "part").select("p_partkey", L.clamp(1 + F.floor(F.col("p_size") / 2), 1, 5).cast("int").alias("difficulty"), q.alias("quality"))


@query(r"""SELECT page_id, regexp_extract(url, '[^/]*$') AS base, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '.' END AS dir FROM pages""")
def f28_path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("base"), T.dirname(F.col("url")).alias("dir"))


@query("SELECT conv_id, turn, length(text) AS chars, substr(sha256(text), 1, 12) AS fingerprint FROM conversations WHERE text IS NOT NULL")
def f19_outbound_fingerprints(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", F.length("text").cast("long").alias("chars"), T.short_hash(F.col("text"), 12).alias("fingerprint"))
