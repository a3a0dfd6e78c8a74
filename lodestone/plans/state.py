"""State tables over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import state as S
from lodestone.operators import tables as O
from lodestone.plans.registry import query, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id IN (1, 7, 77)")
def q02_json_column(spark, sf_dir):
    """Point look-ups of one JSON field; the ids reach the scan."""
    return _events(spark, sf_dir).where(F.col("event_id").isin(1, 7, 77)).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id || ':' || event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def q03_cache(spark, sf_dir):
    """What a get returns after all puts, by cache key."""
    puts = _events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "ts", "event_id", "value")
    return S.latest_by(puts, ["key"], "ts", "event_id").select("key", "value")


@query("""WITH r AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000), k AS (SELECT *, CASE WHEN event_id % 5 > 0 THEN json_extract_string(props, '$.k') END AS key FROM r)
SELECT key, max(event_id) AS event_id FROM k WHERE key IS NOT NULL GROUP BY 1""")
def q04_latest_per_path(spark, sf_dir):
    """The newest row per key among the newest 2,000; every fifth row's JSON is cut off and skipped. Ids follow time."""
    props = F.when(F.col("event_id") % 5 > 0, F.col("props")).otherwise(F.lit('{"k'))
    return S.newest_valid(_events(spark, sf_dir), F.get_json_object(props, "$.k"), ["ts", "event_id"], 2000).select("key", "event_id")


@query("""SELECT kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT event_type AS kind, event_id AS id FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT 'click', o_orderkey FROM orders) GROUP BY 1""")
def q05_replace_kind(spark, sf_dir):
    old = _events(spark, sf_dir).select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    new = table(spark, sf_dir, "orders").select(F.lit("click").alias("kind"), F.col("o_orderkey").alias("id"))
    return S.replaced(old, new, ["click", "view"]).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT event_id, value FROM events WHERE event_type = 'error' AND user_id = 12")
def q06_fact_read(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'error' AND user_id = 12").select("event_id", "value")


@query("SELECT user_id AS path, arg_max(event_id, event_id) AS last, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 1")
def q07_kind_scan(spark, sf_dir):
    return _events(spark, sf_dir).where("event_type = 'view'").groupBy(F.col("user_id").alias("path")).agg(F.max("event_id").alias("last"), F.count("*").alias("n")).orderBy("path")


@query("SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def q10_keyed_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return O.without(_events(spark, sf_dir), gone, ["user_id"]).select("event_id")


@query("""WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS id, max(ts) + INTERVAL 3 DAY AS due FROM events GROUP BY 1) SELECT user_id, id, due FROM s WHERE kind <> 'error' ORDER BY due""")
def q11_review_schedule(spark, sf_dir):
    """The last save of each exercise; an error removes it."""
    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("kind"), F.max("event_id").alias("id"), (F.max("ts") + F.expr("INTERVAL 3 DAY")).alias("due"))
    return last.where("kind <> 'error'").select("user_id", "id", "due").orderBy("due")


@query("SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') = '12' ORDER BY ts DESC, event_id DESC LIMIT 1")
def q12_by_document_id(spark, sf_dir):
    return _events(spark, sf_dir).where(F.get_json_object("props", "$.k") == "12").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "props")


@query("""SELECT user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS kind, event_id % 2 AS version, max(event_id) AS id FROM events GROUP BY 1, 2, 3, 4 HAVING max(event_id) % 11 <> 0""")
def q13_four_column_cache(spark, sf_dir):
    """Keep-last by four columns; ids divisible by 11 are deleted afterwards."""
    k = (F.get_json_object("props", "$.k").cast("long") % 10).alias("kind")
    rows = _events(spark, sf_dir).select("user_id", "event_type", k, (F.col("event_id") % 2).alias("version"), F.col("event_id").alias("id"))
    return rows.groupBy("user_id", "event_type", "kind", "version").agg(F.max("id").alias("id")).where("id % 11 <> 0")


_CHATS = """WITH m AS (SELECT *, CASE WHEN (conv_id + turn) % 7 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM conversations), s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 5 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM conversations), """


def _chats(spark, sf_dir):
    gone = lambda hit: F.when(hit, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at")
    c = table(spark, sf_dir, "conversations")
    return c.select("*", gone((F.col("conv_id") + F.col("turn")) % 7 == 0)), c.select("conv_id").distinct().select("*", gone(F.col("conv_id") % 5 == 0))


@query(_CHATS + """l AS (SELECT m.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM m JOIN s USING (conv_id) WHERE m.deleted_at IS NULL AND s.deleted_at IS NULL)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS seq FROM l WHERE back <= 3""")
def q17_live_tail(spark, sf_dir):
    """The last three live messages of each live session, in order."""
    return S.tail_in_order(S.live_messages(*_chats(spark, sf_dir), "conv_id"), ["conv_id"], "turn", 3).select("conv_id", "turn", "seq")


@query(_CHATS + """x AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2024-02-01' ELSE deleted_at END AS deleted_at, conv_id % 3 = 0 AND deleted_at IS NULL AS changed FROM m)
SELECT conv_id, count(*) FILTER (changed) AS changed, count(*) FILTER (deleted_at IS NULL) AS live FROM x GROUP BY 1""")
def q19_soft_delete(spark, sf_dir):
    """Sessions divisible by 3 are deleted: how many rows that changed, and how many are left."""
    m, _ = _chats(spark, sf_dir)
    hit = (F.col("conv_id") % 3 == 0) & F.col("deleted_at").isNull()
    after = m.withColumns({"changed": hit, "deleted_at": F.when(hit, F.lit("2024-02-01").cast("timestamp")).otherwise(F.col("deleted_at"))})
    return after.groupBy("conv_id").agg(F.count_if("changed").alias("changed"), F.count_if(F.col("deleted_at").isNull()).alias("live"))


@query(_CHATS + "x AS (SELECT 1) SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user' AND deleted_at IS NOT NULL) AS deleted_questions FROM m GROUP BY 1")
def q20_message_counts(spark, sf_dir):
    m, _ = _chats(spark, sf_dir)
    return m.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if((F.col("role") == "user") & F.col("deleted_at").isNotNull()).alias("deleted_questions"))


_ROUNDS = """WITH r AS (SELECT user_id AS thread, event_type AS scene, event_id AS round, CASE WHEN event_id % 4 = 0 THEN 'await_user' WHEN event_id % 4 = 1 THEN 'done' END AS stopped_reason, event_id % 3 AS input,
  CASE WHEN event_id % 4 = 0 THEN 'call' || (event_id % 20) END AS pending, event_id % 2 AS prompt, ts AS updated_at FROM events) """


def _rounds(spark, sf_dir):
    i = F.col("event_id")
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("thread"), F.col("event_type").alias("scene"), i.alias("round"), F.when(i % 4 == 0, "await_user").when(i % 4 == 1, "done").alias("stopped_reason"), (i % 3).alias("input"),
        F.when(i % 4 == 0, F.concat(F.lit("call"), (i % 20).cast("string"))).alias("pending"), (i % 2).alias("prompt"), F.col("ts").alias("updated_at"),
    )


@query(_ROUNDS + """, l AS (SELECT thread, scene, max(round) AS round, arg_max(input, round) AS input, arg_max(struct_pack(s := stopped_reason), round).s AS stopped_reason FROM r WHERE coalesce(stopped_reason, '') <> 'await_user' GROUP BY 1, 2)
SELECT thread, scene, round, stopped_reason FROM l WHERE input = 1""")
def q21_checkpoints(spark, sf_dir):
    return S.checkpoint(_rounds(spark, sf_dir), ["thread", "scene"], F.col("input") == 1).select("thread", "scene", "round", "stopped_reason")


_CLAIMS = ", c AS (SELECT DISTINCT thread, scene, 'call4' AS pending, thread % 2 AS prompt FROM r WHERE thread % 3 = 0) "


def _claims(rounds):
    return rounds.where("thread % 3 = 0").select("thread", "scene", F.lit("call4").alias("pending"), (F.col("thread") % 2).alias("prompt")).distinct()


@query(_ROUNDS + _CLAIMS + """, l AS (SELECT thread, scene, pending, max(round) AS round, arg_max(prompt, round) AS prompt FROM r WHERE pending IS NOT NULL GROUP BY 1, 2, 3)
SELECT c.thread, c.scene, c.pending, CASE WHEN l.prompt = c.prompt THEN l.round END AS round FROM c JOIN l USING (thread, scene, pending)""")
def q22_claims(spark, sf_dir):
    r = _rounds(spark, sf_dir)
    return S.claimed(r, _claims(r), ["thread", "scene"])[0]


@query(_ROUNDS + _CLAIMS + """SELECT count(*) AS left_rows, min(updated_at) AS oldest FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.thread = r.thread AND c.scene = r.scene AND c.pending = r.pending) AND updated_at >= TIMESTAMP '2024-01-05'""")
def q22_after_claims(spark, sf_dir):
    """Rows and the oldest of them once claimed rounds are taken and old ones pruned."""
    r = _rounds(spark, sf_dir)
    left = S.claimed(r, _claims(r), ["thread", "scene"])[1].where("updated_at >= TIMESTAMP_NTZ '2024-01-05'")
    return left.agg(F.count("*").alias("left_rows"), F.min("updated_at").alias("oldest"))


@query(_ROUNDS + """SELECT thread, count(*) FILTER (updated_at < TIMESTAMP '2024-01-08') AS expired, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-08') AS new_question FROM r WHERE pending IS NOT NULL AND pending <> 'call8' GROUP BY 1""")
def q22_settled(spark, sf_dir):
    rows = S.settled(_rounds(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-08'"), F.col("pending") == "call8")
    return rows.groupBy("thread").agg(*[F.count_if(F.col("cause") == c).alias(c) for c in ("expired", "new_question")])


@query("""SELECT page_id % 4 AS repository, page_id AS id, arg_max(url, page_id) AS name FROM pages WHERE page_id % 9 <> 0 GROUP BY 1, 2""")
def q23_diagrams(spark, sf_dir):
    """Diagrams by repository after puts and removals (ids divisible by 9)."""
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("repository"), F.col("page_id").alias("id"), F.col("url").alias("name"))
    return rows.where("id % 9 <> 0").groupBy("repository", "id").agg(F.max_by("name", "id").alias("name"))


_TOPICS = "WITH t AS (SELECT c_custkey AS id, c_name AS label, CASE WHEN c_custkey % 6 = 0 THEN 1 END AS deleted_at, CASE WHEN c_custkey % 4 = 0 THEN c_custkey - 1 END AS merged_into FROM customer) "


def _topics(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("label"), F.when(k % 6 == 0, 1).alias("deleted_at"), F.when(k % 4 == 0, k - 1).alias("merged_into"))


@query(_TOPICS + "SELECT id, label FROM t WHERE deleted_at IS NULL AND merged_into IS NULL")
def q24_active_topics(spark, sf_dir):
    return _topics(spark, sf_dir).where("deleted_at IS NULL AND merged_into IS NULL").select("id", "label")


@query(_TOPICS + "SELECT coalesce(t.merged_into, o_custkey) AS topic, count(*) AS facts FROM orders LEFT JOIN t ON t.id = o_custkey AND t.merged_into IS NOT NULL GROUP BY 1")
def q26_merged_topics(spark, sf_dir):
    """Facts of merged topics count for the one that they went into."""
    merges = _topics(spark, sf_dir).where("merged_into IS NOT NULL").select(F.col("id").alias("src"), F.col("merged_into").alias("dst"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"))
    return S.merge_topics(facts, merges).groupBy("topic").agg(F.count("*").alias("facts"))


@query("SELECT event_id FROM events WHERE user_id = 3 AND event_type = 'purchase' ORDER BY ts, event_id")
def q28_filtered_list(spark, sf_dir):
    """Only the given filters apply."""
    given = {"user_id": 3, "event_type": "purchase", "value": None}
    rows = _events(spark, sf_dir)
    for name, value in given.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.orderBy("ts", "event_id").select("event_id")


@query("""SELECT (SELECT count(*) FROM events WHERE user_id = 5) AS contributions, (SELECT count(*) FROM events WHERE user_id <> 5) AS events_left, (SELECT count(*) FROM orders WHERE o_custkey <> 5) AS orders_left""")
def q29_forgotten(spark, sf_dir):
    e, o = _events(spark, sf_dir), table(spark, sf_dir, "orders")
    rows = e.select(F.lit("event").alias("of"), F.col("user_id").alias("repository")).unionByName(o.select(F.lit("order").alias("of"), F.col("o_custkey").alias("repository")))
    mine, event = F.col("repository") == 5, F.col("of") == "event"
    return rows.agg(F.count_if(event & mine).alias("contributions"), F.count_if(event & ~mine).alias("events_left"), F.count_if(~event & ~mine).alias("orders_left"))


@query("""SELECT name, 'string' AS type FROM (VALUES ('k'), ('audit'), ('score')) x(name) WHERE name NOT IN (SELECT unnest(json_keys(props)) FROM events)""")
def q30_schema_gaps(spark, sf_dir):
    """Fields that the declared payload has and no event's payload does."""
    e = table(spark, sf_dir, "events")
    keys = e.select(F.explode(F.json_object_keys("props")).alias("key")).distinct()
    # as many as payloads have different fields
    found = e.select(*[F.get_json_object("props", f"$.{r.key}").alias(r.key) for r in keys.orderBy("key").collect()])
    declared = e.select(*[F.lit("x").alias(name) for name in ("k", "audit", "score")])
    return spark.createDataFrame(O.schema_gaps(declared, found), "name string, type string")


@query("SELECT user_id, max(event_id) AS at FROM events GROUP BY 1 ORDER BY 2")
def s22_recency_list(spark, sf_dir):
    return S.recency_list(_events(spark, sf_dir), "user_id", "event_id").select("user_id", F.col("event_id").alias("at")).orderBy("at")


@query("""SELECT c_custkey AS repository, coalesce(n, 0) AS events, n IS NOT NULL AS mounted, CASE WHEN last_at IS NULL THEN 'unknown' WHEN last_at < TIMESTAMP '2024-01-25' THEN 'stale' ELSE 'fresh' END AS freshness
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1) ON user_id = c_custkey""")
def s23_catalogue(spark, sf_dir):
    seen = _events(spark, sf_dir).groupBy(F.col("user_id").alias("repository")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    fresh = F.when(F.col("last_at").isNull(), "unknown").when(F.col("last_at") < F.expr("TIMESTAMP_NTZ '2024-01-25'"), "stale").otherwise("fresh")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository")).join(seen, "repository", "left")
    return rows.select("repository", F.coalesce("n", F.lit(0)).alias("events"), F.col("n").isNotNull().alias("mounted"), fresh.alias("freshness"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'engine-owned-event' WHEN event_type = 'signup' THEN 'unknown-event' WHEN event_id % 7 = 0 THEN 'payload-too-long' WHEN event_id % 5 = 0 THEN 'session-id-invalid' END AS failure FROM events""")
def s24_validated_events(spark, sf_dir):
    i = F.col("event_id")
    text = F.when(i % 7 == 0, F.repeat(F.lit("x"), 2001)).otherwise(F.col("props"))
    posted = _events(spark, sf_dir).select(i, F.col("event_type").alias("type"), F.create_map(F.lit("p"), text, F.lit("q"), F.lit(None)).alias("payload"), F.when(i % 5 == 0, F.repeat(F.lit("s"), 201)).alias("session"))
    return S.validated(posted, ["error"], ["view", "click", "purchase"]).select("event_id", "failure")


@query("""WITH o AS (SELECT p_partkey AS path, p_size AS h FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 8 = 0 THEN p_size + 1 WHEN p_partkey % 50 = 3 THEN NULL ELSE p_size END AS h FROM part WHERE p_partkey % 10 <> 2)
SELECT count(*) FILTER (o.path IS NULL) AS added, count(*) FILTER (n.path IS NULL) AS gone, count(*) FILTER (o.path IS NOT NULL AND n.path IS NOT NULL AND (o.h IS NULL OR n.h IS NULL OR o.h <> n.h)) AS changed FROM o FULL JOIN n ON o.path = n.path""")
def p09_ingest_changes(spark, sf_dir):
    """P09 and U04: paths added, gone and changed between two scans; a missing hash counts as changed."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = p.where(k % 10 != 1).select(k.alias("path"), F.col("p_size").alias("h1"), F.lit(1).alias("o"))
    new = p.where(k % 10 != 2).select(k.alias("path"), F.when(k % 8 == 0, F.col("p_size") + 1).when(k % 50 != 3, F.col("p_size")).alias("h2"), F.lit(1).alias("n"))
    both = old.join(new, "path", "full_outer")
    here = F.col("o").isNotNull() & F.col("n").isNotNull()
    return both.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("gone"), F.count_if(here & ~F.coalesce(F.col("h1") == F.col("h2"), F.lit(False))).alias("changed"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS exercise, l_partkey AS path, l_partkey % 100 AS h FROM lineitem), p AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 15 = 0 THEN -1 ELSE p_partkey % 100 END AS h FROM part WHERE p_partkey % 40 <> 7)
SELECT exercise, array_to_string(list_sort(list(d.path)), ',') AS stale FROM d LEFT JOIN p USING (path) WHERE p.h IS NULL OR p.h <> d.h GROUP BY 1""")
def p10_stale_dependencies(spark, sf_dir):
    """Exercises with the files they depend on whose hash has changed or that are gone."""
    deps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("exercise"), F.col("l_partkey").alias("path"), (F.col("l_partkey") % 100).alias("h")).distinct()
    k = F.col("p_partkey")
    now = table(spark, sf_dir, "part").where(k % 40 != 7).select(k.alias("path"), F.when(k % 15 == 0, -1).otherwise(k % 100).alias("now"))
    stale = deps.join(now, "path", "left").where(F.col("now").isNull() | (F.col("now") != F.col("h")))
    return stale.groupBy("exercise").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("stale"))


@query("""SELECT src, dst, kind, min(ord) AS ord FROM (SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) GROUP BY 1, 2, 3""")
def u01_ordered_distinct(spark, sf_dir):
    """Each edge once, where it came first."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))


@query("""WITH r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations) SELECT conv_id, count(*) AS kept, CAST(max(used) AS BIGINT) AS chars FROM r WHERE used <= 400 GROUP BY 1""")
def w08_budget_prefix(spark, sf_dir):
    """Turns from the start while they fit in 400 characters."""
    used = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").withColumn("used", used).where("used <= 400").groupBy("conv_id").agg(F.count("*").alias("kept"), F.max("used").alias("chars"))


@query("""SELECT user_id, ['impact', 'localise', 'patch'][1 + n % 3] AS next_kind FROM (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1)""")
def w12_kind_rotation(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("impact", "localise", "patch")))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.get(kinds, (F.col("n") % 3).cast("int")).alias("next_kind"))
