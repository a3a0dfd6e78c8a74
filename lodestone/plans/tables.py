"""Keep-latest, upsert, semi and anti joins, rankings and set operations over the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import short_hash
from lodestone.operators import evals, joins
from lodestone.operators import tables as O
from lodestone.operators.usage import keyed_top
from lodestone.operators.ranks import indexed
from lodestone.plans.registry import query, table


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def w03_latest_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return O.keep_latest(o.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders)
SELECT id, arg_max(status, ord) FILTER (status IS NOT NULL) AS status, arg_max(price, ord) FILTER (price IS NOT NULL) AS price, max(ord) AS ord FROM r GROUP BY 1""")
def q01_partial_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("status"))
    more = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"))
    return O.upsert(rows, more, ["id"], "ord")


@query("SELECT c_mktsegment AS kind, count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS chars FROM customer GROUP BY 1")
def q08_kind_sizes(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("c_name")).alias("chars"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q14_orphans(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return O.without(table(spark, sf_dir, "customer"), gone, ["c_custkey"]).select("c_custkey")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def q15_distinct_kinds(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct()


@query("""SELECT min(l_linenumber) AS first_line, l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY 2""")
def q27_insert_or_ignore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("first_line"))
    return O.keep_latest(rows, ["l_orderkey"], F.col("first_line"), F.col("l_partkey"))


@query("""WITH r AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank FROM r)
SELECT l_suppkey, l_partkey, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8""")
def w02_top_per_supplier(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_partkey"))
    return n.withColumn("rank", rank).where("rank <= 8")


@query("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def j18_nested_dimensions(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    # orders are counted by customer before the join, so only counts are joined
    per = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return rows.join(per, "c_custkey", "left").groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"))


_EDGES = """WITH a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber >= 3),
s AS (SELECT CASE WHEN a.src IS NOT NULL AND b.src IS NOT NULL THEN 'shared' WHEN a.src IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b USING (src, dst)) """


def _sides(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return joins.edge_overlap(e.where("l_linenumber <= 4"), e.where("l_linenumber >= 3"), ["src", "dst"])


@query(_EDGES + "SELECT side, count(*) AS edges FROM s GROUP BY 1")
def j20_edge_sides(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy("side").agg(F.count("*").alias("edges"))


@query(_EDGES + """SELECT count(*) FILTER (side = 'shared') AS shared, count(*) FILTER (side = 'left') AS left_only, count(*) FILTER (side = 'right') AS right_only,
  round(count(*) FILTER (side = 'shared') / count(*) FILTER (side <> 'right'), 8) AS precision, round(count(*) FILTER (side = 'shared') / count(*) FILTER (side <> 'left'), 8) AS recall FROM s""")
def a36_edge_precision(spark, sf_dir):
    return evals.precision_recall(_sides(spark, sf_dir)).withColumns({c: F.round(c, 8) for c in ("precision", "recall")})


@query("""SELECT o_orderpriority AS arm, count(*) AS attempts, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 8) AS success_rate, max(o_totalprice) AS max_duration,
  CAST(sum(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END) AS BIGINT) AS tokens, count(*) FILTER (o_orderkey % 4 = 0) AS tokens_missing FROM orders GROUP BY 1""")
def a31_arm_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("ok"), "o_totalprice", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("tokens")
    )
    return evals.arm_summary(o, "arm", "ok", "o_totalprice", "tokens").withColumn("success_rate", F.round("success_rate", 8))


@query("""WITH p AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS x, max(o_totalprice) FILTER (o_orderstatus = 'O') AS y FROM orders GROUP BY 1)
SELECT count(*) AS pairs, round(median(y - x), 6) AS median_difference, round(median(y / x), 6) AS median_ratio FROM p WHERE x IS NOT NULL AND y IS NOT NULL""")
def a33_paired_medians(spark, sf_dir):
    out = evals.paired_medians(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F", "O", "o_totalprice")
    return out.withColumns({c: F.round(c, 6) for c in ("median_difference", "median_ratio")})


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS category, p_brand AS display, count(DISTINCT p_name) AS identities, count(*) AS files FROM part GROUP BY 1, 2""")
def a10_external_groups(spark, sf_dir):
    category = F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd")
    return table(spark, sf_dir, "part").groupBy(category.alias("category"), F.col("p_brand").alias("display")).agg(F.countDistinct("p_name").alias("identities"), F.count("*").alias("files"))


@query("""SELECT p_brand, list_aggregate(list_sort(list(DISTINCT p_name))[1:6], 'string_agg', ',') AS names, count(*) AS files FROM part GROUP BY 1""")
def a44_panorama(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.slice(F.sort_array(F.collect_set("p_name")), 1, 6), ",").alias("names"), F.count("*").alias("files"))


@query("""SELECT l_suppkey, substr(sha256(string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR))), 1, 16) AS fingerprint FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1""")
def a41_fingerprints(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))), ";").alias("e"))
    return edges.select("l_suppkey", short_hash(F.col("e")).alias("fingerprint"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def a47_point_frequency(spark, sf_dir):
    return keyed_top(table(spark, sf_dir, "lineitem"), ["l_partkey"], 20)


@query("""SELECT CAST(o_custkey AS INTEGER) AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT CAST(o_custkey AS INTEGER) FROM orders WHERE o_orderstatus = 'O'""")
def u02_intersection(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("int").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS i FROM part) SELECT p_partkey FROM r WHERE i <= 20 OR (i - 21) % (SELECT greatest(1, (count(*) - 20) // 20) FROM part) = 0""")
def w11_systematic_sample(spark, sf_dir):
    """The top 20 and every k-th of the rest. Ranks over all rows come from sorted partitions' counts."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    i, step = F.col("__i"), F.greatest(F.lit(1), F.floor((F.col("__n") - 20) / 20))
    return indexed(part, [], F.desc("p_retailprice"), F.col("p_partkey")).where((i < 20) | ((i - 20) % step == 0)).select("p_partkey")
