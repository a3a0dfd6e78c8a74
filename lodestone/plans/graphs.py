"""Graph queries: every order line joins its supplier to its part. Nodes are named
`supplier:KEY` and `part:KEY`, as the two tables count their keys each from 1. The
same graphs are tested by brute force in `tests/test_whole_tables.py`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.plans.registry import query, table

_SQL = """WITH RECURSIVE edges AS (SELECT DISTINCT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst FROM lineitem),
nodes AS (SELECT 'supplier:' || s_suppkey AS node FROM supplier UNION SELECT 'part:' || p_partkey FROM part UNION SELECT src FROM edges UNION SELECT dst FROM edges), """


def _node(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(_node("supplier", "l_suppkey").alias("src"), _node("part", "l_partkey").alias("dst")).distinct()


def _nodes(spark, sf_dir):
    """All suppliers and parts, ordered or not."""
    known = table(spark, sf_dir, "supplier").select(_node("supplier", "s_suppkey").alias("node")).unionByName(table(spark, sf_dir, "part").select(_node("part", "p_partkey").alias("node")))
    return known.unionByName(_edges(spark, sf_dir).select(F.explode(F.array("src", "dst")).alias("node"))).distinct()


def _impact(spark, sf_dir):
    """Order lines are imports; the tables have no calls."""
    e = _edges(spark, sf_dir)
    return G.impact_radius(e, e.limit(0), spark.createDataFrame([("part:5",)], "node string"))


@query(_SQL + """r AS (SELECT 'part:5' AS node UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.node) SELECT node FROM r""")
def g02_impact_radius(spark, sf_dir):
    """What a change of part 5 reaches; the edges are in g02_impact_edges."""
    return _impact(spark, sf_dir)[0]


@query(_SQL + """r AS (SELECT 'part:5' AS node UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.node)
SELECT DISTINCT e.dst AS src, e.src AS dst, 'import' AS kind FROM r JOIN edges e ON e.dst = r.node""")
def g02_impact_edges(spark, sf_dir):
    """Every reversed edge out of a node of g02_impact_radius."""
    return _impact(spark, sf_dir)[1]


@query(_SQL + """r AS (SELECT node AS seed, node FROM nodes UNION SELECT r.seed, e.dst FROM r JOIN edges e ON e.src = r.node)
SELECT seed, count(*) AS reached, CAST(least(5, greatest(1, count(*))) AS INTEGER) AS difficulty FROM r GROUP BY 1""")
def l09_reach_sizes(spark, sf_dir):
    """For every node; `reached` is the whole count, only the difficulty is clamped."""
    seen = G.reachable(_edges(spark, sf_dir), _nodes(spark, sf_dir))
    return seen.groupBy("seed").agg(F.count("*").alias("reached"), F.least(F.lit(5), F.greatest(F.lit(1), F.count("*"))).cast("int").alias("difficulty"))


@query(_SQL + """seeds AS (SELECT 'supplier:3' AS node UNION SELECT 'part:3'), o1 AS (SELECT DISTINCT dst AS node FROM edges JOIN seeds ON src = seeds.node WHERE dst NOT IN (SELECT node FROM seeds)), o2 AS (SELECT DISTINCT dst AS node FROM edges JOIN o1 ON src = o1.node WHERE dst NOT IN (SELECT node FROM o1)),
i1 AS (SELECT DISTINCT src AS node FROM edges JOIN seeds ON dst = seeds.node WHERE src NOT IN (SELECT node FROM seeds)), i2 AS (SELECT DISTINCT src AS node FROM edges JOIN i1 ON dst = i1.node WHERE src NOT IN (SELECT node FROM i1))
SELECT node, 'out' AS direction, 1 AS hops FROM o1 UNION ALL SELECT node, 'out', 2 FROM o2 UNION ALL SELECT node, 'in', 1 FROM i1 UNION ALL SELECT node, 'in', 2 FROM i2""")
def g05_neighbourhood(spark, sf_dir):
    """Around supplier 3 and part 3."""
    return G.neighbourhood(_edges(spark, sf_dir), spark.createDataFrame([("supplier:3",), ("part:3",)], "node string"))


@query(_SQL + "n AS (SELECT node FROM nodes) SELECT node FROM n WHERE node NOT IN (SELECT src FROM edges WHERE src <> dst UNION ALL SELECT dst FROM edges WHERE src <> dst)")
def g06_isolated(spark, sf_dir):
    return G.isolated(_nodes(spark, sf_dir), _edges(spark, sf_dir))


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey - 1 END AS next FROM customer),
r AS (SELECT id, id AS node FROM p UNION SELECT r.id, p.next FROM r JOIN p ON p.id = r.node WHERE p.next IS NOT NULL)
SELECT r.id, r.node AS target FROM r JOIN p ON p.id = r.node WHERE p.next IS NULL""")
def q25_pointer_chase(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return G.resolve_chain(c.withColumn("next", F.when(F.col("id") % 10 != 0, F.col("id") - 1)))


@query(_SQL + """x AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst) SELECT a, count(*) AS degree FROM x GROUP BY 1""")
def g04_adjacency(spark, sf_dir):
    e = _edges(spark, sf_dir).where("src <> dst")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    return both.groupBy("a").agg(F.count("*").alias("degree"))
