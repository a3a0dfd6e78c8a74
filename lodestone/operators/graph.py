"""Fixpoints and neighbourhoods over edge tables (src, dst)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the cluster names. Where it names none, a
    folder of our own will do only if all runs in this one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): all nodes reached from each seed along edges, the seed included.
    The first hop is the edges out of seeds themselves: they are distinct, and only a loop leads back to what
    is seen. Then the frontier alone is joined each round; the loop ends when no edge leads on from it."""
    edges = settle(edges.select("src", "dst").distinct())
    # they grow with the edges: never sent through the driver
    sources = settle(edges.where("src IS NOT NULL").select("src").distinct()).hint("merge")
    seen = settle(seeds.select(F.col("node").alias("seed"), "node").distinct())
    hop = edges.where(F.col("src").isNotNull() & ~F.col("src").eqNullSafe(F.col("dst"))).select(F.col("src").alias("seed"), F.col("dst").alias("node"))
    if sources.join(seen, sources.src == seen.node, "left_anti").isEmpty():  # every edge starts at a seed
        frontier = hop
    else:
        frontier = settle(hop.join(seen.select("seed"), "seed", "left_semi"))
    seen = settle(seen.unionByName(frontier))
    while not frontier.select("node").distinct().join(sources, F.col("node") == sources.src, "left_semi").isEmpty():
        step = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(seen, ["seed", "node"], "left_anti"))
        seen = settle(seen.unionByName(frontier))
    return seen


def impact_radius(imports: DataFrame, calls: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what depends on the changed nodes, seeds included, over reversed
    import and cross-file call edges, and every reversed edge out of a node met,
    repeated calls repeated."""
    back = imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("import").alias("kind")).unionByName(
        calls.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("call").alias("kind"))
    )
    one = changed.select("node").distinct().withColumn("src", F.lit("*")).select("src", F.col("node").alias("dst"))
    start = changed.sparkSession.createDataFrame([("*",)], "node string")
    nodes = reachable(back.select("src", "dst").unionByName(one), start).where("node <> '*'").select("node")
    return nodes, back.join(nodes, back.src == nodes.node, "left_semi")


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, direction, hops): one and two hops in and out, nearest first and without the seeds."""
    out = None
    for direction, a, b in (("out", "src", "dst"), ("in", "dst", "src")):
        step = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
        one = seeds.join(step, "node").select(F.col("next").alias("node")).distinct().join(seeds, "node", "left_anti")
        two = one.join(step, "node").select(F.col("next").alias("node")).distinct().join(seeds, "node", "left_anti").join(one, "node", "left_anti")
        both = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2))).withColumn("direction", F.lit(direction))
        out = both if out is None else out.unionByName(both)
    return out.select("node", "direction", "hops")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("node"))
    return nodes.join(ends, "node", "left_anti")


def resolve_chain(pointers: DataFrame) -> DataFrame:
    """(id, target): each id followed through `next` to where the chain ends, by
    pointer doubling. Ids on a cycle end at the smallest id of the cycle."""
    links = settle(pointers.where("next IS NOT NULL").select("id", "next", F.least("id", "next").alias("low")))
    before = -1.0
    for _ in range(64):
        hop = links.select(F.col("id").alias("next"), F.col("next").alias("further"), F.col("low").alias("low2"))
        links = settle(
            links.join(hop, "next", "left").select("id", F.coalesce("further", "next").alias("next"), F.least("low", "low2").alias("low"))
        )
        now = links.agg(F.count_if(F.col("next") == F.col("low")), F.sum(F.xxhash64("id", "next") % 1_000_003)).first()
        if now == before:
            break
        before = now
    # a target that still points on lies on a cycle
    on_cycle = pointers.where("next IS NOT NULL").select(F.col("id").alias("t"), F.lit(True).alias("cyclic"))
    ends = links.join(on_cycle, links.next == F.col("t"), "left").select(
        "id", F.when(F.col("cyclic"), F.col("low")).otherwise(F.col("next")).alias("target")
    )
    rest = pointers.where("next IS NULL").select("id", F.col("id").alias("target"))
    return ends.unionByName(rest)
