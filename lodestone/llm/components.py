"""Connected components of an undirected edge table, in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task connects by itself, before anything is shuffled: 16 MB.
LOAD_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of edges, and for each the smallest id that these edges connect it with."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while True:
        high, low = np.maximum(root[x], root[y]), np.minimum(root[x], root[y])
        apart = high != low
        if not apart.any():
            return ids, ids[root]
        np.minimum.at(root, high[apart], low[apart])  # roots are hooked to smaller roots
        while (root[root] != root).any():
            root = root[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (id, smallest id) of what LOAD_EDGES of them connect, as edges (a, b) that connect the same."""
    load, size = [], 0

    def connected() -> pa.RecordBatch:
        ids, least = forest(*(np.concatenate(x) for x in zip(*load)))
        other = ids != least
        return pa.RecordBatch.from_arrays([pa.array(ids[other], pa.int64()), pa.array(least[other], pa.int64())], names=["a", "b"])

    for batch in (x.slice(at, LOAD_EDGES) for x in batches for at in range(0, x.num_rows, LOAD_EDGES)):
        if load and size + batch.num_rows > LOAD_EDGES:
            yield connected()
            load, size = [], 0
        load.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        size += batch.num_rows
    if load:
        yield connected()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component): for each id in edges (a, b) the smallest id that it reaches.

    Edges are read in loads of about LOAD_EDGES, as many tasks as that makes of
    their number of rows, and what a load connects becomes stars; so rounds only
    have to connect what lies in several loads. Every round takes the smallest
    label among the neighbours and then follows
    the label's own label once, so that long chains halve. Rounds end with a
    checkpoint and the driver learns whether any label changed.
    Ids joined by many edges are no problem: labels are minima, combined before
    the shuffle. An empty edge table gives an empty result. Edges are read twice, if
    their rows aren't given."""
    rows = edges.count() if rows is None else rows
    pairs = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    stars = pairs.coalesce(max(1, -(-rows // LOAD_EDGES))).mapInArrow(_stars, "a long, b long")
    both = cut(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("edge")).select("edge.*").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"id": "b", "component": "c"}), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("c").alias("c"))
        )
        hooked = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        new = cut(hooked.join(jump, "c", "left").select("id", "was", F.least("c", "further").alias("component")))
        labels = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            return labels


def connected_further(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (id, component) with more edges (a, b): only what the edges join is connected, each
    component as one node under its smallest id. Ids of edges may be new."""
    node = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"{end}_in"))
    named = edges.join(node("a"), "a", "left").join(node("b"), "b", "left")
    joined = connected_components(cut(named.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))))
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("to"))
    known = groups.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return known.unionByName(joined.join(groups.select("id"), "id", "left_anti").select("id", "component"))
