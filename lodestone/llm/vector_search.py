"""Approximate nearest neighbours through 2-stable random projections.

Unit vectors are projected onto M Gaussian directions. Over the projected points
the splits of a kd-tree, fitted on a bounded sample, cut space into cells; each
cell's rows, in pieces of CELL_ROWS at most, are indexed by a kd-tree of their
own. The squared projected distance of two points over their true one follows a
chi-square distribution with M degrees, so with the k-th best true distance d a
point nearer than d lies within d * sqrt(chi2inv(SURE)) of the query in
projection with chance SURE. Neighbours are taken in order of projected distance
and verified on the original vectors until that test says stop.

First each query searches one piece of its own cell, which gives a first d; then
it visits the cells that its projected ball meets, and the best of all are
merged. The splits are fitted on a sample of SAMPLE_ROWS points or SAMPLE_PER_CELL
for each cell, of SAMPLE_MOST at most; every vector is indexed. Beyond that number
cells hold more pieces each, and all of them are searched.

Equal vectors are searched and answered once: the k + 1 copies with the smallest
ids stand for all, as no other copy can be among any query's k nearest, and the
answer of a vector is handed to each of its queries, less the query itself.

Ties go to the smaller vec_id; copies of one vector have equal projected
distances up to rounding, for which the test leaves a margin.

Defined cases: vectors that are null, zero, or hold null or non-finite parts
take no part, nor do rows of another length than the most common one (cosine is
not defined between lengths) or with a null vec_id; repeated rows of a vec_id
count once, with the smallest of their vectors; if there are fewer candidates
than k, all are returned; an empty table gives no rows; columns other than vec_id
and embedding are not read. Equal vectors are told by two 64-bit hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_or_shuffled, table

DIRECTIONS = 8  # even, for the closed form of the chi-square distribution
SURE = 0.97
SAMPLE_ROWS = 20_000
SAMPLE_PER_CELL = 16
SAMPLE_MOST = 1 << 20  # points of DIRECTIONS numbers on the driver: 64 MB
CELL_ROWS = 4096
LEAF_ROWS = 512
MARGIN = 1e-6


def chi2_quantile(p: float, m: int = DIRECTIONS) -> float:
    """The p quantile of chi-square with an even number m of degrees."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def directions(dim: int, m: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(10).standard_normal((dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    # summed row by row, so that equal vectors give equal bits wherever they stand
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def project(units: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.stack([(units * b).sum(axis=1) for b in basis.T], axis=1)


def splits(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """The inner nodes of a kd-tree with a power of two of cells, level by level: (axis, value)."""
    groups, nodes = [points], []
    while len(groups) < cells:
        halves = []
        for g in groups:
            axis = int(g.var(axis=0).argmax()) if len(g) else 0
            value = float(np.median(g[:, axis])) if len(g) else 0.0
            nodes.append((axis, value))
            halves += [g[g[:, axis] < value], g[g[:, axis] >= value]]
        groups = halves
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    depth = (len(nodes) + 1).bit_length() - 1
    axes, values = np.array([a for a, _ in nodes] or [0]), np.array([v for _, v in nodes] or [0.0])
    for _ in range(depth):
        right = points[np.arange(len(points)), axes[at]] >= values[at]
        at = 2 * at + 1 + right
    return at - len(nodes)


def cells_met(point: np.ndarray, radius: float, nodes: list[tuple[int, float]]) -> list[int]:
    """The cells that a ball meets, by the distances to the splitting planes."""
    out, todo = [], [(0, np.zeros(len(point)))]
    while todo:
        at, gaps = todo.pop()
        if at >= len(nodes):
            out.append(at - len(nodes))
            continue
        axis, value = nodes[at]
        far = gaps.copy()
        far[axis] = max(gaps[axis], abs(point[axis] - value))
        near, other = (2 * at + 2, 2 * at + 1) if point[axis] >= value else (2 * at + 1, 2 * at + 2)
        todo.append((near, gaps))
        if (far * far).sum() <= radius * radius:
            todo.append((other, far))
    return out


class KdTree:
    """Median splits down to LEAF_ROWS; neighbours come leaf by leaf, nearest box first."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            spread = np.ptp(points[rows], axis=0)
            axis = int(spread.argmax())
            if len(rows) <= LEAF_ROWS or spread[axis] == 0:
                self.leaves.append(rows)
                continue
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            todo += [order[: len(order) // 2], order[len(order) // 2 :]]
        self.low = np.array([points[r].min(axis=0) for r in self.leaves])
        self.high = np.array([points[r].max(axis=0) for r in self.leaves])

    def nearest_first(self, q: np.ndarray):
        """(least projected distance of this and all later leaves, its rows by distance, their distances)."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        bound = np.sqrt((gap * gap).sum(axis=1))
        for leaf in np.argsort(bound, kind="stable"):
            rows = self.leaves[leaf]
            delta = self.points[rows] - q
            away = np.sqrt((delta * delta).sum(axis=1))
            order = np.argsort(away, kind="stable")
            yield bound[leaf], rows[order], away[order]


_REACH = math.sqrt(chi2_quantile(SURE))


def _limit(score: float) -> float:
    """The projected distance beyond which no better one than `score` is expected: the stopping test."""
    return math.inf if score <= -1 else _REACH * math.sqrt(max(0.0, 2 - 2 * score)) + MARGIN


def search(tree: KdTree, units: np.ndarray, ids: np.ndarray, q: np.ndarray, q_unit: np.ndarray, k: int, worst: float) -> list[tuple[float, int]]:
    """The k best (score, vec_id) of a piece; worst: a score that k vectors are known to reach."""
    best_scores, best_ids = np.empty(0), np.empty(0, np.int64)
    limit = _limit(worst)
    for bound, rows, away in tree.nearest_first(q):
        if bound > limit:
            break
        rows = rows[: np.searchsorted(away, limit, side="right")]
        scores = (units[rows] * q_unit).sum(axis=1)
        if len(best_scores) == k:
            rows, scores = rows[scores >= best_scores[-1]], scores[scores >= best_scores[-1]]
        if not len(rows):
            continue
        scores, found = np.r_[best_scores, scores], np.r_[best_ids, ids[rows]]
        if len(scores) > 4 * k:  # all that reach the k-th score, ties too
            near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, found = scores[near], found[near]
        order = np.lexsort((found, -scores))[:k]
        best_scores, best_ids = scores[order], found[order]
        if len(order) == k:
            limit = min(limit, _limit(best_scores[-1]))
    return list(zip(best_scores.tolist(), best_ids.tolist()))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 1))


def _searched(k: int):
    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("vec_id", kind="stable")
            vectors, points = _matrix(rows["embedding"]), _matrix(rows["point"])
            units, ids = unit(vectors), rows["vec_id"].to_numpy()
            tree = KdTree(points)
            for q_id, vector, point, worst in zip(asked["query_id"], asked["embedding"], asked["point"], asked["worst"]):
                q_unit = unit(np.asarray(vector, np.float64)[None, :])[0]
                for score, vec in search(tree, units, ids, np.asarray(point), q_unit, k, worst):
                    out.append((q_id, vec, score))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: (vec_id, embedding array<double>)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    rows = rows.where(F.exists("embedding", lambda x: x != 0))
    return rows


def _hashes() -> list[Column]:
    return [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]


def once(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each vec_id, and (vec_id, h1, h2), hashes of the vector. Where no id is repeated, only these are shuffled."""
    keyed = cut(rows.select("vec_id", *_hashes()))
    again = cut(keyed.groupBy("vec_id").count().where("count > 1").select("vec_id"))
    n = again.count()
    if not n:
        return rows, keyed
    again = small_or_shuffled(again, n)
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = rows.join(again, "vec_id", "left_anti").unionByName(one)
    return rows, cut(rows.select("vec_id", *_hashes()))


def nearest(vectors: DataFrame, is_query, k: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where is_query holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = lengths[0]["n"], lengths[0]["count"]
    rows, keyed = once(rows.where(F.size("embedding") == dim))
    basis = directions(dim)
    cells = 1 << max(0, math.ceil(math.log2(total / cell_rows)))
    wanted = min(SAMPLE_MOST, max(SAMPLE_ROWS, SAMPLE_PER_CELL * cells))

    def projected(frames):
        for f in frames:
            yield pd.DataFrame({"point": list(project(unit(_matrix(f["embedding"])), basis))})

    bound = min(1.0, wanted / total) * 2.0**64 - 2.0**63
    sample = rows.where(F.xxhash64("vec_id") <= F.lit(bound)).select("embedding").mapInPandas(projected, "point array<double>").limit(2 * wanted).toPandas()["point"]
    nodes = splits(_matrix(sample), min(cells, 1 << max(0, (max(1, len(sample)) // SAMPLE_PER_CELL).bit_length() - 1))) if len(sample) else []

    def placed(frames):
        for f in frames:
            points = project(unit(_matrix(f["embedding"])), basis) if len(f) else np.empty((0, DIRECTIONS))
            f = f.assign(point=list(points), cell=cell_of(points, nodes))
            yield f[["vec_id", "embedding", "point", "cell"]]

    schema = "vec_id long, embedding array<double>, point array<double>, cell long"
    # where a vector has more than k + 1 copies: the last id that may be an answer
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    first_copies = keyed.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    last = cut(first_copies.where(F.col("nth") == k + 1).select("h1", "h2", F.col("vec_id").alias("last")))
    index = rows.mapInPandas(placed, schema).select("*", *_hashes()).join(small_or_shuffled(last, last.count()), ["h1", "h2"], "left").where(F.col("last").isNull() | (F.col("vec_id") <= F.col("last"))).drop("last")
    # pieces of a cell: as many as its rows need, dealt by hash
    index = cut(index)
    sizes = index.groupBy("cell").agg(F.count("*").alias("rows")).select("cell", F.expr(f"CAST(ceil(rows / {cell_rows}) AS INT)").alias("pieces"))
    pieces = cut(sizes)
    pieces = small_or_shuffled(pieces, pieces.count())
    piece = F.pmod(F.xxhash64("vec_id"), F.coalesce("pieces", F.lit(1))).cast("int")
    index = index.join(pieces, "cell").withColumn("piece", piece).drop("pieces", "h1", "h2")
    asked = keyed.where(is_query)
    leads = cut(asked.groupBy("h1", "h2").agg(F.min("vec_id").alias("query_id")))
    found = rows.join(small_or_shuffled(leads.select(F.col("query_id").alias("vec_id")), leads.count()), "vec_id", "left_semi")
    queries = cut(found.mapInPandas(placed, schema).join(pieces, "cell", "left").withColumn("piece", piece).drop("pieces").withColumnRenamed("vec_id", "query_id"))
    kind = "query_id long, vec_id long, score double"
    n = k + 1  # a query's own vector is among its nearest

    def visited(to: DataFrame) -> DataFrame:
        return index.groupBy("cell", "piece").cogroup(to.groupBy("cell", "piece")).applyInPandas(_searched(n), kind)

    first = visited(queries.withColumn("worst", F.lit(-2.0)))
    reached = cut(_best(first, n).groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n")))
    known = queries.join(reached, "query_id", "left").withColumn("worst", F.when(F.col("n") == n, F.col("worst")).otherwise(F.lit(-2.0)))

    def routed(frames):
        for f in frames:
            met = [
                cells_met(np.asarray(p), _limit(w), nodes)
                for p, w in zip(f["point"], f["worst"])
            ]
            yield f.assign(cell=[np.array(m, np.int64) for m in met])[["query_id", "embedding", "point", "worst", "cell"]]

    to = known.select("query_id", "embedding", "point", "worst").mapInPandas(
        routed, "query_id long, embedding array<double>, point array<double>, worst double, cell array<long>"
    )
    visits = to.withColumn("cell", F.explode("cell")).join(pieces, "cell").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    )
    best = _best(visited(visits.drop("pieces")), n).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best"))
    # a vector's answer for each of its queries
    answers = cut(leads.join(best, "query_id").drop("query_id"))
    handed = asked.withColumnRenamed("vec_id", "query_id").join(small_or_shuffled(answers, answers.count(), 100_000), ["h1", "h2"])
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return handed.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
