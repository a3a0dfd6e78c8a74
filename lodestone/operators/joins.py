"""Joins by priority, longest prefix, interval and suffix, as equi joins plus a pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_match(candidates: DataFrame, keys: list[str], *order) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return candidates.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def longest_prefix_join(left: DataFrame, name: str, right: DataFrame, prefix: str, separator: str = ".") -> DataFrame:
    """Each left row with the right row whose `prefix` is the longest run of leading
    segments of `name`; rows without one keep nulls. Prefixes are exploded, so the
    join is by equality and shuffles or broadcasts like any other."""
    parts = F.split(F.col(name), "\\" + separator)
    rows = left.withColumn("__row", F.monotonically_increasing_id())
    every = rows.select(
        "__row", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), separator).alias("p")))).alias("x")
    )
    met = every.join(right.withColumnRenamed(prefix, "__prefix"), F.col("x.p") == F.col("__prefix"))
    best = best_match(met, ["__row"], F.desc("x.n")).drop("x").withColumnRenamed("__prefix", prefix)
    return rows.join(best, "__row", "left").drop("__row")


def containing_interval(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, cell: int = 64) -> DataFrame:
    """Each point with the smallest span that contains it, ties to the later start.
    A span lies in one or two cells of its own size, a power of two times `cell`, and a
    point looks into one cell of each size that there is: an equi join, in which long
    spans are no more rows than short ones."""
    size = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start) + 1) / cell))).cast("int")
    width = lambda level: F.lit(cell) * F.pow(F.lit(2.0), level)
    place = lambda x, level: F.floor(x / width(level))
    leveled = spans.withColumn("__level", size)
    level = F.col("__level")
    dealt = leveled.withColumn("__cell", F.explode(F.array_distinct(F.array(place(F.col(start), level), place(F.col(end), level)))))
    # at most one number for each power of two
    sizes = sorted(r[0] for r in leveled.select("__level").distinct().collect()) or [0]
    # points in one place have one answer; what holds a point is reduced to one row where it is met
    places = points.select(*keys, at).distinct()
    asked = places.select(*keys, at, F.explode(F.array(*map(F.lit, sizes))).alias("__level")).withColumn("__cell", place(F.col(at), level))
    met = asked.join(dealt, [*keys, "__level", "__cell"]).where(F.col(at).between(F.col(start), F.col(end)))
    more = [c for c in spans.columns if c not in keys]
    best = met.groupBy(*keys, at).agg(F.min_by(F.struct(*more), F.struct(F.col(end) - F.col(start), -F.col(start))).alias("__best"))
    return points.join(best, [*keys, at], "left").select(*points.columns, *[F.col(f"__best.{c}").alias(c) for c in more])


def suffix_join(paths: DataFrame, path: str, specs: DataFrame, spec: str) -> DataFrame:
    """Specs with all paths that end in them at a segment border."""
    parts = F.split(F.col(path), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))
    return specs.join(paths.withColumn("__tail", F.explode(tails)), F.col(spec) == F.col("__tail")).drop("__tail")


def edge_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two edge sets side by side: `side` is shared, left or right."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), "shared").when(F.col("__l").isNotNull(), "left").otherwise("right")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("side"))
