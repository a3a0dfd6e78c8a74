"""Exam landings, block ranking, notes and the exercise bank, as joins and ordered picks.

Points are a stated set: their patterns go to the scan of the lines as one list of literals, so every
line is read once for all of them; symbols are met by equality on their names. What a file
offers a point is then a count of terms met, per group of its probes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestone.operators.graph import settle
from lodestone.operators.ranks import indexed

MAX_NOTES = 12
# Terms that are looked for; all others only describe and never decide.
RUNNABLE = ("sym", "mod", "text")


def probe_terms(points: DataFrame) -> DataFrame:
    """(point, group, nth, kind, needle, needed): the runnable terms of probes: `;` parts groups, `&` terms of a group. `needed`
    is their number in the group; groups without one are left out."""
    groups = F.transform(F.split("probes", ";"), lambda g: F.filter(F.transform(F.split(g, "&"), lambda t: F.trim(t)), lambda t: t != ""))
    rows = points.select("point", F.posexplode(groups).alias("group", "terms")).select("point", "group", F.posexplode("terms").alias("nth", "term"))
    rows = rows.select("point", "group", "nth", F.substring_index("term", ":", 1).alias("kind"), F.regexp_extract("term", "^[^:]*:(.*)$", 1).alias("needle")).where(F.col("kind").isin(*RUNNABLE))
    return rows.withColumn("needed", F.count("*").over(Window.partitionBy("point", "group")))


def _line_hits(lines: DataFrame, needles: list[str]) -> DataFrame:
    """(needle, path, line): the first line of each file that a pattern meets, in either case; what is no pattern is taken literally."""

    def meets(needle: str) -> Column:
        try:
            re.compile(needle)
        except re.error:
            return F.contains(F.lower("content"), F.lit(needle.lower()))
        return F.col("content").rlike(f"(?i){needle}")

    found = F.array_compact(F.array(*[F.when(meets(n), F.lit(n)) for n in needles])) if needles else F.array().cast("array<string>")
    return lines.select("path", "line", F.explode(found).alias("needle")).groupBy("needle", "path").agg(F.min("line").alias("line"))


def landings(points: DataFrame, symbols: DataFrame, lines: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(point, path, line, symbol, signal): files where all runnable terms of one of a point's groups are met: points (point,
    probes), symbols (path, name, line), lines (path, line, content), signals (path, line, signal).

    `sym:A:b` is met by the first symbol A, else b, in either case; `mod:` and `text:` by the first line that
    the pattern meets. The line is that of the first term in order that has one; a point lands once on a
    line of a file, for the first of its groups. Only landings by text have a signal."""
    terms = probe_terms(points)
    names = symbols.select("path", F.lower("name").alias("low"), F.struct("line", "name").alias("at")).groupBy("path", "low").agg(F.min("at").alias("at"))
    sym = terms.where("kind = 'sym'").withColumn("want", F.split(F.lower("needle"), ":"))
    asked = sym.select("point", "group", "nth", "needed", F.posexplode(F.slice("want", 1, 2)).alias("turn", "low"))
    by_name = asked.join(names, "low").groupBy("point", "group", "nth", "needed", "path").agg(F.min_by("at", "turn").alias("at"))
    by_name = by_name.select("point", "group", "nth", "needed", "path", F.col("at.line").alias("line"), F.col("at.name").alias("symbol"), F.lit(False).alias("text"))
    texts = terms.where("kind <> 'sym'")
    # as many as the stated points name
    needles = sorted(r.needle for r in texts.select("needle").distinct().collect())
    by_line = texts.join(_line_hits(lines, needles), "needle").select("point", "group", "nth", "needed", "path", "line", F.lit(None).cast("string").alias("symbol"), F.lit(True).alias("text"))
    met = by_name.unionByName(by_line).groupBy("point", "group", "needed", "path").agg(
        F.count("*").alias("n"), F.min_by(F.struct("line", "text"), F.when(F.col("line").isNotNull(), F.col("nth"))).alias("first"), F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("nth"))).alias("symbol")
    ).where("n = needed")
    one = met.select("point", "group", "path", F.col("first.line").alias("line"), F.col("first.text").alias("text"), "symbol").groupBy("point", "path", "line").agg(F.min_by(F.struct("text", "symbol"), "group").alias("b"))
    out = one.select("point", "path", "line", F.col("b.symbol").alias("symbol"), F.coalesce("b.text", F.lit(False)).alias("text"))
    if signals is None:
        return out.drop("text").withColumn("signal", F.lit(0))
    hit = signals.select("path", "line", F.col("signal").alias("s"))
    return out.join(hit, ["path", "line"], "left").select("point", "path", "line", "symbol", F.when(F.col("text"), F.coalesce("s", F.lit(0))).otherwise(0).alias("signal"))


def judge(theme: str, concepts: dict[str, list[str]], points: DataFrame, tiers: DataFrame, symbols: DataFrame, lines: DataFrame, signals: DataFrame | None = None, shown: int = 20) -> tuple[int, DataFrame]:
    """(level, landings) of a theme: 1 if enabled points of its concepts land (points: point, concept, probes; tiers: point, tier), else 2 if
    the concepts' own words do, else 0 with up to six suggestions (concept) instead of landings. The best by signal come first."""
    needle = theme.strip().lower()
    words = {c: [c, *w] for c, w in concepts.items()}
    exact = [c for c, w in words.items() if needle in (x.lower() for x in w)]
    named = [*exact, *(c for c, w in words.items() if c not in exact and any(len(x) >= 3 and x.lower() in needle for x in w))] if needle else []
    enabled = points.join(tiers.where("tier = 'enabled'").select("point"), "point", "left_semi")
    best = lambda df: df.orderBy(F.desc("signal"), "path", "line", "point").limit(shown)
    found = landings(enabled.where(F.col("concept").isin(*named)).select("point", "probes").distinct(), symbols, lines, signals) if named else None
    if found is not None and not found.isEmpty():
        return 1, best(found)
    own = [(f"kw:{w}", f"sym:{w}; text:{w}") for c in named for w in dict.fromkeys(words[c]) if re.fullmatch(r"[A-Za-z0-9_.-]+", w)]
    if own:
        found = landings(points.sparkSession.createDataFrame(own, "point string, probes string").distinct(), symbols, lines, signals)
        if not found.isEmpty():
            return 2, best(found)
    return 0, enabled.groupBy("concept").agg(F.min("point").alias("first")).orderBy("first", "concept").limit(6).select("concept")


def _held(clues: list[str]):
    """Rows whose last column is a text -> those that hold any of the clues, with the clues that they hold instead.
    Each stretch as long as a clue is looked up once, however many clues there are."""
    by_length = {n: {c for c in clues if len(c) == n} for n in {len(c) for c in clues}}

    def met(x: str) -> list[str]:
        return [c for n, known in by_length.items() for c in known.intersection(x[at : at + n] for at in range(len(x) - n + 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pa.array([met(x) if x is not None else [] for x in batch.columns[-1].to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], held], names=batch.schema.names).filter(pc.greater(pc.list_value_length(held), 0))

    return run


def block_ranks(blocks: DataFrame, clues: DataFrame, least: int = 2) -> DataFrame:
    """(path, start, matched, score): declaration blocks (path, start, declared, body) by the clues (clue) that they hold: each
    weighs the inverse of the number of blocks that hold it, and up to three declarations a hundredth each."""
    # as many as the clues of one task
    asked = [r.clue for r in clues.select("clue").distinct().orderBy("clue").collect()]
    # bodies are lowered and read once, for the counts and for the scores
    known = blocks.where(F.col("declared") >= least).select("path", "start", "declared", F.lower("body").alias("held"))
    kind = StructType([*known.schema.fields[:3], StructField("held", ArrayType(StringType()))])
    found = settle(known.mapInArrow(_held([c for c in asked if c is not None]), kind))
    rows = found.select("path", "start", "declared", F.explode("held").alias("clue"))
    df = rows.groupBy("clue").agg(F.count("*").alias("df"))
    scored = rows.join(F.broadcast(df), "clue").groupBy("path", "start", "declared").agg(F.count("*").alias("matched"), F.sum(1 / F.col("df")).alias("s"))
    return scored.select("path", "start", "matched", (F.col("s") + F.least("declared", F.lit(3)) / 100).alias("score"))


def merge_notes(existing: DataFrame, incoming: DataFrame, most: int = MAX_NOTES) -> DataFrame:
    """The notes of each file that gets any: existing (file, hash, ord, point, line, level), incoming alike, whose hash is the file's
    now. Notes of another hash are void. Of a point on a line the surer stays: level 1 before 2 before 0, the earlier of equals. Beyond `most` a
    file keeps the last note of each point, the last `most` of them in the order in which points came."""
    now = incoming.groupBy("file").agg(F.max("hash").alias("now"))
    old = existing.join(now, "file").where(F.col("hash") == F.col("now")).drop("now").withColumn("side", F.lit(0))
    rows = old.unionByName(incoming.withColumn("side", F.lit(1)))
    at = F.struct("side", "ord")
    surer = F.when(F.col("level") == 0, 1 << 30).otherwise(F.col("level"))
    best = Window.partitionBy("file", "point", "line")
    kept = rows.withColumns({"nth": F.row_number().over(best.orderBy(surer, at)), "came": F.min(at).over(best)}).where("nth = 1").drop("nth")
    per = Window.partitionBy("file")
    kept = kept.withColumns({"n": F.count("*").over(per), "point_came": F.min("came").over(Window.partitionBy("file", "point")), "last": F.row_number().over(Window.partitionBy("file", "point").orderBy(F.desc("came")))})
    thin = kept.where((F.col("n") <= most) | (F.col("last") == 1))
    place = F.row_number().over(per.orderBy(F.desc(F.when(F.col("n") <= most, F.col("came")).otherwise(F.col("point_came")))))
    return thin.withColumn("place", place).where((F.col("n") <= most) | (F.col("place") <= most)).select("file", "hash", "point", "line", "level")


def bank(stored: DataFrame, schedule: DataFrame) -> DataFrame:
    """(exercise, created, due, place): the newest stored row of each exercise (exercise, created, at), those with a review (exercise, due)
    first, the earliest due first, then the others, the newest first."""
    newest = stored.groupBy("exercise").agg(F.max_by("created", F.struct("at", "created")).alias("created"))
    due = schedule.groupBy("exercise").agg(F.max("due").alias("due"))
    rows = newest.join(due, "exercise", "left").withColumn("fresh", F.when(F.col("due").isNull(), F.col("created")))
    ranked = indexed(rows, [], F.col("due").asc_nulls_last(), F.col("fresh").desc(), F.col("exercise"))
    return ranked.select("exercise", "created", "due", (F.col("__i") + 1).alias("place"))
