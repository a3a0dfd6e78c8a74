"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Token weights of the
cells are raked: scaled so that the sums by source meet their targets, then by
language, then by topic, over and over. A cell's rate is its raked share of the
token budget over its tokens; each of its documents is kept with probability
min(1, rate), decided by a hash of its id, and carries the weight rate /
probability, above 1 where a cell must be repeated to meet its target. The
expected weighted tokens then have the targeted marginals.

Only DataFrame operations are used. A cell table has a row per combination that
occurs; it is broadcast to the documents if it has few rows, else joined by a
shuffle.

The topic is a rule over the text's form (see `topic`), as documents have no
topic column; any other Column may be given. Without explicit targets each
margin's shares are tempered: their square roots, normalised.

Defined cases: null source, lang or topic is a category of its own, named
`none`; null and empty texts have no tokens and are never kept, as no rate is
defined for them; a null doc_id is hashed as empty text; repeated rows share
their decision; targets for categories that don't occur are left out and the
others normalised; categories without a target get none of the weight; an empty
table gives no rows; columns with other names are carried along by `mix`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_or_shuffled, table

BUDGET = 0.5  # of all tokens
ROUNDS = 10
SEED = "mix-1"
TEMPER = 0.5
BYTES_PER_TOKEN = 4
MARGINS = ("__source", "__lang", "__topic")


def n_tokens(text: Column) -> Column:
    """UTF-8 bytes over four, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / BYTES_PER_TOKEN), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A document's kind by its form."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! ") | text.contains("&&& ") | text.contains("$$$ "), "noise")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("longform")
    )


def _celled(docs: DataFrame, topic_of: Column) -> DataFrame:
    none = F.lit("none")
    return docs.withColumns(
        {
            "__source": F.coalesce(F.col("source").cast("string"), none),
            "__lang": F.coalesce(F.col("lang").cast("string"), none),
            "__topic": F.coalesce(topic_of, none),
            "__tokens": n_tokens(F.col("text")),
        }
    )


def _targets(cells: DataFrame, margin: str, given: dict[str, float] | None, temper: float) -> Column:
    """The share of a cell's category, as a column of cells: given, or tempered by its tokens."""
    if given is None:
        return F.pow(F.sum("__tokens").over(Window.partitionBy(margin)).cast("double"), F.lit(temper))
    pairs = [x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(margin)], F.lit(0.0)) if pairs else F.lit(0.0)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, temper: float = TEMPER) -> DataFrame:
    """cells (margins, _tokens) -> cells with `share`: raked shares, 1 in all."""
    targets = targets or {}
    out = cells
    for m in MARGINS:
        goal = _targets(out, m, targets.get(m.strip("_")), temper)
        out = out.withColumn(f"goal{m}", goal)
        # one row of each category counts towards the margin's total
        first = F.row_number().over(Window.partitionBy(m).orderBy(*MARGINS)) == 1
        out = out.withColumn(f"once{m}", F.when(first, F.col(f"goal{m}")).otherwise(0.0))
    whole = Window.partitionBy(F.lit(0))  # all cells
    for m in MARGINS:
        out = out.withColumn(f"goal{m}", F.col(f"goal{m}") / F.sum(f"once{m}").over(whole))
    share = F.col("__tokens") / F.sum("__tokens").over(whole)
    out = cut(out.select(*MARGINS, "__tokens", *[f"goal{m}" for m in MARGINS], share.alias("share")))
    for _ in range(rounds):
        for m in MARGINS:
            held = F.sum("share").over(Window.partitionBy(m))
            out = out.withColumn("share", F.when(held > 0, F.col("share") * F.col(f"goal{m}") / held).otherwise(0.0))
        out = cut(out)
    return out.select(*MARGINS, "__tokens", "share")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 32 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    topic_of: Column | None = None,
    seed: str = SEED,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The sampled documents, with their columns, `topic`, `n_tokens`, `prob` and `weight`."""
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("topic", "n_tokens", "prob", "weight")])
    celled = _celled(docs, topic(F.col("text")) if topic_of is None else topic_of)
    cells = cut(celled.where("__tokens > 0").groupBy(*MARGINS).agg(F.sum("__tokens").alias("__tokens")))
    raked = rake(cells, targets, rounds)
    total = F.sum("__tokens").over(Window.partitionBy(F.lit(0)))  # of cells, not documents
    rates = cut(raked.select(*MARGINS, (F.lit(budget) * total * F.col("share") / F.col("__tokens")).alias("rate")))
    joined = celled.where("__tokens > 0").join(small_or_shuffled(rates, rates.count(), 100_000), list(MARGINS))
    prob = F.least(F.lit(1.0), F.col("rate"))
    return (
        joined.where(uniform(F.col("doc_id"), seed) < prob)
        .withColumns({"topic": F.col("__topic"), "n_tokens": F.col("__tokens"), "prob": prob, "weight": F.col("rate") / prob})
        .drop(*MARGINS, "__tokens", "rate")
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6).alias("prob"), F.round("weight", 6).alias("weight")
    )


def mixing_sql(docs: str = "documents", columns: str = "doc_id, source, lang, _topic AS topic, _tokens AS n_tokens", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for mix() over a table or CTE; one CTE for each scaling."""
    parts = [
        f"""celled AS (SELECT *, coalesce(source, 'none') AS _source, coalesce(lang, 'none') AS _lang,
  CASE WHEN text LIKE '% | %' THEN 'table' WHEN text LIKE '%!! %' OR text LIKE '%&&& %' OR text LIKE '%$$$ %' THEN 'noise'
    WHEN length(text) < 400 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'longform' END AS _topic,
  CAST(coalesce(ceil(strlen(text) / {BYTES_PER_TOKEN}.0), 0) AS BIGINT) AS _tokens FROM {docs})""",
        "cells AS MATERIALIZED (SELECT _source, _lang, _topic, CAST(sum(_tokens) AS BIGINT) AS _tokens FROM celled WHERE _tokens > 0 GROUP BY ALL)",
    ]
    for m in ("_source", "_lang", "_topic"):
        parts.append(
            f"""goal{m} AS MATERIALIZED (SELECT {m}, pow(t, {TEMPER}) / sum(pow(t, {TEMPER})) OVER () AS goal
  FROM (SELECT {m}, CAST(sum(_tokens) AS DOUBLE) AS t FROM cells GROUP BY 1))"""
        )
    parts.append("r0 AS MATERIALIZED (SELECT *, _tokens / sum(_tokens) OVER () AS share FROM cells)")
    at = 0
    for _ in range(rounds):
        for m in ("_source", "_lang", "_topic"):
            parts.append(
                f"""r{at + 1} AS MATERIALIZED (SELECT _source, _lang, _topic, _tokens,
  CASE WHEN sum(share) OVER (PARTITION BY {m}) > 0 THEN share * goal / sum(share) OVER (PARTITION BY {m}) ELSE 0 END AS share
  FROM r{at} JOIN goal{m} USING ({m}))"""
            )
            at += 1
    parts.append(f"rates AS MATERIALIZED (SELECT _source, _lang, _topic, {BUDGET} * sum(_tokens) OVER () * share / _tokens AS rate FROM r{at})")
    return f"""WITH {', '.join(parts)}
SELECT {columns}, round(least(1.0, rate), 6) AS prob, round(rate / least(1.0, rate), 6) AS weight
FROM celled JOIN rates USING (_source, _lang, _topic)
WHERE _tokens > 0 AND CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, rate)"""


OP2_SQL = mixing_sql()
