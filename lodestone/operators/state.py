"""Tables of state kept as append-only changes: key-value caches, soft deletes, checkpoints, topics, catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.tables import keep_latest


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by these columns, aggregated before the shuffle rather than ranked after it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def replaced(old: DataFrame, new: DataFrame, kinds: list[str], kind: str = "kind") -> DataFrame:
    """All rows of these kinds replaced by the new ones."""
    return old.where(~F.col(kind).isin(*kinds)).unionByName(new)


def newest_valid(rows: DataFrame, key: Column, at: list[str], scanned: int) -> DataFrame:
    """Of the newest `scanned` rows the newest of each key; rows whose key doesn't parse are skipped."""
    recent = rows.orderBy(*[F.desc(c) for c in at]).limit(scanned).withColumn("__key", key).where("__key IS NOT NULL")
    return keep_latest(recent, ["__key"], *[F.desc(c) for c in at]).withColumnRenamed("__key", "key")


def live_messages(messages: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Messages that aren't deleted, of sessions that aren't."""
    return messages.where("deleted_at IS NULL").join(sessions.where("deleted_at IS NULL").select(key), key, "left_semi")


def tail_in_order(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key, numbered in order."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    last = rows.withColumn("__back", back).where(F.col("__back") <= n)
    return last.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).drop("__back")


def checkpoint(rounds: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """The latest round of each key that doesn't wait for the user, if its input is the wanted one."""
    going = rounds.where(F.coalesce("stopped_reason", F.lit("")) != "await_user")
    return latest_by(going, keys, "round").where(wanted)


def claimed(rounds: DataFrame, claims: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(answers, left): the latest round of each claimed call, null where its prompt has changed, and
    the rounds left after all claimed ones are taken. Claims are (keys, pending, prompt)."""
    at = [*keys, "pending"]
    last = latest_by(rounds.where("pending IS NOT NULL"), at, "round")
    met = claims.withColumnRenamed("prompt", "asked").join(last, at)
    answers = met.select(*at, F.when(F.col("prompt") == F.col("asked"), F.col("round")).alias("round"))
    return answers, rounds.join(claims.select(*at).distinct(), at, "left_anti")


def settled(rounds: DataFrame, older_than: Column, kept: Column) -> DataFrame:
    """Waiting calls but the kept ones, with why they end: expired, or superseded by a new question."""
    waiting = rounds.where(F.col("pending").isNotNull() & ~F.coalesce(kept, F.lit(False)))
    return waiting.withColumn("cause", F.when(F.col("updated_at") < older_than, "expired").otherwise("new_question"))


def merge_topics(facts: DataFrame, merges: DataFrame, topic: str = "topic") -> DataFrame:
    """Facts with merged topics (src, dst) renamed."""
    return facts.join(merges.withColumnRenamed("src", topic), topic, "left").withColumn(topic, F.coalesce("dst", topic)).drop("dst")


def recency_list(added: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their last addition."""
    last = added.groupBy(key).agg(F.max(order).alias(order))
    return last


def validated(posted: DataFrame, owned: list[str], allowed: list[str], value: int = 2000, session: int = 200) -> DataFrame:
    """Posted events (type, payload map, session) with `failure`, the first rule that they break, else null."""
    long = F.exists(F.map_values(F.coalesce("payload", F.create_map().cast("map<string,string>"))), lambda v: F.length(v) > value)
    return posted.withColumn(
        "failure",
        F.when(F.col("type").isin(*owned), "engine-owned-event").when(F.col("type").isNull() | ~F.col("type").isin(*allowed), "unknown-event")
        .when(long, "payload-too-long").when(F.length("session") > session, "session-id-invalid"),
    )
