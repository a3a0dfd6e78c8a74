"""Keyed state over streams: changes of content without no-ops, with a time limit; and an idempotent sink.

`content_changes` keeps for each key a digest of its last content, nothing else. A row whose
content is the same is no change and isn't passed on; of several rows that come within
`quiet` of one another in a batch only the last counts. A key without rows for `ttl` of event time is
reported as expired, once, and its state goes; the watermark decides when, so late rows are
ordered by their own time and rows older than the state's are dropped. State lives in the
query's checkpoint: a restart changes nothing.

`upsert_batches` writes each batch's changes once by its number, and `current` reads the last
content of each key from them, by (time, batch)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, at timestamp, change string, content string"


def _digest(content: str | None) -> str:
    return "" if content is None else hashlib.sha256(content.encode("utf-8", "replace")).hexdigest()


def _changes(ttl_ms: int, quiet: timedelta):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            digest, at = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(at, unit="ms")], "change": ["expired"], "content": [None]})
            return
        known, last = state.get if state.exists else (None, -1)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        out = []
        for k, (at, content) in enumerate(zip(rows["at"], rows["content"])):
            ms = int(at.timestamp() * 1000)
            if ms < last:
                continue  # older than what is known
            following = rows["at"].iloc[k + 1] if k + 1 < len(rows) else None
            if following is not None and following - at < quiet:
                continue  # soon replaced
            last, digest = ms, _digest(content)
            if digest != known:
                out.append((key[0], at, "new" if known is None else "changed", content))
                known = digest
        if known is not None:
            state.update((known, last))
            due = last + ttl_ms
            if due > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(due)
            else:
                state.remove()
                out.append((key[0], pd.Timestamp(last, unit="ms"), "expired", None))
        yield pd.DataFrame(out, columns=["key", "at", "change", "content"])

    return run


def content_changes(rows: DataFrame, key: str, at: str, content: str, ttl: timedelta, late: str = "10 minutes", quiet: timedelta = timedelta(0)) -> DataFrame:
    """(key, at, change, content): new, changed and expired keys of a stream; a null key is a key of its own, the empty text."""
    named = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(content).cast("string").alias("content"))
    kept = named.where("at IS NOT NULL").withWatermark("at", late)
    return kept.groupBy("key").applyInPandasWithState(_changes(int(ttl.total_seconds() * 1000), quiet), _OUT, "digest string, at long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(changes: DataFrame, path: str, checkpoint: str):
    """A started query that writes each batch's changes to a folder of its own number, so that a batch
    run twice leaves one copy. Empty batches leave nothing. It ends when all that has come is taken."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(key, at, content): the last content of each key that hasn't expired."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("batch"), F.desc("at"), F.desc(F.col("change") == "expired")))
    return rows.withColumn("rank", rank).where("rank = 1 AND change <> 'expired'").select("key", "at", "content")
