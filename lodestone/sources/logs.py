"""Readers and sinks of JSON-lines journals, CSV files and key=value files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = "id string, type string, at timestamp, repositoryId string, sessionId string, traceId string, payload map<string,string>"


#: Names in the files, and in the tables made of them.
NAMES = {"repositoryId": "repository_id", "sessionId": "session_id", "traceId": "trace_id"}


def read_journal(spark: SparkSession, paths: str | list[str], schema: str = JOURNAL) -> DataFrame:
    """Events of one or many journals; lines that don't parse are skipped. `ord` keeps the
    order within a file, `file` its name."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("timeZone", "UTC").json(paths)
    return rows.where("id IS NOT NULL").withColumnsRenamed(NAMES).withColumns({"file": F.input_file_name(), "ord": F.monotonically_increasing_id()})


def append_events(events: DataFrame, path: str, types: list[str]) -> None:
    """Appends events of the allowed types; ids and times are stamped where missing."""
    rows = events.where(F.col("type").isin(*types)).withColumnsRenamed({v: k for k, v in NAMES.items()})
    rows.withColumns({"id": F.coalesce("id", F.expr("uuid()")), "at": F.coalesce("at", F.current_timestamp())}).write.mode("append").json(path)


def write_rows(rows: DataFrame, path: str, append: bool) -> None:
    """A JSON-lines sink, added to or written anew."""
    rows.write.mode("append" if append else "overwrite").json(path)


LLM_CALLS = (
    "at timestamp, scene string, tier string, provider string, model string, traceId string, ok boolean, error string, ms long, attempts int, inputTokens long, outputTokens long, "
    "cacheHitTokens long, outbound struct<chars: long, hash: string>"
)


def read_llm_calls(spark: SparkSession, paths: str | list[str], since: str | None = None) -> DataFrame:
    """The log of model calls, from a time on; lines that don't parse are skipped."""
    rows = spark.read.schema(LLM_CALLS).option("mode", "DROPMALFORMED").option("timeZone", "UTC").json(paths).where("at IS NOT NULL")
    rows = rows.withColumnsRenamed({"traceId": "trace_id", "inputTokens": "input", "outputTokens": "output", "cacheHitTokens": "cache_hit"})
    return rows if since is None else rows.where(F.col("at") >= F.lit(since).cast("timestamp"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and naive comma split; missing cells are empty."""
    return spark.read.option("header", True).option("quote", "").csv(path).na.fill("")


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a dotenv file; the last value of a key stands."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    pattern = r"""^\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*["']?(.*?)["']?\s*$"""
    rows = lines.select("ord", F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("v")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("v", "ord").alias("value"))


def markdown_table(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """The rows of the pipe table under a heading, as an array of cells in order."""
    text = spark.read.text(path, wholetext=True)
    section = F.regexp_extract("value", rf"(?ms)^#+\s*{heading}\s*$(.*?)(?=^#|\z)", 1)
    rows = text.select(F.posexplode(F.split(section, "\n")).alias("pos", "line")).where(F.col("line").startswith("|") & ~F.col("line").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("pos", cells.alias("cells"))
