"""Registered queries over the driver tables and their SQL twins.

Operators are bound to the tables like this: `events` is the journal (type =
event_type, session = user_id, payload = props and value), `documents` and
`conversations` are the text corpus and the chats, `pages` the routes, `part` the
files, `lineitem` and `orders` the edges, `labels` the gold judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from lodestone.plans import chats, code, corpus, door, exam, flow, funnels, graphs, histories, javatree, journal, learning, modules, rollups, rules, state, tables  # noqa: E402, F401
