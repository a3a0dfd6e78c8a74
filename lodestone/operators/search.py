"""Lexical search and BM25 over a corpus table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import token_hits
from lodestone.operators.graph import settle

#: Terms of text whose counts a partition holds, and rows of (query, term) that may be broadcast.
TERMS_A_PART = 1 << 19
BROADCAST_ROWS = 500_000


def face_scores(corpus: DataFrame, tokens: list[str], faces: dict[str, int], test_cap: Column | None = None) -> DataFrame:
    """`score`: for each token the weights of the faces that it hits, summed; held to 1 where test_cap holds."""
    score = F.lit(0)
    for t in tokens:
        for face, weight in faces.items():
            score = score + F.when(token_hits(F.lit(t), F.coalesce(F.col(face), F.lit(""))), weight).otherwise(0)
    if test_cap is not None:
        score = F.when(test_cap, F.least(score, F.lit(1))).otherwise(score)
    return corpus.withColumn("score", score)


def ranked(scored: DataFrame, key: str, limit: int = 10) -> DataFrame:
    return scored.where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def exploded_terms(corpus: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, length): a row for each term with its document's length. The length is
    bound inside the generator, so the array is built once a document, not once a row."""
    sized = F.flatten(F.transform(F.array(terms), lambda w: F.transform(w, lambda t: F.struct(t.alias("term"), F.size(w).alias("length")))))
    return corpus.select(key, F.explode(sized).alias("t")).select(key, "t.term", "t.length")


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, terms) -> (key, length, term, tf): each term of a document once, with its count."""
    for batch in batches:
        lists = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not lengths.sum():
            continue
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lengths)), lengths)
        width = len(coded.dictionary)
        met, tf = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        row, term = met // width, met % width
        columns = [batch.column(0).take(pa.array(row)), pa.array(lengths[row]), coded.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "length", "term", "tf"])


def bm25(corpus: DataFrame, key: str, terms: Column, queries: DataFrame, query_key: str, query_terms: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, document, score) of all pairs that share a term. Terms are counted where the
    document is read; counts of the queries' terms are dealt by document, TERMS_A_PART terms of text to a
    partition, and stay there: pairs are summed, and may be ranked, without being shuffled. Rows
    of one key with as many terms count as one document."""
    size = corpus.select(F.size(terms).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    docs, mean = size["docs"], size["mean"] or 1.0
    asked = settle(queries.select(query_key, F.explode(F.array_distinct(query_terms)).alias("term")).distinct())
    # the queries' own size decides whether they are broadcast
    near = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda df: df
    kind = corpus.schema[key].dataType.simpleString()
    counted = corpus.select(F.col(key).alias("key"), terms.alias("terms")).mapInArrow(_term_counts, f"key {kind}, length long, term string, tf long")
    found = settle(counted.join(near(asked.select("term").distinct()), "term", "left_semi"))
    parts = max(corpus.sparkSession.sparkContext.defaultParallelism, math.ceil(docs * mean / TERMS_A_PART))
    tf = found.repartition(parts, "key").groupBy("key", "length", "term").agg(F.sum("tf").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select(query_key, "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    return tf.withColumnRenamed("key", key).join(near(weighed), "term").groupBy(query_key, key).agg(F.sum(part).alias("score"))


def gated_tokens(df: DataFrame, documents: int, share: float = 0.12, least: int = 3) -> DataFrame:
    """Tokens (token, df) rare enough to search by."""
    return df.where(F.col("df") <= max(least, int(share * documents)))


def fold_band(position: Column, total: Column, head: int = 2, tail: int = 6) -> Column:
    """Which part of a conversation a turn is in when its middle is folded."""
    return F.when(position <= head, "head").when(position > total - tail, "tail").otherwise("folded")
