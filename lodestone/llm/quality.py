"""Compression classifier for text quality.

Two zstandard dictionaries are trained, one on good and one on bad labelled
text. A text is cut into blocks, and each block is compressed with either
dictionary; the difference of the two total sizes over their sum says which kind
of text it resembles. A logistic curve over this difference, fitted on labelled
texts that the dictionaries haven't seen, makes it a probability. The curve also
knows the compression ratio and the length: repetition compresses well with any
dictionary, and short texts say little.

Fitting uses at most TRAIN_DOCS labelled texts of each class, of at most
TRAIN_BYTES each, chosen by a hash of their id: a bounded sample, the same at
every size of input. A longer text teaches a stretch from anywhere in it, an id with
several rows one of its texts. Scoring reads every whole text.

Defined cases: null or empty text scores as a text of which nothing is known;
labels that are null or whose document is missing aren't used; a document
labelled differently by repeated rows counts as bad; if either class has fewer than four
labelled texts, all scores are the share of good labels, smoothed, and a pipeline's stage keeps all; an empty
documents table gives no rows; lang, source and doc_id are never scored."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_batches, held_out, map_batches, table, training_text, utf8

TRAIN_DOCS = 2000
TRAIN_BYTES = 1 << 14
BLOCK = 512
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
CUTOFF = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    prior: float


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it serves as content
        return b"".join(samples)[-DICTIONARY_BYTES:]


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _COMPRESSORS:
        if len(_COMPRESSORS) > 8:
            _COMPRESSORS.clear()
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        _COMPRESSORS[dictionary] = zstandard.ZstdCompressor(
            dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
        )
    return _COMPRESSORS[dictionary]


def sizes(text: bytes, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """(bytes, compressed with the good dictionary, with the bad one)."""
    with_good, with_bad = _compressor(good).compress, _compressor(bad).compress
    blocks = _blocks(text)
    return len(text), sum(len(with_good(b)) for b in blocks), sum(len(with_bad(b)) for b in blocks)


def _features(measured: np.ndarray) -> np.ndarray:
    n, good, bad = measured.astype(float).T
    diff = np.where(n > 0, (bad - good) / np.maximum(good + bad, 1), 0.0)
    ratio = np.where(n > 0, np.minimum(good, bad) / np.maximum(n, 1), 0.6)
    length = np.log1p(n)
    return np.stack([diff, diff**2, ratio, ratio**2, length, diff * length, ratio * length, diff * ratio], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Labels come only from rows whose document is not held out. At most train_docs texts of a class, one of
    each id, of TRAIN_BYTES at most, go to the driver. An id with both labels belongs to the lower."""
    spark = docs.sparkSession
    rows = labels.where(F.col("quality").isin(0, 1) & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shares = {r.quality: r.n for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    order = F.xxhash64(F.col("doc_id"))
    full = docs.where(F.octet_length("text") > 0).select("doc_id", "text")
    rows = rows.join(full.select("doc_id"), "doc_id", "left_semi")
    texts: dict[int, list[bytes]] = {}
    for q in (0, 1):
        few = rows.where(F.col("quality") == q).select("doc_id").orderBy(order, "doc_id").limit(train_docs)
        ids = spark.createDataFrame([(r.doc_id,) for r in few.collect()] or [(None,)], "doc_id long")
        met = full.join(F.broadcast(ids), "doc_id").select("doc_id", training_text(F.col("text"), TRAIN_BYTES).alias("text"))
        # a repeated id teaches one of its texts, chosen before anything is shuffled
        found = met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        texts[q] = [r.text.encode("utf-8", "replace") for r in sorted(found.collect(), key=lambda r: (r.doc_id * 0x9E3779B97F4A7C15 % 2**64))]
    if min(len(x) for x in texts.values()) < 4:
        return Model(b"", b"", (), (), (), prior)
    halves = {q: (x[0::2], x[1::2]) for q, x in texts.items()}
    good, bad = _dictionary(halves[1][0]), _dictionary(halves[0][0])
    measured = {q: np.array([sizes(t, good, bad) for t in h[1]]) for q, h in halves.items()}
    x = _features(np.concatenate([measured[0], measured[1]]))
    y = np.r_[np.zeros(len(measured[0])), np.ones(len(measured[1]))]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    # the sample holds either class by choice: shift the intercept to the labels' own odds
    w[0] += np.log(prior / (1 - prior)) - np.log(len(measured[1]) / len(measured[0]))
    return Model(good, bad, tuple(w), tuple(mean), tuple(scale), prior)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    x = _features(np.array([sizes(t, model.good, model.bad) for t in texts]).reshape(-1, 3))
    z = np.clip(((x - model.mean) / model.scale) @ model.weights[1:] + model.weights[0], -30, 30)
    return 1 / (1 + np.exp(-z))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": scores(model, utf8(batch.column(1)))}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that score the cutoff or more, with all their columns; all of them where no classifier could be fitted."""
    if not model.weights:
        return docs
    text = docs.columns.index("text")
    return filter_batches(docs, lambda batch: scores(model, utf8(batch.column(text))) >= cutoff)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted")
    )
