"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes with counts,
frozen after training. A byte costs what PPM (escape method C) charges: in the
longest context known, -log2 of its count over total + distinct; if unseen there,
the escape share distinct over total + distinct, and then its cost one order
lower, down to a uniform byte. The language with the shortest code is the answer.

As the statistics are frozen, the cost of each (context, byte) is computed once,
for all languages side by side. Scoring a text is then a table look-up for each
of its bytes: whole texts, in numpy.

Training uses at most TRAIN_DOCS texts per language of at most TRAIN_BYTES each,
chosen by a hash of their id; a longer text teaches a stretch from anywhere in it, and
an id with several rows one of its texts. lang, source and doc_id play no part in scoring.

Defined cases: null texts and texts without a letter are `und` with score 0; a
tie goes to the alphabetically first language; rows with a null lang aren't
learned from; without any learned language all are `und`; repeated rows are
predicted alike, each; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, map_batches, small_or_shuffled, table, training_text

ORDER = 3
TRAIN_DOCS = 400
TRAIN_BYTES = 1 << 14
#: Contexts of two and three bytes met less often than this in a language are left out of its tree.
LEAST = 2
CHUNK = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """Symbols are bytes seen in training, from 2; 0 stands for any other byte, 1 for the start of a text."""

    langs: tuple[str, ...]
    symbol: np.ndarray  # [256] byte -> symbol
    n_symbols: int
    row2: np.ndarray  # [symbols^2] two bytes -> number of that context, 0 if in no tree
    row3: np.ndarray  # [contexts of two bytes, symbols] -> number of the context of three
    cost: np.ndarray  # [row, symbol, language]: bits; rows by one byte, then by two, then by three


def _before(symbols: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The symbol `back` places before each, 1 where the text had not begun."""
    out = np.empty_like(symbols)
    out[back:] = symbols[: len(symbols) - back]
    out[:back] = 1
    ends = np.r_[starts[1:], len(symbols)]
    for k in range(back):
        at = starts + k
        out[at[at < ends]] = 1
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(lengths)][:-1]


def train(samples: dict[str, list[bytes]]) -> Model:
    langs = tuple(sorted(samples))
    joined = {x: _joined([t for t in samples[x] if t]) for x in langs}
    seen = np.unique(np.concatenate([j[0] for j in joined.values()])) if langs else np.empty(0, np.uint8)
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(2, len(seen) + 2)
    n = len(seen) + 2
    counts: dict[str, list[dict | np.ndarray]] = {}
    for lang, (text, starts) in joined.items():
        s = symbol[text]
        p = [_before(s, starts, k).astype(np.int64) for k in (1, 2, 3)]
        s = s.astype(np.int64)
        tables = [np.bincount(s, minlength=n)[None, :].astype(float)]
        tables.append(np.bincount(p[0] * n + s, minlength=n * n).reshape(n, n).astype(float))
        found = []
        for context in (p[1] * n + p[0], (p[2] * n + p[1]) * n + p[0]):
            keys, at, times = np.unique(context, return_inverse=True, return_counts=True)
            often = times >= LEAST
            number = np.where(often, np.cumsum(often) - 1, -1)[at]
            grid = np.bincount(number[number >= 0] * n + s[number >= 0], minlength=int(often.sum()) * n).reshape(-1, n)
            found.append((keys[often], grid.astype(float)))
        counts[lang] = tables + found
    keys2 = np.unique(np.concatenate([counts[x][2][0] for x in langs] + [np.empty(0, np.int64)]))
    keys3 = np.unique(np.concatenate([counts[x][3][0] for x in langs] + [np.empty(0, np.int64)]))
    # a context of three bytes is reached through the number of its first two
    keys2 = np.unique(np.r_[keys2, keys3 // n])
    row2 = np.zeros(n * n, np.int32)
    row2[keys2] = np.arange(1, len(keys2) + 1)
    row3 = np.zeros((len(keys2) + 1, n), np.int32)
    row3[row2[keys3 // n], keys3 % n] = np.arange(1, len(keys3) + 1)
    cost = np.empty((n + len(keys2) + len(keys3), n, len(langs)), np.float32)
    for k, lang in enumerate(langs):
        order0, order1, (k2, c2), (k3, c3) = counts[lang]
        bits0 = _charged(order0, np.full((1, n), 8.0))
        bits1 = _charged(order1, np.repeat(bits0, n, axis=0))
        grid2 = np.zeros((len(keys2), n))
        grid2[np.searchsorted(keys2, k2)] = c2
        bits2 = _charged(grid2, bits1[keys2 % n])
        grid3 = np.zeros((len(keys3), n))
        grid3[np.searchsorted(keys3, k3)] = c3
        shorter = row2[keys3 % (n * n)]
        bits3 = _charged(grid3, np.where((shorter > 0)[:, None], bits2[shorter - 1] if len(bits2) else 0, bits1[keys3 % n]))
        cost[:, :, k] = np.concatenate([bits1, bits2, bits3])
    return Model(langs, symbol, n, row2, row3, cost)


def _charged(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Bits of each symbol in each context; contexts never met cost nothing to leave."""
    total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        here = -np.log2(counts / (total + distinct))
        escape = -np.log2(distinct / (total + distinct))
    return np.where(total == 0, lower, np.where(counts > 0, here, escape + lower))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language; memory is bounded by CHUNK beyond the texts themselves."""
    bits = np.zeros((len(texts), len(model.langs)))
    full = [i for i, t in enumerate(texts) if t]
    if not full or not model.langs:
        return bits
    text, starts = _joined([texts[i] for i in full])
    s = model.symbol[text]
    p1, p2, p3 = (_before(s, starts, k) for k in (1, 2, 3))
    n, n2 = model.n_symbols, int(model.row2.max(initial=0))
    flat = model.cost.reshape(-1, len(model.langs))
    for at in range(0, len(s), CHUNK):
        a, b, c = (p[at : at + CHUNK].astype(np.int32) for p in (p1, p2, p3))
        two = model.row2[b * n + a]
        three = model.row3[model.row2[c * n + b], a]
        row = np.where(three > 0, n + n2 + three - 1, np.where(two > 0, n + two - 1, a))
        cost = flat[row * n + s[at : at + CHUNK]]
        first = np.searchsorted(starts, at, side="right") - 1
        inside = starts[first + 1 : np.searchsorted(starts, at + len(a))] - at
        sums = np.add.reduceat(cost, np.r_[0, inside], axis=0, dtype=np.float64)
        bits[np.array(full[first : first + len(sums)])] += sums
    return bits


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """At most train_docs texts of a language, one of each id, of TRAIN_BYTES at most, go to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.octet_length("text") > 0))
    ids = rows.select("doc_id", "lang").distinct().withColumn("hash", F.xxhash64("doc_id"))
    # hashes below a bound that some four times as many meet: only these are ranked, whatever a language's size
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    bound = F.least(F.lit(1.0), F.lit(4.0 * train_docs) / F.col("n")) * 2.0**64 - 2.0**63
    near = ids.join(small_or_shuffled(counts, counts.count()), "lang").where((F.col("n") <= 4 * train_docs) | (F.col("hash") <= bound))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    few = [(r.doc_id, r.lang) for r in near.withColumn("rank", rank).where(F.col("rank") <= train_docs).select("doc_id", "lang").collect()]
    chosen = docs.sparkSession.createDataFrame(few or [(None, None)], "doc_id long, lang string")
    met = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", training_text(F.col("text"), TRAIN_BYTES).alias("text"))
    # a repeated id teaches one of its texts, chosen before anything is shuffled
    texts = met.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(texts.select("doc_id", "lang", "text").collect(), key=lambda r: r.doc_id):
        samples.setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    return train(samples)


def _predict(shared):
    def run(batch: pa.RecordBatch) -> dict:
        model: Model = shared.value
        texts = batch.column(1).to_pylist()
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        bits = code_lengths(model, [(t or "").encode("utf-8", "replace") for t in texts])
        if not model.langs:
            return {"doc_id": batch.column(0), "lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -60, 0)).sum(axis=1)
        return {
            "doc_id": batch.column(0),
            "lang_pred": [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
            "score": np.where(lettered, share, 0.0),
        }

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score): the score is the language's share of 2^-bits over all languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs.select("doc_id", "text"), _predict(shared), "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
