"""Secret scans: fixed rules, and a linear-chain conditional random field.

The rules (`base`) find assignments to tell-tale names, access keys and long hex
strings. The field tags tokens as begin, inside or outside of a secret, from
their shape, their neighbours and features of the file, decoded by Viterbi; what
it tags apart from the rules' spans is added as kind `crf`.

Tokens are runs of the characters that secrets are made of, and single other
marks. Only a run of 8 characters or more with a digit, or of 20 or more with
letters of both cases, may begin a secret, and inside follows only begin or
inside. Every other token is outside whatever its score, so the chain falls into
windows around the candidates, and decoding windows equals decoding the text.

The field is fitted by maximum likelihood, with forward and backward sums, on at
most TRAIN_DOCS texts that a rule hits and as many of any kind, of TRAIN_BYTES
at most, chosen by a hash of their id; the rules' hits are its labels. In half
of the training windows the names that the rules know are hidden, so that it
learns shape and surroundings rather than the rules.

Defined cases: null text is empty and has no spans; ties can't occur within a
kind, between kinds the order is KINDS; repeated rows are scanned alike, each;
an empty table gives no rows, and without a training text nothing is tagged;
rows with a null doc_id are scanned but not learned from, and of rows that share
a doc_id the smallest text is learned from; other columns are not read. Scanning
is linear in the text: candidates are runs of token characters, tested one by one."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

TRAIN_DOCS = 300
TRAIN_BYTES = 1 << 13
DIMENSIONS = 1 << 13
AROUND = 3  # tokens on either side of a candidate
SURE = 0.75  # mean probability of a tagged span

_TOKEN = re.compile(r"[A-Za-z0-9+/_.=\-]+|[^\sA-Za-z0-9+/_.=\-]")
_RUN = re.compile(r"[A-Za-z0-9+/_.=\-]{8,}")
_DIGIT, _UPPER, _LOWER = re.compile("[0-9]"), re.compile("[A-Z]"), re.compile("[a-z]")
B, I, O = 0, 1, 2  # noqa: E741


def base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the rules' spans."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # a run of hex digits is one match, so asking for 32 finds the same ones as dropping shorter ones
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Window:
    spans: list[tuple[int, int]]
    tokens: list[str]
    may_begin: list[bool]
    file: tuple[str, ...]


def _bucket(x: float) -> int:
    return int(math.log2(x + 1) * 2)


def _file_features(text: str, candidates: int) -> tuple[str, ...]:
    low = text.lower()
    return (
        f"f:named={any(x in low for x in NAMES)}",
        f"f:many={_bucket(candidates)}",
        f"f:dense={_bucket(1000 * candidates / (len(text) + 1))}",
        f"f:code={'{' in text or ';' in text}",
    )


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of 8 characters or more with a digit, or of 20 or more with letters of both cases."""
    out = []
    for m in _RUN.finditer(text):
        s, e = m.span()
        if _DIGIT.search(text, s, e) or (e - s >= 20 and _UPPER.search(text, s, e) and _LOWER.search(text, s, e)):
            out.append((s, e))
    return out


def windows(text: str) -> list[Window]:
    """Candidates with AROUND tokens on either side; those that meet are one window."""
    found = candidates(text)
    if not found:
        return []
    file, out, at = _file_features(text, len(found)), [], 0
    while at < len(found):
        last = at
        # tokens of 24 characters on average around a candidate; further ones don't matter
        while last + 1 < len(found) and found[last + 1][0] - found[last][1] <= 48:
            last += 1
        left, right = found[at][0], found[last][1]
        before = [m.span() for m in _TOKEN.finditer(text, max(0, left - 96), left)][-AROUND:]
        after = [m.span() for m in _TOKEN.finditer(text, right, min(len(text), right + 96))][:AROUND]
        inner = [m.span() for m in _TOKEN.finditer(text, left, right)]
        spans = [*before, *inner, *after]
        begins = {s for s, _ in found[at : last + 1]}
        out.append(Window(spans, [text[s:e] for s, e in spans], [s in begins for s, _ in spans], file))
        at = last + 1
    return out


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", token))))[:8]


def features(w: Window, at: int, hide_names: bool = False) -> np.ndarray:
    """Hashed feature numbers of a token."""
    t = w.tokens[at]
    counts = Counter(t)
    bits = -sum(n / len(t) * math.log2(n / len(t)) for n in counts.values())
    digits = sum(c.isdigit() for c in t) / len(t)
    hexed = all(c in "0123456789abcdef" for c in t)
    out = [
        "bias", f"len={_bucket(len(t))}", f"bits={int(bits * 2)}", f"digits={int(digits * 5)}", f"hex={hexed}",
        f"shape={_shape(t)}", f"upper={any(c.isupper() for c in t)},lower={any(c.islower() for c in t)}", f"head={t[:3]}", *w.file[1 if hide_names else 0 :],
    ]
    for step in (-3, -2, -1, 1, 2):
        near = w.tokens[at + step].lower() if 0 <= at + step < len(w.tokens) else "-"
        if hide_names and any(x in near for x in NAMES):
            near = "?"
        out.append(f"{step}={near[:12]}")
    return np.array([zlib.crc32(f.encode()) % DIMENSIONS for f in out])


def _scores(weights: np.ndarray, w: Window, rows: list[np.ndarray]) -> np.ndarray:
    s = np.stack([weights[r].sum(axis=0) for r in rows])
    for k, may in enumerate(w.may_begin):
        if not may:
            s[k, B] = -1e9
    return s


def _transitions(moves: np.ndarray) -> np.ndarray:
    m = moves.copy()
    m[O, I] = -1e9
    return m


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(s: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(tag) for each token, and expected counts of moves."""
    m, n = _transitions(moves), len(s)
    f, b = np.empty_like(s), np.zeros_like(s)
    f[0] = s[0] + m[O]  # what stands before a window is outside
    for k in range(1, n):
        f[k] = s[k] + _log_sum(f[k - 1][:, None] + m, 0)
    for k in range(n - 2, -1, -1):
        b[k] = _log_sum(m + s[k + 1] + b[k + 1], 1)
    z = _log_sum(f[-1], 0)
    tags = np.exp(f + b - z)
    pairs = np.zeros((3, 3))
    pairs[O] += tags[0]
    for k in range(1, n):
        pairs += np.exp(f[k - 1][:, None] + m + s[k] + b[k] - z)
    return tags, pairs


def viterbi(s: np.ndarray, moves: np.ndarray) -> list[int]:
    m = _transitions(moves)
    best, back = s[0] + m[O], []
    for row in s[1:]:
        through = best[:, None] + m
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + row
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # [DIMENSIONS, 3]
    moves: np.ndarray  # [3, 3]


def _gold(w: Window, secrets: list[tuple[int, int, str]]) -> list[int]:
    tags, now = [], None
    for (s, e), may in zip(w.spans, w.may_begin):
        hit = next((x for x in secrets if x[0] < e and s < x[1]), None)
        if hit and hit is now:
            tags.append(I)
        elif hit and may:
            tags.append(B)
            now = hit
        else:
            tags.append(O)
            now = None
    return tags


def train(texts: list[str], epochs: int = 6, rate: float = 0.2, kinds: tuple[str, ...] = KINDS) -> Model:
    """Stochastic gradient ascent on the log-likelihood; the rules' hits of these kinds are the labels."""
    weights, moves = np.zeros((DIMENSIONS, 3)), np.zeros((3, 3))
    work = []
    for text in texts:
        secrets = [x for x in base(text) if x[2] in kinds]
        for k, w in enumerate(windows(text)):
            rows = [features(w, i, hide_names=(k + len(text)) % 2 == 0) for i in range(len(w.tokens))]
            work.append((w, rows, _gold(w, secrets)))
    order = np.random.default_rng(1)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for at in order.permutation(len(work)):
            w, rows, gold = work[at]
            tags, pairs = posteriors(_scores(weights, w, rows), moves)
            for k, r in enumerate(rows):
                up = -tags[k]
                up[gold[k]] += 1
                np.add.at(weights, r, step * up)
            for a, b in zip([O, *gold], gold):
                pairs[a, b] -= 1
            moves -= step * pairs
    return Model(weights.astype(np.float32), moves)


def tagged(model: Model, text: str) -> list[tuple[int, int]]:
    """Spans (start, end) decoded by Viterbi, of SURE probability in the mean."""
    out = []
    for w in windows(text):
        s = _scores(model.weights, w, [features(w, i) for i in range(len(w.tokens))])
        tags = viterbi(s, model.moves)
        if B not in tags:
            continue
        chance = posteriors(s, model.moves)[0]
        k = 0
        while k < len(tags):
            if tags[k] != B:
                k += 1
                continue
            end = k + 1
            while end < len(tags) and tags[end] == I:
                end += 1
            if np.mean([chance[i, tags[i]] for i in range(k, end)]) >= SURE:
                out.append((w.spans[k][0], w.spans[end - 1][1]))
            k = end
    return out


def spans(model: Model | None, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The rules' spans, and all spans."""
    rules = base(text)
    starts, reach = [x[0] for x in rules], [0, *accumulate((x[1] for x in rules), max)]
    # a span is apart if the rules' spans that start before its end have ended by its start
    more = [(s, e, "crf") for s, e in tagged(model, text) if reach[bisect_left(starts, e)] <= s] if model else []
    return rules, sorted([*rules, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    short = docs.where(F.octet_length("text").between(1, TRAIN_BYTES) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    hit = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]") | F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # ids alone are sorted and sent, then the texts of the chosen ones
    chosen = [[r.doc_id for r in x.select("doc_id").orderBy(*order).limit(train_docs).collect()] for x in (short.where(hit), short)]
    ids = sorted({x for c in chosen for x in c})
    if not ids:
        return None
    texts = {r.doc_id: r.text for r in short.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()}
    return train([texts[x] for c in chosen for x in c])


def _scan(shared):
    def run(batch: pa.RecordBatch) -> dict:
        n: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, every = [], []
        for text in batch.column(1).to_pylist():
            rules, all_ = spans(shared.value, text or "")
            kinds = Counter(k for _, _, k in all_)
            for k in KINDS:
                n[k].append(kinds[k])
            joined = lambda found: ",".join(f"{k}:{s}:{e}" for s, e, k in found)
            digests.append(hashlib.sha256(joined(rules).encode()).hexdigest())
            every.append(joined(all_))
        return {"doc_id": batch.column(0), **{f"n_{k}": v for k, v in n.items()}, "base_sha256": digests, "spans": every}

    return run


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_<kind>, base_sha256, spans) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
    return map_batches(docs.select("doc_id", "text"), _scan(shared), schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
