"""Benchmark decontamination with one Aho-Corasick automaton.

A window is ten consecutive words of a benchmark item, or the whole item if it
is shorter. The text of a document is normalised to lower-cased words joined and
surrounded by single blanks, and scanned once. The automaton's patterns are
each item's consecutive blocks of five words (and the shorter items): every
window holds at least one whole block, so each match of a block names the few
places where a window may lie, and these are looked up by a 64-bit hash of
their words among all windows of the benchmark. So the automaton has about one
node for each byte of the benchmark, not one for each byte of its windows.
What is found is given by word and by code points of the original text.

The automaton grows with the benchmark, never with the documents. Its size is
checked before it is built: a benchmark above BLOCK_BYTES is cut into several
automata by item, and the documents, with what was found so far, pass through
one after the other.

Defined cases: null or empty text has no words, so nothing is hit; an item
without words has no window; repeated items, and windows that several items
have, count by their distinct item_ids; rows with a null item_id are left out;
an empty benchmark hits nothing and empty documents give no rows; repeated
documents and null doc_ids are scanned as they come, each row for itself; long
texts are scanned whole; columns other than doc_id and text, or item_id and
text, are not read."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, cut, filter_batches, map_batches, table, utf8, words_of

WINDOW = 10
#: Benchmark text per automaton. A byte of it becomes some 50 bytes of automaton.
BLOCK_BYTES = 1 << 23

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FOUND = "items array<string>, spans array<struct<first:int,last:int>>, chars array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Patterns:
    """What a worker needs of a benchmark. The key names this very table, for the worker's cache."""

    key: str
    window: int
    block: int
    blocks: frozenset[bytes]
    short: dict[bytes, list[str]]
    windows: np.ndarray  # hashes, in order
    edges: np.ndarray  # of each window's owners
    owners: np.ndarray  # numbers of items
    items: list[str]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _window_hashes(h: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(window):
        out = out * _ODD + h[starts + k]
    return out ^ (out >> np.uint64(29))


def patterns_of(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> Patterns:
    block = (window + 1) // 2
    names: dict[str, int] = {}
    blocks: set[bytes] = set()
    short: dict[bytes, set[str]] = defaultdict(set)
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for item, text in items:
        words = words_of((text or "").encode("utf-8", "replace"))
        if len(words) >= window:
            blocks.update(b" ".join(words[at : at + block]) for at in range(0, len(words) - block + 1, block))
            found = np.unique(_window_hashes(_word_hashes(words), np.arange(len(words) - window + 1), window))
            hashes.append(found)
            owners.append(np.full(len(found), names.setdefault(str(item), len(names))))
        elif words:
            short[b" ".join(words)].add(str(item))
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return Patterns(uuid.uuid4().hex, window, block, frozenset(blocks), {k: sorted(v) for k, v in short.items()}, h[at], np.r_[at, len(h)], o, list(names))


_AUTOMATA: dict[str, object] = {}


def _automaton(p: Patterns):
    """Built once per Python worker and benchmark; only the last one is held."""
    if p.key not in _AUTOMATA:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for words in p.blocks | p.short.keys():
            # latin-1 maps bytes to characters one to one, so UTF-8 text is matched byte for byte
            machine.add_word(f" {words.decode('latin-1')} ", (words.count(b" ") + 1, words in p.blocks, p.short.get(words)))
        if len(machine):
            machine.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[p.key] = machine
    return _AUTOMATA[p.key]


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def _hits(p: Patterns, words: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
    """Items with windows in the words, and the ranges of hit words."""
    machine = _automaton(p)
    if not words or not len(machine):
        return set(), []
    plain = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = list(machine.iter(plain))
    if not found:
        return set(), []
    # the k-th blank (from 0) stands before word k, so a match that ends at blank k ends with word k - 1
    blanks = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
    lasts = np.searchsorted(blanks, [end for end, _ in found]) - 1
    items, spans = set(), set()
    for last, (_, (n, _, names)) in zip(lasts.tolist(), found):
        if names:
            items.update(names)
            spans.add((last - n + 1, last))
    ends = lasts[[block for _, (_, block, _) in found]]
    if len(ends) and len(words) >= p.window:
        starts = np.unique((ends[:, None] - np.arange(p.block - 1, p.window)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(words) - p.window)]
        here = _window_hashes(_word_hashes(words), starts, p.window)
        at = np.minimum(np.searchsorted(p.windows, here), len(p.windows) - 1)
        good = p.windows[at] == here
        for k in set(at[good].tolist()):
            items.update(p.items[o] for o in p.owners[p.edges[k] : p.edges[k + 1]])
        spans.update((s, s + p.window - 1) for s in starts[good].tolist())
    return items, _merged(spans)


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original UTF-8 text, end exclusive, of ranges of words."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in spans]


def _scan(patterns: Broadcast, keep_text: bool):
    """A pass over (doc_id, text) or what an earlier pass has returned."""

    def run(batch: pa.RecordBatch) -> dict:
        before = batch.column("items").to_pylist() if "items" in batch.schema.names else None
        earlier = batch.column("spans").to_pylist() if before is not None else None
        counts, items, spans, chars = [], [], [], []
        for k, text in enumerate(utf8(batch.column("text"))):
            words = words_of(text)
            names, hit = _hits(patterns.value, words)
            if before is not None:
                names |= set(before[k])
                hit = _merged([*hit, *((x["first"], x["last"]) for x in earlier[k])])
            counts.append(len(words))
            items.append(sorted(names))
            spans.append([{"first": a, "last": b} for a, b in hit])
            chars.append([{"start": a, "end": b} for a, b in original_spans(text, hit)] if hit else [])
        out = {"doc_id": batch.column("doc_id"), "n_words": counts, "items": items, "spans": spans, "chars": chars}
        return out | ({"text": batch.column("text")} if keep_text else {})

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[tuple[int, int]]:
    """Ranges of item ids by automaton, in one pass over the lengths."""
    sizes = benchmark.where("item_id IS NOT NULL").groupBy("item_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= block_bytes:
        ends = benchmark.agg(F.min("item_id"), F.max("item_id")).first()
        return [(ends[0], ends[1])] if ends[0] is not None else []
    blocks: list[list[int]] = []
    room = 0
    for r in sizes.orderBy("item_id").toLocalIterator():
        if r.n > room or not blocks:
            blocks.append([r.item_id, r.item_id])
            room = block_bytes
        blocks[-1][1] = r.item_id
        room -= r.n
    return [tuple(b) for b in blocks]


def _patterns(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast patterns by block, and whether they are the last; without patterns for an empty benchmark."""
    context = benchmark.sparkSession.sparkContext
    blocks = _blocks(benchmark, block_bytes) or [None]
    for k, ids in enumerate(blocks):
        rows = benchmark.where(F.col("item_id").between(*ids)).select("item_id", "text").toLocalIterator() if ids else []
        yield context.broadcast(patterns_of(((r.item_id, r.text) for r in rows), window)), k == len(blocks) - 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, items, spans of hit words by number from 0, chars: the same in code points) for every row of documents."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for patterns, last in _patterns(benchmark, window, block_bytes):
        rows = map_batches(rows, _scan(patterns, not last), f"doc_id long, n_words long, {_FOUND}" + ("" if last else ", text string"))
        rows = rows if last else cut(rows)
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no window occurs in, with all their columns: one filter per automaton."""
    at = docs.columns.index("text")
    for patterns, last in _patterns(benchmark, window, block_bytes):

        def clean(batch: pa.RecordBatch, patterns=patterns) -> np.ndarray:
            return np.array([not _hits(patterns.value, w)[0] for w in map(words_of, utf8(batch.column(at)))], bool)

        docs = filter_batches(docs, clean)
        docs = docs if last else cut(docs)
    return docs


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.array_join(F.transform("chars", lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("chars"),
    )
