"""Line dedup by range-partitioned line hashes.

Rows (hash, document, position) are range-partitioned by hash and document and
sorted by hash, then document (largest first) and position. One streaming pass
per partition decides which lines stay. A hash with very many rows spreads over
several ranges, since the document is part of the range key; what such a
partition can't see is told it by the first and last hash of the other
partitions: two rows per partition, whatever the data. The result is a
compressed bitmap of kept lines per document, not text. Bitmaps go to the
documents: by broadcast if they are counted few and small, else by a shuffle.

Defined cases: null or empty text is one empty line, which stays; repeated
lines within one document count as one document; rows with a null doc_id keep
all their lines and are no evidence against others; rows that share a doc_id
are one document for counting and for the largest doc_id, whose rows all keep
the line, but each different text has a bitmap of its own; long texts give a
row per line, never one of all lines; an empty table gives no rows; other
columns are never read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_batches, table, utf8

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_ROWS = "hi long, lo long, doc_id long, pos int, text_hash long"
#: Bitmaps that may be broadcast, by number and bytes.
BROADCAST_BITMAPS, BROADCAST_BYTES = 500_000, 32 << 20


def _key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def _line_rows(min_chars: int):
    def rows(batch: pa.RecordBatch) -> dict:
        digests, docs, places, whole = [], [], [], []
        digest = xxhash.xxh3_128_digest
        for doc, text, text_hash in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
            if doc is None:
                continue
            for pos, line in enumerate(text.split(b"\n")):
                # at least min_chars code points: bytes are an upper bound, so decode only what may qualify
                if len(line) >= min_chars:
                    key = _key(line)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(digest(key))
                        docs.append(doc)
                        places.append(pos)
                        whole.append(text_hash)
        pair = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
        return {"hi": pair[:, 0], "lo": pair[:, 1], "doc_id": np.array(docs, np.int64), "pos": np.array(places, np.int32), "text_hash": np.array(whole, np.int64)}

    return rows


def _edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(hash, distinct documents up to 3, first and last document) of the first and
    last hash of a partition: all that its neighbours can't see."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new_key = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
        new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
        starts = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_doc, starts, dtype=np.int64)
        ends = np.r_[starts[1:], len(hi)] - 1
        for at in dict.fromkeys((0, len(starts) - 1)):
            s, e = starts[at], ends[at]
            piece = [int(hi[s]), int(lo[s]), int(counts[at]), int(doc[s]), int(doc[e])]
            if last is not None and last[:2] == piece[:2] and at == 0:
                last[2] += piece[2] - (last[4] == piece[3])
                last[4] = piece[4]
                continue
            if first is None:
                first = last = piece
            else:
                last = piece
    if first is not None:
        yield tuple(first)
        if last is not first:
            yield tuple(last)


def _edge_frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(_edges_of(batches))
    names = ["hi", "lo", "docs", "first_doc", "last_doc"]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(5)], names=names)


def _stream(edges: dict[tuple[int, int], tuple[int, int]], min_docs: int):
    """Emits the (document, text, position) of dropped lines. Per hash it holds the
    positions of the documents seen before the min_docs-th, and nothing after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keep, distinct, doc_now, waiting = None, None, 0, None, []
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            hi, lo, doc, pos, text = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(hi):
                continue
            starts = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(hi)]):
                here = (int(hi[s]), int(lo[s]))
                if e - s == 1 and here != key and here not in edges and e < len(hi):
                    continue  # the hash has one row in all
                if here != key:
                    key, distinct, doc_now, waiting = here, 0, None, []
                    known = edges.get(here)
                    keep = known[1] if known else int(doc[s])
                    if known:
                        distinct = min_docs if known[0] >= min_docs else -(1 << 62)
                d, p, t = doc[s:e], pos[s:e], text[s:e]
                fresh = np.r_[d[0] != doc_now, d[1:] != d[:-1]]
                distinct, doc_now = distinct + int(fresh.sum()), d[-1]
                drop = d != keep
                if distinct >= min_docs:
                    out += [*waiting, (d[drop], t[drop], p[drop])]
                    waiting = []
                elif distinct > 0 and drop.any():
                    waiting.append((d[drop], t[drop], p[drop]))
            if out:
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "text_hash", "pos"])

    return run


def _bitmap(batch: pa.RecordBatch) -> dict:
    """zlib-compressed bits, one a line up to the last dropped one; bits past the end mean kept."""
    bitmaps, dropped = [], []
    for places in batch.column(2).to_pylist():
        bits = np.ones(max(places) // 8 * 8 + 8, np.uint8)  # whole bytes: the padding means kept, too
        bits[np.array(places)] = 0
        bitmaps.append(zlib.compress(np.packbits(bits).tobytes()))
        dropped.append(int(len(bits) - bits.sum()))
    return {"doc_id": batch.column(0), "text_hash": batch.column(1), "bitmap": bitmaps, "n_dropped": dropped}


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, bitmap, n_dropped) for each document, and text of it, that loses lines."""
    spark = docs.sparkSession
    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text", _text_hash(docs).alias("text_hash")), _line_rows(min_chars), _ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(
        rows.repartitionByRange(parts, "hi", "lo", F.desc("doc_id")).sortWithinPartitions("hi", "lo", F.desc("doc_id"), "pos")
    )
    ends = ranged.select("hi", "lo", "doc_id").mapInArrow(_edge_frame, "hi long, lo long, docs long, first_doc long, last_doc long")
    edges: dict[tuple[int, int], list[int]] = {}
    # two rows per partition; summing may count a document twice where a range ends inside it, so those are told apart
    for r in sorted(ends.collect(), key=lambda r: (r.hi, r.lo, -r.first_doc)):
        e = edges.setdefault((r.hi, r.lo), [0, r.first_doc, None])
        e[0] += r.docs - (e[2] == r.first_doc)
        e[1], e[2] = max(e[1], r.first_doc), r.last_doc
    known = {k: (v[0], v[1]) for k, v in edges.items()}
    dropped = ranged.mapInArrow(_stream(known, min_docs), "doc_id long, text_hash long, pos int")
    grouped = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("places"))
    return map_batches(grouped, _bitmap, "doc_id long, text_hash long, bitmap binary, n_dropped long", "places")


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """docs with `__bitmap`, null where no line is dropped. Without a shuffle of texts where the bitmaps are small."""
    maps = cut(keep_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__text_hash"), F.col("bitmap").alias("__bitmap")))
    n, size = maps.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("__bitmap")), F.lit(0))).first()
    maps = F.broadcast(maps) if n <= BROADCAST_BITMAPS and size <= BROADCAST_BYTES else maps
    same = (docs["doc_id"].cast("long") == F.col("__doc_id")) & (_text_hash(docs) == F.col("__text_hash"))
    return docs.join(maps, same, "left").drop("__doc_id", "__text_hash")


def _kept(lines: list[bytes], bitmap: bytes | None) -> list[bytes]:
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    n = len(bits)
    return [x for i, x in enumerate(lines) if i >= n or bits[i]]


def _apply(batch: pa.RecordBatch) -> dict:
    kept, before, after = [], [], []
    for text, bitmap in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
        lines = text.split(b"\n")
        left = _kept(lines, bitmap)
        before.append(len(lines))
        after.append(len(lines) - len(left))
        kept.append(b"\n".join(left))
    return {"doc_id": batch.column(0), "n_lines": before, "n_dropped": after, "kept": pa.array(kept, pa.binary())}


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept binary): each document with its kept lines joined again."""
    joined = _with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs)
    return map_batches(joined, _apply, "doc_id long, n_lines long, n_dropped long, kept binary")


def _replace(names: list[str]):
    """All columns, with text and n_chars of what is kept; untouched texts stay as they are, null too."""
    text_at, bits_at = names.index("text"), names.index("__bitmap")

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text_at).to_pylist()
        for i, bitmap in enumerate(batch.column(bits_at).to_pylist()):
            if bitmap is not None:
                lines = (texts[i] or "").encode("utf-8", "replace").split(b"\n")
                texts[i] = b"\n".join(_kept(lines, bitmap)).decode("utf-8")
        out = {name: batch.column(i) for i, name in enumerate(names)} | {"text": texts}
        if "n_chars" in names:
            out["n_chars"] = [None if t is None else len(t) for t in texts]
        return out

    return run


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents without their dropped lines, with all their columns."""
    joined = _with_bitmaps(docs, min_chars, min_docs)
    return map_batches(joined, _replace(joined.columns), docs.schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )
