"""Exact n-gram Jaccard join over a token-group matrix.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Two
documents link at a Jaccard similarity of 0.75 or more. The matrix has a row for
each token and a column for each group of similar documents: a cell is set if
the group's token union holds the token. For a query document, the tokens with a
set cell in a group bound its overlap with every member, so only groups whose
bound reaches the needed overlap are opened and compared member by member.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. First matrix, each class its own group: over a prefix of each set in hash
   order (long enough that a linked pair must share LEVEL of it), count the
   tokens that some other class has, too. Classes below the bound link with
   nothing. Tokens go packed to a range of hashes each; those met twice within a
   task's load are counted there and sent as one marker, so a passage found
   everywhere costs two entries a load.
3. The others are grouped: classes that agree in several minhashes with the
   most central class of a bucket are compared with it exactly, and components
   of these links are the groups. This joins nearly all there is to join.
4. Second matrix, of groups: tokens held by two groups or more are counted per
   class, and only classes with the needed overlap with other groups' unions are
   left. Classes that no leader linked share a column with those of their largest
   minhash bucket, so a cloud of texts just below the threshold is a few columns
   and not one for each. Each class looks up its rarest tokens, by exact
   frequency, in the matrix of the columns' prefixes; where the bound on the
   overlap qualifies, the column is opened. Its members stand in blocks of
   BLOCK_TOKENS, and a query visits each block once: one lookup of its tokens
   counts its overlap with all members. As the members of a group are connected
   already, one link a group is enough.

Hashes have 64 bits; two shingles of one comparison collide with a chance of
about 1e-13, which is the only inexactness.

Defined cases: null text and text without words give the empty set, linked with
nothing; texts of fewer than five words are one shingle of all words; long texts
are read whole, their words hashed in stretches of STRETCH bytes; ties, i.e.
equal sets, are one class under its smallest doc_id; repeated rows of a doc_id
count as one document and are returned once each; where they differ in text, each
text has its own class and links, and a row's component is that of its text; a null doc_id takes no part
and keeps a null component; empty tables give no rows; columns other than doc_id
and text are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, small_or_shuffled, table
from .components import connected_components, connected_further

WORDS = 5
THRESHOLD = 75  # per cent
#: Extra share of a set in its prefix, and so the share that a linked pair must have in common there.
LEVEL = 5  # per cent
MINHASHES = 8
AGREEING = 3
#: Tokens of a range of hashes, and of a task's load, that are handled together.
RANGE_TOKENS = 1 << 19
LOAD_TOKENS = 1 << 19
#: Tokens of a block of group members, and members that a leader meets under one key.
BLOCK_TOKENS = 1 << 17
LED = 512
#: Bytes of text whose words are hashed together; words above LONG_WORD bytes are hashed singly.
STRETCH = 1 << 18
LONG_WORD = 64
SLICE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(9).integers(1, 2**63, (2, MINHASHES), dtype=np.uint64) | np.uint64(1)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A random number for each byte, equal for A-Z and a-z, and powers of an odd base and of its inverse.
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)[np.frombuffer(_LOWER, np.uint8)]
_BASE = 0x2545F4914F6CDD1D


def _powers(base: int) -> np.ndarray:
    out = np.full(STRETCH + LONG_WORD, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end in data, and each text's number of
    words. A word's hash is a polynomial of its lower-cased bytes, from running sums."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_BLANK[data]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    first = edges[:-1][edges[:-1] < edges[1:]]  # of texts that aren't empty
    starts[first] |= inside[1:-1][first]
    last = edges[1:][edges[:-1] < edges[1:]] - 1
    ends[last] |= inside[1:-1][last]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(data), STRETCH):
        i, j = np.searchsorted(starts, (lo, lo + STRETCH))
        if i == j:
            continue
        piece = data[lo : lo + STRETCH + LONG_WORD]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * _UP[: len(piece)], out=sums[1:])
        s, e = starts[i:j] - lo, np.minimum(ends[i:j] - lo, len(piece))
        out[i:j] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
    out = _mixed(out)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().translate(_LOWER))
    return out, np.diff(np.searchsorted(starts, edges))


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each text starts and ends; null is empty."""
    binary = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    edges = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges - edges[0]


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and the edges of the sets."""
    h, counts = _word_hashes(*_texts(column))
    begin = np.r_[0, np.cumsum(counts)]
    out, here = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    if len(h) >= size:
        rolled = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            rolled *= _ODD
            rolled += h[k : len(h) - size + 1 + k]
        out[: len(rolled)] = rolled
        here = np.repeat(begin[1:], counts) - np.arange(len(h)) >= size
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        x = int(counts[k])
        for y in h[begin[k] : begin[k + 1]]:
            x = (x * int(_ODD) + int(y)) & (2**64 - 1)
        out[begin[k]], here[begin[k]] = x, True
    edges = np.r_[0, np.cumsum(here)][begin]
    out = _mixed(out[here])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edges[:-1][edges[:-1] < edges[1:]]] = True
    return out[new], np.r_[0, np.cumsum(new)][edges]


def needed(n: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-n * THRESHOLD // 100)


def _level(n: int) -> int:
    return max(1, -(-n * LEVEL // 100))


def prefix(n: int) -> int:
    return min(n, n - needed(n) + _level(n))


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Stretches of 8-byte values as a binary column."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of _binary: int64 values end to end, and edges."""
    binary = column.cast(pa.large_binary())
    edges = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer((binary.buffers()[2] or pa.py_buffer(b"")).slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes(), np.int64)
    return data, (edges - edges[0]) // 8


def _heads(edges: np.ndarray) -> np.ndarray:
    """Which values of sets that lie end to end belong to their sets' prefixes."""
    sizes = np.diff(edges)
    lengths = np.fromiter(map(prefix, sizes.tolist()), np.int64, len(sizes))
    return np.arange(edges[-1]) - np.repeat(edges[:-1], sizes) < np.repeat(lengths, sizes)


def _signature(batch: pa.RecordBatch) -> dict:
    tokens, edges = shingle_sets(batch.column(1))
    n, full = np.diff(edges), edges[:-1] < edges[1:]
    low = np.zeros((len(n), MINHASHES), np.int64)
    if len(tokens):
        for k, (a, b) in enumerate(zip(*_SEEDS)):
            low[full, k] = (np.minimum.reduceat((tokens ^ a) * b, edges[:-1][full]) >> np.uint64(1)).astype(np.int64)
    d = _digests(tokens, edges)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * MINHASHES), pa.array(low.ravel()))
    head = _heads(edges)
    return {"doc_id": batch.column(0), "n": n, "d1": d[:, 0], "d2": d[:, 1], "low": lists, "head": _binary(tokens[head], np.r_[0, np.cumsum(head)][edges])}


def _packed(ranges: int, whole: bool, own: bool):
    """(d, g, tokens) -> (range, k, g, d): tokens k by range of hashes, with the groups
    and classes that hold them (without groups, if each class is its own). What two
    groups of the load have is sent as a marker, a token of class -1, and counted by
    class in range -1."""

    def packed(load: list[tuple]) -> pa.RecordBatch:
        k, g, d = (np.concatenate(x) for x in zip(*load))
        order = np.lexsort((g, d, k))
        k, g, d = k[order], g[order], d[order]
        again = np.r_[False, (k[1:] == k[:-1]) & (d[1:] == d[:-1])]  # repeated rows of a class
        k, g, d = k[~again], g[~again], d[~again]
        start = np.r_[True, k[1:] != k[:-1]]
        at, run = np.flatnonzero(start), np.cumsum(start) - 1
        met = np.minimum.reduceat(g, at) != np.maximum.reduceat(g, at)
        here = met[run]
        who, times = np.unique(d[here], return_counts=True)
        k, g, d = np.r_[k[~here], k[at][met]], np.r_[g[~here], np.full(met.sum(), -1)], np.r_[d[~here], np.full(met.sum(), -1)]
        which = ((k >> np.int64(33)) + (1 << 30)) * ranges >> np.int64(31)
        order = np.argsort(which, kind="stable")
        which, k, g, d = which[order], k[order], g[order], d[order]
        at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.empty(0, np.int64)
        edges = np.r_[at, len(which), len(which) + len(who)]
        rows = np.r_[which[at], -1]
        k, g, d = np.r_[k, times], np.r_[g, np.zeros(len(who), np.int64)], np.r_[d, who]
        packs = [_binary(k, edges), _binary(g[:0], edges * 0) if own else _binary(g, edges), _binary(d, edges)]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *packs], names=["range", "k", "g", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                tokens, edges = _values(piece.column(2))
                d, g = (np.repeat(piece.column(i).to_numpy(), np.diff(edges)) for i in (0, 1))
                if not whole and len(tokens):
                    head = _heads(edges)
                    tokens, g, d = tokens[head], g[head], d[head]
                load.append((tokens, g, d))
                size += len(tokens)
                if size >= LOAD_TOKENS:
                    yield packed(load)
                    load, size = [], 0
        if size:
            yield packed(load)

    return run


def _by_class(d: np.ndarray, met: np.ndarray, shares: int) -> pa.Table:
    """Counts met of classes d, packed by share of the classes; d may be a small number, so its hash decides."""
    which = ((_mixed(d.astype(np.uint64)) >> np.uint64(33)) * np.uint64(shares) >> np.uint64(31)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    which, d, met = which[order], d[order], met[order]
    at = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.empty(0, np.int64)
    edges = np.r_[at, len(which)]
    return pa.table({"share": pa.array(which[at], pa.int32()), "d": _binary(d, edges), "met": _binary(met, edges)})


def _counts(shares: int):
    def run(table: pa.Table) -> pa.Table:
        """One range's rows of _packed -> (share, d, met): how many of a class's tokens here another group has."""
        k, g, d = (_values(table.column(name).combine_chunks())[0] for name in ("k", "g", "d"))
        if table.column("range")[0].as_py() < 0:
            who, at = np.unique(d, return_inverse=True)
            return _by_class(who, np.bincount(at, weights=k, minlength=len(who)).astype(np.int64), shares)
        g = g if len(g) else d
        order = np.lexsort((g, k))
        k, g, d = k[order], g[order], d[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        met = (d[at] == -1) | (np.maximum.reduceat(g, at) != g[at])
        mine = np.repeat(met, np.diff(np.r_[at, len(k)])) & (d != -1)
        # a class may come from several loads with the same token, as its documents have several rows
        k, d = k[mine], d[mine]
        order = np.lexsort((k, d))
        k, d = k[order], d[order]
        first = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])] if len(k) else np.empty(0, bool)
        who, times = np.unique(d[first], return_counts=True)
        return _by_class(who, times.astype(np.int64), shares)

    return run


def _summed(table: pa.Table) -> pa.Table:
    d, met = (_values(table.column(name).combine_chunks())[0] for name in ("d", "met"))
    who, at = np.unique(d, return_inverse=True)
    return pa.table({"d": who, "met": np.bincount(at, weights=met, minlength=len(who)).astype(np.int64)})


def _met_elsewhere(sets: DataFrame, tokens: int, whole: bool = True, own: bool = False) -> DataFrame:
    """Sets (d, g, tokens) of classes d in groups g, of so many tokens together -> (d, met):
    tokens of a class that another group has, or more where copies of a class lie in several loads."""
    ranges = max(1, -(-tokens // RANGE_TOKENS))
    shares = max(1, -(-tokens // (2 * RANGE_TOKENS)))
    rows = sets.select("d", "g", "tokens").mapInArrow(_packed(ranges, whole, own), "range int, k binary, g binary, d binary")
    # what loads have counted themselves is spread by their number, not gathered in one group
    dealt = rows.withColumn("part", F.when(F.col("range") < 0, F.spark_partition_id()).otherwise(0))
    # so many partitions that one holds a few ranges, whatever the size
    parts = max(ranges, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = dealt.repartition(parts, "range", "part").groupBy("range", "part").applyInArrow(_counts(shares), "share int, d binary, met binary")
    return counted.groupBy("share").applyInArrow(_summed, "d long, met long")


def _digests(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    digest = [xxhash.xxh3_128_digest(tokens[a:b]) if b > a else b"\0" * 16 for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)


def _sets(batch: pa.RecordBatch) -> dict:
    """The sets of the texts whose digest is the one that is asked for."""
    column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    tokens, edges = shingle_sets(column["text"])
    asked = pa.array(_digests(tokens, edges)[:, 0] == column["d1"].to_numpy(zero_copy_only=False))
    return {"id": column["id"].filter(asked), "tokens": _binary(tokens, edges).filter(asked)}


def _block(ids: list[np.ndarray], groups: list[np.ndarray], tokens: list[np.ndarray], sizes: list[np.ndarray]):
    """(ids, sizes, tokens in order, the member of each; its groups, the group of each member, labels of the
    groups) of a block. Groups that a query has connected get one label."""
    ids, t, n = np.concatenate(ids), np.concatenate(tokens), np.concatenate(sizes)
    order = np.argsort(t, kind="stable")
    names, of = np.unique(np.concatenate(groups), return_inverse=True)
    return ids, n, t[order], np.repeat(np.arange(len(ids)), n)[order], names, of, np.arange(len(names))


def _links(block, ids: np.ndarray, groups: np.ndarray, tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of queries with members of other groups, as many as connect what all of them connect."""
    members, sizes, held, whose, names, of, labels = block
    lo, hi = np.searchsorted(held, tokens, "left"), np.searchsorted(held, tokens, "right")
    n, lengths = hi - lo, np.diff(edges)
    found = [np.empty((2, 0), np.int64)]
    if len(members) == 1:
        both = np.diff(np.r_[0, np.cumsum(n)][edges])
        good = (100 * both >= THRESHOLD * (lengths + sizes[0] - both)) & (groups != names[0])
        found.append(np.stack([ids[good], np.full(good.sum(), members[0])]))
    else:
        for q, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            m = n[a:b]
            # the places in the block of this query's tokens, at most the block's own number of tokens
            places = np.repeat(lo[a:b] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum()) if b > a else np.empty(0, np.int64)
            both = np.bincount(whose[places], minlength=len(members))
            good = np.flatnonzero(100 * both >= THRESHOLD * (lengths[q] + sizes - both))
            if not len(good):
                continue
            met, first = np.unique(labels[of[good]], return_index=True)
            at = np.searchsorted(names, groups[q])
            own = labels[at] if at < len(names) and names[at] == groups[q] else -1
            new = first[met != own]
            if len(new):
                found.append(np.stack([np.full(len(new), ids[q]), members[good[new]]]))
                labels[np.isin(labels, met)] = own if own >= 0 else met[0]
    out = np.concatenate(found, axis=1)
    return out[0], out[1]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, part, query, id, of, tokens) sorted by the first three: a block's members, then its queries."""
    key, parts, block = None, ([], [], [], []), None
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        g, part, query, ids, of = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        tokens, edges = _values(batch.column(5))
        cuts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1]), True])
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if (g[a], part[a]) != key:
                key, parts, block = (g[a], part[a]), ([], [], [], []), None
            if not query[a]:
                for kept, new in zip(parts, (ids[a:b], of[a:b], tokens[edges[a] : edges[b]], np.diff(edges[a : b + 1]))):
                    kept.append(new)
                continue
            if block is None and parts[0]:
                block = _block(*parts)
            if block is not None:
                found.append(_links(block, ids[a:b], of[a:b], tokens[edges[a] : edges[b]], edges[a : b + 1] - edges[a]))
        if found:
            x, y = (np.concatenate(z) for z in zip(*found))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def links_into(blocks: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links of queries a of (g, part, id, of) with members b of the block (g, part) in other
    groups `of`; of links that connect the same groups some, and at most as many as queries and
    members. Sets (id, tokens) go to the blocks; nothing is paired by rows."""
    columns = ("g", "part", "query", "id", "of")
    rows = blocks.withColumn("query", F.lit(0)).select(*columns).unionByName(queries.withColumn("query", F.lit(1)).select(*columns))
    held = rows.join(sets.select("id", "tokens"), "id").select(*columns, "tokens")
    return held.repartition("g", "part").sortWithinPartitions("g", "part", "query").mapInArrow(_compare, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of a leader a and a class b whose sets (id, tokens) are linked, as
    (b, a). A leader of many stands in several blocks of its own."""
    pairs = cut(pairs)
    # at most one in LED pairs is here
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts")).where("parts > 1")
    dealt = pairs.join(led, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    queries = cut(dealt.select(F.col("a").alias("g"), F.expr("pmod(xxhash64(b), parts)").cast("int").alias("part"), F.col("b").alias("id"), F.col("b").alias("of")))
    blocks = queries.select("g", "part", F.col("g").alias("id"), F.col("g").alias("of")).distinct()
    return links_into(blocks, queries, sets)


def _buckets(classes: DataFrame) -> DataFrame:
    """(id, key): the minhash buckets of classes (id, low), each under one number."""
    return classes.select("id", F.posexplode("low").alias("i", "value")).select("id", F.xxhash64("i", "value").alias("key"))


def leader_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes (id, low) that agree in AGREEING minhashes, where a leads a
    bucket that b is in. The class whose buckets are the largest leads: the text that
    the others are copies of, rather than one of its copies."""
    keys = _buckets(classes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # a class is gathered once, with its few buckets, rather than joined with itself
    held = keys.join(sizes, "key").groupBy("id").agg((-F.sum("size")).alias("order"), F.collect_list("key").alias("at"))
    shared = cut(held.join(classes.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("id", "order", "low", F.explode("at").alias("key")))
    leads = shared.groupBy("key").agg(F.min(F.struct("order", "id", "low")).alias("lead"))
    met = shared.join(leads, "key").where("id <> lead.id")
    agree = F.size(F.filter(F.zip_with("low", "lead.low", lambda x, y: x == y), lambda same: same))
    return met.where(agree >= AGREEING).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()


def _least_met(size: str) -> Column:
    return F.greatest(F.lit(1), F.expr(f"ceil(ceil({size} * {THRESHOLD} / 100) * {LEVEL} / 100)"))


def narrowed(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Of the sets (id, tokens) and their groups in members (id, g, n): the classes (id, g,
    tokens) whose overlap bound with the other groups' unions is enough, first by
    prefixes, then by whole sets while many fall out. Only ids are written in between."""
    members, whole = cut(members), False
    left, tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    while True:
        grouped = sets.join(small_or_shuffled(members, left), "id").select(F.col("id").alias("d"), "g", "tokens")
        least = F.expr(f"ceil(n * {THRESHOLD} / 100)") if whole else _least_met("n")
        enough = _met_elsewhere(grouped, tokens, whole).withColumnRenamed("d", "id")
        members = cut(members.join(enough, "id").where(F.col("met") >= least).drop("met"))
        now, tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not now or (whole and now > 0.9 * left):  # further rounds would only save work
            return sets.join(small_or_shuffled(members, now), "id").select("id", "g", "tokens")
        whole, left = True, now


def _token_rows(batch: pa.RecordBatch) -> dict | None:
    sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
    sizes = [len(x) for x in sets]
    if not sum(sizes):
        return None
    ids, groups = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    return {"id": np.repeat(ids, sizes), "g": np.repeat(groups, sizes), "token": np.concatenate(sets), "n": np.repeat(sizes, sizes)}


def _blocked(members: DataFrame) -> DataFrame:
    """members (id, g, alone, low) -> (id, g, alone, b): the column of the matrix for each class. Members of a
    group share one; classes that are a group alone share one with those of their largest minhash bucket."""
    keys = _buckets(members.where("alone"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    largest = keys.join(sizes, "key").groupBy("id").agg(F.max(F.struct("size", "key")).alias("at"))
    return members.join(largest, "id", "left").select("id", "g", "alone", F.coalesce("at.key", F.xxhash64(F.lit("group"), "g")).alias("b"))


def _residual(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different groups; sets (id, g, tokens), members (id, g, alone, low)."""
    sets = cut(sets)
    placed = cut(_blocked(members.join(sets.select("id"), "id")))
    # tokens of each set by how many classes have them, the rarest first
    rows = map_batches(sets, _token_rows, "id long, g long, token long, n int", "tokens")
    often = rows.select("token", "g").distinct().groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "token")
    ranked = rows.join(often, "token", "left").withColumn("rank", F.row_number().over(order))
    # of a linked pair with 7 * overlap >= 3 * (n + m) and n >= m, the first common token
    # stands in this prefix of the larger set ...
    near = ranked.where(f"rank <= n - ceil(n * {THRESHOLD} / 100) + 1 AND df > 1").select("id", "token", "rank", "n")
    probe = cut(near.join(placed.select("id", "b", "alone"), "id"))
    # ... and in a shorter one of the smaller set; the matrix holds what a group can offer behind the token
    both = 2 * THRESHOLD / (100 + THRESHOLD)
    matrix = (
        probe.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * both - 1e-9) + 1)
        .groupBy("token", "b")
        .agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("rank")).alias("behind"))
    )
    bound = 1 + F.least(F.col("n") - F.col("rank"), F.col("behind"))
    qualifies = (100 + THRESHOLD) * bound >= THRESHOLD * (F.col("n") + F.col("least"))
    opened = (
        probe.withColumnRenamed("b", "own")
        .join(matrix, "token")
        # a group's own members are connected already; classes alone share their block with others
        .where((F.col("alone") | (F.col("own") != F.col("b"))) & (F.col("n") >= F.col("least")) & qualifies)
    )
    opened = cut(opened.select("id", "b").distinct())
    held = sets.select("id", "g", F.octet_length("tokens").alias("size")).join(placed.select("id", "b"), "id")
    sizes = held.groupBy("b").agg(F.ceil(F.sum(F.col("size") / 8) / BLOCK_TOKENS).cast("int").alias("parts"))
    parts = sizes.join(opened.select("b").distinct(), "b")
    block = F.col("b").alias("g")
    blocks = held.withColumnRenamed("g", "of").join(parts, "b").select(block, F.expr("pmod(xxhash64(id), parts)").cast("int").alias("part"), "id", "of")
    asked = opened.join(sets.select("id", F.col("g").alias("of")), "id").join(parts, "b")
    queries = asked.select(block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "of")
    return links_into(blocks, queries, sets)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(map_batches(texts, _signature, "doc_id long, n long, d1 long, d2 long, low array<long>, head binary", limit=SLICE))
    known = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("class_id"), F.first("low").alias("low"))

    # 2. classes that share enough of their prefix with others
    tokens = signed.agg(F.coalesce(F.sum(F.octet_length("head")), F.lit(0))).first()[0] // 8
    heads = known.select(F.col("d1").alias("d"), F.col("d1").alias("g"), F.col("head").alias("tokens"))
    met = _met_elsewhere(heads, tokens, own=True)
    near = cut(classes.join(met.withColumnRenamed("d", "d1"), "d1").where(F.col("met") >= _least_met("n")).select("d1", "class_id", "n", "low"))
    # a doc_id is the number of its class, or the digest where rows of one doc_id have several texts
    several = near.groupBy("class_id").agg(F.count("*").alias("texts")).where("texts > 1")
    numbered = near.join(small_or_shuffled(several, several.count()), "class_id", "left")
    number = F.when(F.col("texts").isNull(), F.col("class_id")).otherwise(F.col("d1")).alias("id")
    open_classes = cut(numbered.select(number, "d1", "class_id", "n", "low").dropDuplicates(["id"]))
    asked = open_classes.select(F.col("class_id").alias("doc_id"), "d1", "id")
    found = texts.join(small_or_shuffled(asked, near.count()), "doc_id").select("text", "d1", "id")
    opened = map_batches(found, _sets, "id long, tokens binary", limit=SLICE)
    opened = cut(opened.dropDuplicates(["id"]))  # documents may have repeated rows

    # 3. groups by leaders
    links = cut(verify(leader_pairs(open_classes.select("id", "low")), opened))
    groups = connected_components(links)

    # 4. what may still link one group with another
    known_groups = open_classes.join(groups, "id", "left")
    members = known_groups.select("id", F.coalesce("component", "id").alias("g"), "n", F.col("component").isNull().alias("alone"), "low")
    more = cut(_residual(narrowed(opened, members.select("id", "g", "n")), members.drop("n")))
    if not more.isEmpty():
        groups = cut(connected_further(groups, more))

    placed = groups.join(open_classes.select("id", "d1", "class_id"), "id").select("component", "d1", "class_id")
    least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(least, "component").drop("component")
    named = classes.join(placed, ["d1", "class_id"], "left").select("d1", "d2", F.col("n").alias("size"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    same = (signed.d1 == named.d1) & (signed.d2 == named.d2) & (signed.n == named["size"]) & (signed.n > 0)
    return signed.join(named, same, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, with all their columns; rows with a null doc_id stay."""
    others = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")
