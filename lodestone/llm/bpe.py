"""Byte-level BPE through a table of distinct words.

A text is split into words in Spark, by the pattern that comes before the merges,
after the added tokens have been cut out. Words repeat, merges never cross them:
so each distinct word is encoded once and its ids go back to every place.

1. The words of a sample of documents (SAMPLE: one in 4, chosen by hash) are
   counted, and the COMMON_WORDS most frequent, of up to COMMON_BYTES bytes,
   encoded. This table has a fixed size and is broadcast. Which words are in it
   changes the speed only.
2. Every document's words are looked up in it, a slice of texts at a time. Words
   that aren't there are exchanged by word and sorted, so each is encoded once
   for all its places, and the ids return by document and position. No hot word is
   among them but one that the sample missed, and that passes as a stream.
3. Ids are decoded by a join with the vocabulary (id, piece): its size is that of
   the tokenizer's file, so it is broadcast; the pieces' bytes are concatenated.

The JVM's tables of letters are older than the library's: texts with code points
unknown to the JVM are split by the library itself.

Defined cases: null text is empty: no ids; repeated rows give equal rows; a null
id is an id like another; texts and words of any length are whole; strings of
special tokens in a text become these tokens, as in the library; an empty table
gives no rows; other columns are not read. Only byte-level files without a
normalizer and with plain added tokens are read; others raise an error."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: The split of byte-level files, a fixed value; (?U): classes by Unicode.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAMPLE = 4
COMMON_WORDS, COMMON_BYTES = 1_000_000, 32
#: Words that the library encodes at a time; it makes a large object of each.
AT_ONCE = 10_000

_PROBED = "doc_id long, hi long, lo long, found binary"


def load(path: str) -> str:
    """The tokenizer file's JSON, checked to be one that this module can split for."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("not a plain byte-level tokenizer file")
    if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take their surroundings into account aren't supported")
    return text


def _tokenizer(spec: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def _added(spec: str) -> list[str]:
    return sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=lambda s: (-len(s), s))


def words(text: Column, added: list[str]) -> Column:
    """The words of a text in order, added tokens being words of their own."""
    split = lambda t: F.regexp_extract_all(t, F.lit("(?U)" + PATTERN), F.lit(0))
    if not added:
        return split(text)
    either = "|".join(re.escape(t) for t in added)
    tokens = F.regexp_extract_all(text, F.lit(either), F.lit(0))
    pieces = F.transform(F.split(text, either, -1), lambda t, k: F.when(k == 0, split(t)).otherwise(F.concat(F.array(F.get(tokens, k - 1)), split(t))))
    holds = F.lit(False)
    for token in added:
        holds |= F.contains(text, F.lit(token))
    return F.when(holds, F.flatten(pieces)).otherwise(split(text))


def split_by_library(t, added: list[str], text: str) -> list[str]:
    """The same words, by the library's own splitter."""
    either = re.compile("(" + "|".join(re.escape(x) for x in added) + ")") if added else None
    out = []
    for k, part in enumerate(either.split(text) if either else [text]):
        out += [part] if k % 2 else [part[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(part)]
    return out


def _ids_of(t, distinct: list[str]) -> pa.ListArray:
    kind = pa.list_(pa.int32())
    blocks = [pa.array([e.ids for e in t.encode_batch(distinct[k : k + AT_ONCE], add_special_tokens=False)], kind) for k in range(0, len(distinct), AT_ONCE)]
    return pa.concat_arrays(blocks) if blocks else pa.array([], kind)


def _text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and two hashes of both that name the row. Equal rows share them, and all else."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"hi": F.xxhash64("text", "doc_id"), "lo": F.xxhash64(F.lit(1), "doc_id", "text")})


def common_words(docs: DataFrame, spec: str, shared) -> bytes:
    """The most frequent words of the sample with their ids, as an Arrow stream; the most frequent first."""
    rows = _text_rows(docs).where(F.pmod("lo", F.lit(SAMPLE)) == 0)
    seen = rows.select(F.explode(words(F.col("text"), _added(spec))).alias("word")).where(F.octet_length("word") <= COMMON_BYTES)
    best = seen.groupBy("word").count().orderBy(F.desc("count"), "word").limit(COMMON_WORDS).repartition("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(shared.value)
        for batch in batches:
            found = batch.column(0).cast(pa.string())
            yield pa.RecordBatch.from_arrays([found, batch.column(1), _ids_of(t, found.to_pylist())], names=["word", "count", "ids"])

    met = best.mapInArrow(run, "word string, count long, ids array<int>").toArrow()
    met = met.sort_by([("count", "descending"), ("word", "ascending")]).select(["word", "ids"])
    batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in met.columns], names=["word", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(stream: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(stream)).read_next_batch()


def _pack(numbers: np.ndarray, missing: list[bytes]) -> bytes:
    """Numbers of words in the common table, -1 where a word isn't there, and these
    words. Numbers are stored by byte, the highest bytes being nearly always zero."""
    head = np.r_[len(missing), list(map(len, missing)), numbers + 1].astype("<u4")
    head = zstandard.compress(head.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)
    return len(head).to_bytes(4, "little") + head + b"".join(missing)


def _unpack(found: bytes) -> tuple[np.ndarray, list[str]]:
    end = 4 + int.from_bytes(found[:4], "little")
    head = np.frombuffer(zstandard.decompress(found[4:end]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    n = int(head[0])
    ends = (end + np.cumsum(head[1 : n + 1])).tolist()
    return head[n + 1 :] - 1, [found[a:b].decode() for a, b in zip([end, *ends], ends)]


def _probe(spec, common):
    """Word numbers in the common table, packed; words that aren't there, with their positions."""
    state: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state.update(tokenizer=_tokenizer(spec.value), words=_open(common.value).column(0), added=_added(spec.value))
        lists, odd = batch.column(3), batch.column(4)
        if odd.null_count < len(odd):
            lists = pa.array([w if t is None else split_by_library(state["tokenizer"], state["added"], t) for w, t in zip(lists.to_pylist(), odd.to_pylist())], pa.list_(pa.string()))
        flat = lists.flatten().dictionary_encode()
        known = pc.index_in(flat.dictionary.cast(pa.string()), value_set=state["words"]).fill_null(-1).to_numpy()
        codes = flat.indices.to_numpy()
        at = known[codes] if len(codes) else np.zeros(0, np.int32)
        starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        holes = np.flatnonzero(at < 0)
        lost = flat.dictionary.cast(pa.binary()).take(pa.array(codes[holes])).to_pylist()
        cuts = np.searchsorted(holes, starts)
        found = [_pack(at[starts[k] : starts[k + 1]], lost[cuts[k] : cuts[k + 1]]) for k in range(len(lists))]
        return {"doc_id": batch.column(0), "hi": batch.column(1), "lo": batch.column(2), "found": found}

    return run


def _missing():
    """A row for each place of a word that isn't in the common table. Equal documents
    are in one partition: only the first of them asks."""
    asked: set[tuple[int, int]] = set()

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"hi": [], "lo": [], "pos": [], "word": []}
        for hi, lo, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if (hi, lo) not in asked:
                asked.add((hi, lo))
                numbers, lost = _unpack(found)
                for values, more in zip(out.values(), ([hi] * len(lost), [lo] * len(lost), np.flatnonzero(numbers < 0).tolist(), lost)):
                    values += more
        return out

    return run


def _places(pos: pa.Array, lists: pa.ListArray) -> pa.Array:
    """A position and the ids there as one binary, four bytes each."""
    sizes = pc.list_value_length(lists).to_numpy()
    ends = np.cumsum(sizes + 1)
    data = np.empty(int(ends[-1]), "<i4")
    first = ends - sizes - 1
    data[first] = pos.to_numpy()
    data[np.delete(np.arange(len(data)), first)] = lists.flatten().to_numpy()
    return pa.Array.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int32)), pa.py_buffer(data)])


def _read_places(places: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    sizes = pc.binary_length(places).to_numpy().astype(np.int64) // 4
    data = np.frombuffer(b"".join(places.to_pylist()), "<i4")
    first = np.cumsum(sizes) - sizes
    ids = pa.array(np.delete(data, first), pa.int32())
    return data[first], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes - 1)], pa.int32()), ids)


def _encode_runs(spec):
    """Rows sorted by word: each word is encoded where its run begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, ids = _tokenizer(spec.value), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(3).cast(pa.string()))
            distinct = runs.values.to_pylist()
            lists = _ids_of(t, distinct[1:] if distinct[0] == last else distinct)
            if distinct[0] == last:
                lists = pa.concat_arrays([ids, lists])
            last, ids = distinct[-1], lists.slice(len(lists) - 1)
            each = np.repeat(np.arange(len(distinct)), np.diff(np.r_[0, runs.run_ends.to_numpy()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _places(batch.column(2), lists.take(pa.array(each)))], names=["hi", "lo", "place"])

    return run


def _fill(common):
    state: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state["ids"] = _open(common.value).column(1)
        packed = [_unpack(x)[0] for x in batch.column(1).to_pylist()]
        at = np.concatenate(packed)
        # what returned, by position: one list for each hole, in the order of the holes
        places = batch.column(2)
        pos, back = _read_places(places.flatten())
        rows = np.repeat(np.arange(len(places)), pc.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False))
        lists = pa.concat_arrays([state["ids"], back.cast(state["ids"].type).take(pa.array(np.lexsort((pos, rows))))])
        holes = at < 0
        index = at.copy()
        index[holes] = len(state["ids"]) + np.arange(int(holes.sum()))
        taken = lists.take(pa.array(index))
        sizes = np.r_[0, np.cumsum(pc.list_value_length(taken).to_numpy(zero_copy_only=False))]
        ends = np.cumsum([0, *map(len, packed)])
        ids = pa.ListArray.from_arrays(pa.array(sizes[ends], pa.int32()), taken.flatten())
        return {"doc_id": batch.column(0), "ids": ids}

    return run


def encode(docs: DataFrame, spec: str) -> DataFrame:
    """(doc_id, ids array<int>) of each document; spec as load() returns it."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(spec)
    common = context.broadcast(common_words(docs, spec, shared))
    rows = _text_rows(docs)
    odd = F.rlike("text", F.lit(r"\p{Cn}"))
    split = rows.select("doc_id", "hi", "lo", F.when(~odd, words(F.col("text"), _added(spec))).alias("words"), F.when(odd, F.col("text")).alias("text"))
    # both readers take every column of this exchange, so it is written once and read twice
    probed = map_batches(split, _probe(shared, common), _PROBED, "words").repartition("hi", "lo")
    rare = map_batches(probed, _missing(), "hi long, lo long, pos int, word string", "found", 1 << 20)
    encoded = rare.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_runs(shared), "hi long, lo long, place binary")
    places = encoded.groupBy("hi", "lo").agg(F.collect_list("place").alias("places"))
    met = probed.join(places, ["hi", "lo"], "left").select("doc_id", "found", "places")
    return map_batches(met, _fill(common), "doc_id long, ids array<int>", "found", 1 << 20)


def pieces(spec: str) -> list[bytes]:
    """The bytes of each id, by id: the vocabulary as a table with a dense key."""
    t = _tokenizer(spec)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    names = [t.id_to_token(k) or "" for k in range(t.get_vocab_size(with_added_tokens=True))]
    return [bytes(shown[c] for c in name) if all(c in shown for c in name) else name.encode() for name in names]


def decode(encoded: DataFrame, spec: str) -> DataFrame:
    """(doc_id, ids, decoded): the pieces of the ids, concatenated; broken UTF-8 becomes U+FFFD."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(pieces(spec))
    state: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        if not state:
            state["pieces"] = pa.array(vocabulary.value, pa.binary())
        ids = batch.column(1)
        joined = state["pieces"].take(ids.flatten())
        _, at, data = joined.buffers()
        at = np.frombuffer(at, np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
        ends = at[np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))].astype(np.int64)]
        view = memoryview(data) if data is not None else memoryview(b"")
        texts = [bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return {"doc_id": batch.column(0), "ids": ids, "decoded": texts}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded string", "ids")


def op13_byte_pair_encoding(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spec = load(path)
    done = decode(encode(table(spark, sf_dir, "documents"), spec), spec)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
