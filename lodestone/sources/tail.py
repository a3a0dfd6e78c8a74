"""Growing JSON-lines files as a stream, by byte watermark; and sinks that write a batch once.

`jsonl_tail` is a Python data source of Structured Streaming. Its offset says for each file how
many bytes have been read, when it was changed, and a digest of its first bytes. A batch reads, in
tasks, the bytes that were appended since, up to the last line feed: an unfinished line waits for its end. A file that has
shrunk, whose head differs, or that was rewritten at equal length is read anew from its
start; one that is gone is forgotten. Offsets lie in the query's checkpoint, so a
restart goes on where it stopped and no line comes twice. Long ranges are split at line feeds, so that a
first read of a large file has many tasks. Files are opened through pyarrow's
filesystems: a local or mounted folder, or a URI of a store that it knows.

Lines that don't parse are skipped; the watermark passes them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.sources.logs import JOURNAL, NAMES

HEAD_BYTES = 256
RANGE_BYTES = 64 << 20
_BLOCK = 1 << 20


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _head(path: str, upto: int) -> str:
    with _open(path) as f:
        return hashlib.sha256(f.read(min(upto, HEAD_BYTES))).hexdigest()


def _last_line_end(path: str, size: int, known: int) -> int:
    """The end of the last whole line, searched backwards from the end of the file, not below `known`."""
    with _open(path) as f:
        end = size
        while end > known:
            start = max(known, end - _BLOCK)
            f.seek(start)
            cut = f.read(end - start).rfind(b"\n")
            if cut >= 0:
                return start + cut + 1
            end = start
    return known


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _files(self) -> Iterator[tuple[str, int, int]]:
        system, inner = fs.FileSystem.from_uri(self.folder)
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(self.suffix):
                yield info.path, info.size, info.mtime_ns or 0

    def latestOffset(self) -> dict:
        out = {}
        for path, size, changed in self._files():
            old = self.seen.get(path)
            grown = old and size >= old[0] and _head(path, old[0]) == old[2]
            if old and grown and size == old[3] and changed == old[1]:
                out[path] = old
                continue
            rewritten = grown and size == old[3]
            known, turn = (old[0], old[4]) if grown and not rewritten else (0, (old[4] + 1) if old else 0)
            read = _last_line_end(path, size, known)
            out[path] = [read, changed, _head(path, read), size, turn]
        self.seen = out
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.seen = self.seen or after
        ranges = []
        for path, (read, _, _, _, turn) in sorted(after.items()):
            old = before.get(path)
            first = old[0] if old and old[4] == turn else 0
            ranges += [_Range(path, a, min(a + self.range_bytes, read)) for a in range(first, read, self.range_bytes)]
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in a range; the last one may end beyond it."""
        with _open(partition.path) as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                # whatever began before the range belongs to the one before
                skipped = _read_line(f)
                at += len(skipped) - 1
            f.seek(at)
            lines, offsets = [], []
            while at < partition.end:
                line = _read_line(f)
                if not line.endswith(b"\n"):
                    break
                lines.append(line[:-1].decode("utf-8", "replace"))
                offsets.append(at)
                at += len(line)
                if len(lines) >= 20_000:
                    yield self._batch(partition.path, offsets, lines)
                    lines, offsets = [], []
            if lines:
                yield self._batch(partition.path, offsets, lines)

    @staticmethod
    def _batch(path: str, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(lines)), pa.array(offsets, pa.int64()), pa.array(lines)], names=["file", "offset", "line"])

    def commit(self, end: dict) -> None:
        self.seen = json.loads(end["files"])


def _read_line(f) -> bytes:
    out = []
    while block := f.read(1 << 16):
        cut = block.find(b"\n")
        if cut >= 0:
            f.seek(f.tell() - len(block) + cut + 1)
            out.append(block[: cut + 1])
            break
        out.append(block)
    return b"".join(out)


class JsonLinesTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def tail_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, offset, line) of what is appended to the files of a folder, as a stream."""
    spark.dataSource.register(JsonLinesTail)
    return spark.readStream.format("jsonl_tail").option("path", folder).option("suffix", suffix).option("rangebytes", str(range_bytes)).load()


def tail_journal(spark: SparkSession, folder: str, schema: str = JOURNAL, **options) -> DataFrame:
    """Events appended to the journals of a folder; `file` and `offset` say where they stand."""
    rows = tail_lines(spark, folder, **options).withColumn("e", F.from_json("line", schema, {"timeZone": "UTC"}))
    return rows.where("e.id IS NOT NULL").select("file", "offset", "e.*").withColumnsRenamed(NAMES)


def append_batches(rows: DataFrame, path: str, checkpoint: str):
    """A started query that adds each batch to a folder of Parquet files once: a batch that is
    run again after a failure replaces what its first run left (`batch` is part of the path).
    All that has come is taken, then the query ends."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def traces(rows: DataFrame) -> DataFrame:
    """Engine-trace lines, typed: (at, kind, trace_id, actor, duration_ms, detail)."""
    schema = "at timestamp, kind string, traceId string, actor string, durationMs double, detail map<string,string>"
    found = rows.withColumn("e", F.from_json("line", schema, {"timeZone": "UTC"})).where("e.at IS NOT NULL AND e.kind IS NOT NULL")
    return found.select("file", "offset", "e.*").withColumnsRenamed({"traceId": "trace_id", "durationMs": "duration_ms"})
