"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a (long, long) table that may be broadcast: about 32 MB as a hash
#: relation. Larger sides are joined by a shuffle instead.
BROADCAST_ROWS = 500_000

#: Arrow rows handled together inside a task; long texts make smaller slices.
SLICE_BYTES = 8 << 20

HELD_OUT_REMAINDER = 2

#: A-Z to a-z and every ASCII byte that is neither digit nor letter to a blank;
#: UTF-8 bytes from 0x80 stay, so non-ASCII letters remain parts of words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text leaves remainder 2 on division by 4."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of A-Z-lower-cased UTF-8 text."""
    return text.translate(WORD_BYTES).split()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of ``spark.checkpoint.dir``: lineage ends
    here, and a lost executor costs no recomputation beyond it. Where none is named,
    a folder of our own will do only if all runs in this one process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted rows are under the limit, otherwise none:
    the join then shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of an Arrow batch whose texts hold about `limit` bytes (one longer
    text makes a piece of its own, or shares it with its neighbours)."""
    size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes)
    step = max(1, batch.num_rows * limit // max(size, limit))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | StructType, column: str = "text", limit: int = SLICE_BYTES
) -> DataFrame:
    """mapInArrow over slices: fn returns the output columns of a slice by name."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for piece in slices(batch, column, limit):
                out = fn(piece)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], column: str = "text") -> DataFrame:
    """The rows for which keep's mask of a slice holds, all columns untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column) if batch.num_rows else ():
                yield piece.filter(pa.array(keep(piece), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def training_text(text: Column, limit: int) -> Column:
    """A text for a model to learn from: whole up to `limit` bytes; of a longer one as many
    code points as surely fit, from a place that its hash chooses."""
    chars = limit // 4
    place = F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - chars + 1)).cast("int")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substr(text, place + 1, F.lit(chars)))
