"""Pieces shared by the training-data operators: Arrow views, checkpoints, batch bounds."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, free  # noqa: F401

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: bounds a Python worker's memory on ordinary documents.
BATCH_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches of the plans that follow, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def fold_remainder(doc_id: int | None, mod: int) -> int:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def remainder_column(column: str, mod: int):
    """The same as fold_remainder(), as a column."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the row boundaries in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - (offsets[0] if len(offsets) else 0)


def rows_at(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The distinct rows in which these byte positions lie."""
    return np.unique(np.searchsorted(offsets, positions, side="right") - 1)


def byte_class(chars: str | bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars if isinstance(chars, bytes) else chars.encode("ascii"), dtype=np.uint8)] = True
    return table


def segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for ordered, disjoint segments; empty ones sum to 0."""
    out = np.zeros((len(starts), *values.shape[1:]), dtype=np.result_type(values, np.float64) if values.dtype.kind == "f" else np.int64)
    full = ends > starts
    if full.any():
        marks = np.empty(2 * int(full.sum()), dtype=np.int64)
        marks[0::2], marks[1::2] = starts[full], ends[full]
        pad = np.zeros((1, *values.shape[1:]), dtype=values.dtype)
        out[full] = np.add.reduceat(np.concatenate([values, pad]), marks, axis=0, dtype=out.dtype)[0::2]
    return out


def record(schema: str, spark: SparkSession) -> pa.Schema:
    """The Arrow schema that belongs to a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema, timezone="UTC")
