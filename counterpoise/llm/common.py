"""What several operators of this package share: scratch tables and byte views of text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Odd multiplier of the rolling hash, any value does.
BASE = 0x9E3779B97F4A7C15


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` of the session; where it is unset, the context's checkpoint
    folder or else a folder in the warehouse, which a cluster shares as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once as Parquet to the scratch folder and read from there.

    Later jobs and lost executors read the files, they do not run the lineage again.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def id_and_text(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty), without the other columns of ``docs``."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut at row borders into parts of about ``size`` bytes of ``column``."""
    if not batch.num_rows:
        return
    _, at = byte_view(batch.column(column))
    part = at[:-1] // size
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for k, factor in enumerate((BASE, inverse)):
            steps = np.full(max(n, SLICE_BYTES + 1), factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``run_hash`` gets the hash of any part of ``data``."""
    power, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal parts have equal hashes."""
    _, inverse = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of every range, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift
