"""Token counts of documents in token files, found by their end-of-document ids.

A token file is a run of fixed-width ids without an index, cut into blocks whose borders
ignore documents. It is held as a table with a row per block (file, block, data); files of
bytes outside a table are not read. Each block is searched for the end id with one array
comparison; what a document has in several blocks is put together with a prefix scan over
the blocks' summaries, first inside runs of blocks and then over the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import byte_view, id_and_text, slices, stored, table
from counterpoise.llm.tokens import encode, pieces, vocabulary_path

#: Width of a stored id; 49,408 ids fit.
WIDTH = np.dtype("<u2")

#: End-of-document id: no vocabulary that fits has it, so no text can spell it.
END = 0xFFFF

#: Ids in a block of a token file.
BLOCK = 1 << 18

#: Blocks that the first step of the prefix scan takes together.
RUN = 1024


def write_tokens(docs: DataFrame, path: str | None = None, end: int = END,
                 block: int = BLOCK) -> DataFrame:
    """Token files of ``docs``: rows (file, block, data, doc_ids), stored in scratch.

    ``file`` is the task that wrote it, ``data`` the block's ids as little-endian 16-bit
    numbers. ``doc_ids`` lists the documents that end in the block; the scan does not read
    it. The last block of a file may be shorter. ``end`` must be no id of the vocabulary,
    and all ids must fit the width; otherwise it is a ``ValueError``.
    """
    path = vocabulary_path(path)
    size = len(pieces(path).closes)
    if not size <= end <= np.iinfo(WIDTH).max:
        raise ValueError(f"end id {end} with {size} ids in {WIDTH.itemsize} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number, held = TaskContext.get().partitionId(), 0, np.empty(0, WIDTH)
        waiting: list[tuple[int, object]] = []  # ends of documents in ``held``

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, waiting
            while len(held) >= block or last and len(held):
                own = [key for at, key in waiting if at < block]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file], pa.int32()), pa.array([number], pa.int64()),
                     pa.array([held[:block].tobytes()], pa.binary()),
                     pa.array([own], pa.list_(pa.int64()))],
                    ["file", "block", "data", "doc_ids"])
                waiting = [(at - block, key) for at, key in waiting if at >= block]
                held = held[block:]
                number += 1

        for batch in batches:
            for part in slices(batch):
                data, offsets = byte_view(part.column("text"))
                ids, lengths = encode(path, data, offsets, end)
                last = np.cumsum(lengths) - 1
                waiting += zip((last + len(held)).tolist(), part.column("doc_id").to_pylist())
                held = np.concatenate([held, ids.astype(WIDTH)])
                yield from blocks(False)
        yield from blocks(True)

    return stored(id_and_text(docs).mapInArrow(
        run, "file int, block long, data binary, doc_ids array<long>"), "tokens")


def scan_block(data: np.ndarray, end: int) -> tuple[int, int, int, np.ndarray]:
    """Ids before the first end id, after the last one (all, if there is none), the number
    of end ids, and the lengths of the documents that lie between two of them."""
    at = np.flatnonzero(data == end)
    if not len(at):
        return len(data), len(data), 0, np.empty(0, np.int64)
    return int(at[0]), len(data) - 1 - int(at[-1]), len(at), np.diff(at) - 1


def scan_blocks(blocks: DataFrame, end: int = END) -> DataFrame:
    """One summary row per block: file, block, head, tail, seps, inner lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                raw = batch.column("data")[k].as_py() or b""
                rows.append(scan_block(np.frombuffer(raw, WIDTH), end))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"),
                 *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)),
                 pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["file", "block", "head", "tail", "seps", "inner"])

    return blocks.select("file", "block", "data").mapInArrow(
        run, "file int, block long, head long, tail long, seps long, inner array<long>")


def _carried(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds what lies before a row under the same keys: ``base`` (end ids), ``carry`` (ids
    since the last end id) and ``open`` (there was no end id)."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum("seps").over(over), F.lit(0)))
    rows = rows.withColumn("_sum", F.coalesce(F.sum("tail").over(over), F.lit(0)))
    start = F.last(F.when(F.col("seps") > 0, F.col("_sum")), ignorenulls=True).over(over)
    return (rows.withColumn("open", start.isNull())
            .withColumn("carry", F.col("_sum") - F.coalesce(start, F.lit(0))).drop("_sum"))


def token_counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, ordinal, n_tokens): the ids before each end id, documents counted from 0.

    ``blocks`` are rows (file, block, data); blocks of a file are numbered from 0 without
    gaps. Ids after a file's last end id belong to no document. A null block is empty. No
    task ever holds more than a block; summaries are scanned in runs of RUN blocks, then
    one row per run.
    """
    scans = stored(scan_blocks(blocks, end).withColumn(
        "run", F.floor(F.col("block") / RUN)), "scans")
    within = _carried(scans, ["file", "run"], "block")
    tail = F.col("tail") + F.when(F.col("seps") > 0, 0).otherwise(F.col("carry"))
    totals = within.groupBy("file", "run").agg(
        F.sum("seps").alias("seps"), F.max_by(tail, "block").alias("tail"))
    across = _carried(totals, ["file"], "run").select(
        "file", "run", F.col("base").alias("run_base"), F.col("carry").alias("run_carry"))
    joined = within.join(across, ["file", "run"])
    base = F.col("base") + F.col("run_base")
    carry = F.col("carry") + F.when(F.col("open"), F.col("run_carry")).otherwise(0)
    found = F.concat(F.array(carry + F.col("head")), F.col("inner"))
    return (joined.filter("seps > 0")
            .select("file", base.alias("base"), F.posexplode(found).alias("k", "n_tokens"))
            .select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens"))


def document_token_counts(docs: DataFrame, path: str | None = None,
                          end: int = END) -> DataFrame:
    """doc_id and n_tokens of every document (null text: empty, 0 ids).

    Writes the token files, scans them, and names the documents found by their order.
    Rows that repeat are documents of their own; a null doc_id is kept; other columns are
    not read; an empty table gives no rows.
    """
    files = write_tokens(docs, path, end)
    counts = token_counts(files, end)
    names = files.select("file", "block", F.size("doc_ids").cast("long").alias("seps"), "doc_ids")
    names = names.withColumn("run", F.floor(F.col("block") / RUN))
    inside = Window.partitionBy("file", "run").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    runs = names.groupBy("file", "run").agg(F.sum("seps").alias("seps"))
    runs = runs.select("file", "run", F.coalesce(F.sum("seps").over(
        Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("run_base"))
    names = (names.withColumn("base", F.coalesce(F.sum("seps").over(inside), F.lit(0)))
             .join(runs, ["file", "run"])
             .select("file", (F.col("base") + F.col("run_base")).alias("base"),
                     F.posexplode("doc_ids").alias("k", "doc_id"))
             .select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id"))
    return names.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")


def op2_token_counts(spark, folder: str) -> DataFrame:
    return document_token_counts(table(spark, folder, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
