"""Vector bin packing of token sequences.

Every document becomes pieces, every piece lies in one sequence, and a sequence respects
three limits at once: tokens, segments (pieces) and loss-bearing tokens. Full-length
pieces of long documents are sequences by themselves. What remains is packed block by
block: the open sequence takes the piece whose need has the largest dot product with
what the sequence has left; if none fits and cutting is allowed, a piece is cut to fill it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import byte_view, id_and_text, slices, table
from counterpoise.llm.tokens import encode, vocabulary_path


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. ``block``: pieces that are packed together."""

    tokens: int = 2048
    segments: int = 1024
    loss: int = 2048
    block: int = 8192


#: Id that closes a document.
END = 1

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


def pack_block(length: np.ndarray, loss_from: np.ndarray, start: np.ndarray, limits: Limits,
               cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length).

    Item i has ``length[i]`` tokens from position ``start[i]`` of its document on; those at
    positions from ``loss_from[i]`` on bear loss. Items must fit an empty sequence unless
    ``cut``. Ties go to the earlier item. An item that no limits allow raises ValueError.
    """
    def loss_of(at, size, first):
        return np.maximum(0, at + size - np.maximum(at, first))

    left, at = length.astype(np.int64).copy(), start.astype(np.int64).copy()
    item = np.flatnonzero(left > 0)
    full = np.array([limits.tokens, limits.segments, limits.loss], float)
    out: list[list[tuple[int, int, int]]] = []
    need = loss_of(at, left, loss_from)
    if not cut and ((left > limits.tokens) | (need > limits.loss)).any():
        raise ValueError("an example is beyond the limits of a sequence")
    while len(item):
        room = [limits.tokens, limits.segments, limits.loss]
        taken: list[tuple[int, int, int]] = []
        gone = 0
        while room[0] > 0 and room[1] > 0 and len(item) > gone:
            size, bears = left[item], need[item]
            fits = (size > 0) & (size <= room[0]) & (bears <= room[2])
            if fits.any():
                rest = np.array(room) / full
                value = size * (rest[0] / full[0]) + rest[1] / full[1] + bears * (rest[2] / full[2])
                value[~fits] = -1
                i = int(item[value.argmax()])
                share = int(left[i])
            elif cut:
                i = int(item[size.argmax()])
                # as many tokens as the sequence takes, counting those that bear loss
                free = max(0, int(loss_from[i]) - int(at[i]))
                share = min(room[0], int(left[i]), free + room[2])
                if share <= 0:
                    break
            else:
                break
            taken.append((i, int(at[i]), share))
            used = int(loss_of(at[i], share, loss_from[i]))
            room = [room[0] - share, room[1] - 1, room[2] - used]
            at[i] += share
            left[i] -= share
            need[i] = loss_of(at[i], left[i], loss_from[i])
            gone += left[i] == 0
        if not taken:
            raise ValueError("the limits allow no token")
        item = item[left[item] > 0]
        out.append(taken)
    return out


def halved(taken: list[tuple[int, int, int]], tokens: int) -> list[list[tuple[int, int, int]]]:
    """A sequence short of ``tokens`` cut into sequences of powers of two, longest first."""
    total = sum(size for _, _, size in taken)
    if total >= tokens:
        return [taken]
    out, queue = [], list(taken)
    while total:
        goal = 1 << (total.bit_length() - 1)
        total -= goal
        part = []
        while goal:
            i, at, size = queue.pop(0)
            share = min(goal, size)
            part.append((i, at, share))
            goal -= share
            if share < size:
                queue.insert(0, (i, at + share, size - share))
        out.append(part)
    return out


class _Writer:
    def __init__(self, limits: Limits, partition: int):
        self.limits, self.next_id = limits, partition << 40
        self.rows: list[tuple] = []

    def sequence(self, parts: list[tuple[int, int, int]], doc: list, ids: list[np.ndarray],
                 base: list[int], total: list[int], loss_from: list[int]) -> None:
        offset = 0
        for i, at, size in parts:
            part = ids[i][at - base[i]:at - base[i] + size]
            crc = zlib.crc32(part.astype("<u4").tobytes())
            bears = max(0, at + size - max(at, loss_from[i]))
            self.rows.append((doc[i], at, size, crc, total[i], self.next_id, offset, bears))
            offset += size
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        columns = list(zip(*self.rows)) or [[]] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def packer(path: str, end: int, limits: Limits) -> Callable:
    """The function of Arrow batches that tokenizes, cuts and packs one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(limits, TaskContext.get().partitionId())
        whole = min(limits.tokens, limits.loss)
        doc, ids, base, total, loss_from = [], [], [], [], []

        def pack() -> None:
            made = pack_block(np.array([len(x) for x in ids], np.int64), np.array(loss_from),
                              np.array(base, np.int64), limits)
            if made:
                made[-1:] = halved(made[-1], limits.tokens)
            for parts in made:
                writer.sequence(parts, doc, ids, base, total, loss_from)
            for pending in (doc, ids, base, total, loss_from):
                pending.clear()

        for batch in batches:
            for part in slices(batch):
                keys = part.column("doc_id").to_pylist()
                flat, lengths = encode(path, *byte_view(part.column("text")), end)
                firsts = part.column("loss_from").to_pylist()
                at = 0
                for key, n, first in zip(keys, lengths.tolist(), firsts):
                    own = flat[at:at + n]
                    at += n
                    done = n - n % whole
                    for a in range(0, done, whole):
                        writer.sequence([(0, a, whole)], [key], [own], [0], [n], [first])
                    if done < n:
                        doc.append(key)
                        ids.append(own[done:].astype(np.uint16 if own.max() < 65536 else np.uint32))
                        base.append(done)
                        total.append(n)
                        loss_from.append(first)
                    if len(ids) >= limits.block:
                        pack()
                if len(writer.rows) > 20_000:
                    yield writer.batch()
        if ids:
            pack()
        yield writer.batch()

    return run


def pack(docs: DataFrame, path: str | None = None, end: int = END, limits: Limits = Limits(),
         loss_from: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their place in a sequence.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens. A null text is an empty one and has the id ``end`` only; a null doc_id is
    kept; rows that repeat are packed as documents of their own; other columns are not
    read. ``loss_from`` names a column with the first token position that bears loss
    (default and null: 0). An empty table gives no rows. Blocks are packed inside the
    task that read them, so memory is bounded and nothing is shuffled; the last sequence
    of a block is cut into powers of two, which need no padding.
    """
    first = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0)
    frame = id_and_text(docs, first.cast("long").alias("loss_from"))
    return frame.mapInArrow(packer(vocabulary_path(path), end, limits), SCHEMA)


def op10_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents")).drop("loss_tokens")


QUERIES = {"op10_packing": op10_packing}
ORACLE: dict[str, str] = {}
