"""SimHash near-duplicates: exact search of fingerprints within a few bits.

Fingerprints of equal value are one. Two that differ in few bits agree in all but few
blocks of bits, so rows meet under the values of the blocks they could agree in. The rows
of a task, sorted by block values and then by their number of set bits, are compared tile
against tile with exclusive-or and bit counts; tile pairs whose bit numbers lie further
apart than the radius are skipped. Links are reduced to a spanning forest in the task
and joined to components by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import byte_view, id_and_text, slices, stored, table
from counterpoise.llm.components import components, linked_rows

SHINGLE, RADIUS, SEED = 3, 3, 42

#: Rows of a tile.
TILE = 256

#: Rows under one value of the blocks that a task compares; more are cut into parts, and
#: every pair of parts is a task's work of its own.
GROUP = 8192

#: Distinct fingerprints up to which four blocks are used, then five, then six.
PER_BLOCKS = {4: 1 << 25, 5: 1 << 34}


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, as ``fingerprints`` gives it."""
    data = np.frombuffer(text, np.uint8)
    return int(fingerprints(data, np.array([0, len(data)]), shingle)[0])


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts that lie one after the other."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(offsets) - 1, np.uint64)
    raw = data.tobytes()
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        words = raw[a:b].lower().split()
        if not words:
            continue
        n = max(1, len(words) - shingle + 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
        ends = ends[min(shingle, len(words)) - 1:].tolist()
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 1 << 15):
            h = np.array([xxh64_intdigest(joined[x:y], SEED) for x, y in zip(
                starts[k:k + (1 << 15)], ends[k:k + (1 << 15)])], np.uint64)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def close_rows(group: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Smallest row linked to each row. Rows link if their group is equal and their prints
    differ in at most ``radius`` bits; they are sorted by group, then by set bits."""
    n = len(prints)
    ones = np.bitwise_count(prints).astype(np.int64)
    root = np.arange(n)
    for a in range(0, n, TILE):
        last = min(a + TILE, n)
        x, own, mine = prints[a:last, None], group[a:last], ones[a:last]
        single = own[0] == own[-1]
        for b in range(a, n, TILE):
            other = group[b:b + TILE]
            if other[0] > own[-1]:
                break
            if single and other[-1] == own[0] and ones[b] - mine[-1] > radius:
                break  # the further tiles of the group have more bits set still
            near = np.bitwise_count(x ^ prints[None, b:b + TILE]) <= radius
            if not (single and other[0] == other[-1]):
                near &= own[:, None] == other[None, :]
            i, j = np.nonzero(near)
            apart = i + a < j + b
            root = linked_rows(n, i[apart] + a, j[apart] + b, root) if apart.any() else root
    return root


def block_masks(blocks: int, radius: int) -> list[int]:
    """For every choice of ``blocks - radius`` blocks, the bits they cover."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    one = [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(blocks)]
    return [sum(one[k] for k in c) for c in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between distinct ``print`` values within ``radius`` bits: not all of
    them, but enough that every pair within the radius is joined by a path."""
    if blocks is None:
        n = prints.count()
        blocks = next((b for b, most in PER_BLOCKS.items() if n <= most), 6)
        blocks = max(blocks, radius + 1)
    masks = block_masks(blocks, radius)
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(_signed(m))))
                     for k, m in enumerate(masks)))
    rows = prints.select("print", F.explode(keys).alias("block"))
    parts = (rows.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP)
             .select("block", F.ceil(F.col("n") / (GROUP // 2)).cast("int").alias("parts")))
    rows = rows.join(parts, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("print", F.lit(1)), F.col("parts")).cast("int"))
    partner = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own")))
    rows = rows.withColumn("partner", F.explode(partner))
    group = F.when(F.col("parts") == 1, F.col("block")).otherwise(
        F.xxhash64("block", F.least("own", "partner"), F.greatest("own", "partner")))
    rows = rows.select(group.alias("grp"), "print").repartition("grp")
    rows = rows.sortWithinPartitions("grp", F.bit_count("print"), "print")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(group: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            root = close_rows(group, own.view(np.uint64), radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays(
                [pa.array(own[linked]), pa.array(own[root[linked]])], ["a", "b"])

        for batch in batches:
            held_group = np.concatenate([held_group, batch.column("grp").to_numpy()])
            held = np.concatenate([held, batch.column("print").to_numpy()])
            if len(held) >= 16 * GROUP:  # all but the last group, which may go on
                whole = int(np.searchsorted(held_group, held_group[-1]))
                yield found(held_group[:whole], held[:whole])
                held_group, held = held_group[whole:], held[whole:]
        if len(held):
            yield found(held_group, held)

    return rows.mapInArrow(link, "a long, b long").filter("a != b")


def simhash_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, txt, print): hash of the text and the fingerprint of every row's whole text,
    as signed longs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = fingerprints(*byte_view(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("txt"), pa.array(prints.view(np.int64))],
                    ["doc_id", "txt", "print"])

    rows = id_and_text(docs).withColumn("txt", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, txt long, print long")


def rooted(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``prints`` (print and more, one row each) with ``root``, the name of its component."""
    roots = components(near_links(prints.select("print"), radius, blocks))
    return prints.join(roots, prints["print"] == roots["node"], "left").select(
        *(prints[c] for c in prints.columns), F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``radius`` bits reach, the
    own one included. A null text is empty; texts without words have fingerprint zero and
    link like any other. Rows that repeat come back each; a null doc_id never is a
    component's id unless the component has no other (then it is null). Other columns are
    not read; an empty table gives no rows.
    """
    rows = stored(simhash_table(docs, shingle), "simhash")
    classes = stored(rows.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    classes = rooted(classes, radius, blocks)
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(named, "root").select("print", "component_id")
    return rows.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs``, all its columns, with one document of each group: that with the smallest
    doc_id, null last, and of several with that id the one whose text has the least hash.

    Different texts under one id, and rows without an id, are documents of their own. Of
    rows that repeat both id and text one stays.
    """
    rows = stored(simhash_table(docs, shingle), "simhash")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "txt")
    classes = rooted(stored(rows.groupBy("print").agg(F.min(one).alias("first")), "prints"), radius)
    kept = classes.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("_id"), F.col("first.txt").alias("_text"))
    chosen = stored(rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("txt") == F.col("_text")))
                    .groupBy("_id", "_text").agg(F.count("*").alias("_copies")), "kept")
    marked = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["doc_id"].alias("_own"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    again = chosen.filter("_copies > 1")
    if again.isEmpty():
        out = marked.join(chosen, same, "left_semi")
    else:
        once = marked.join(again, same, "left_semi").dropDuplicates(["_own", "_hash"])
        out = marked.join(chosen.filter("_copies = 1"), same, "left_semi").unionByName(once)
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op8_simhash(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE: dict[str, str] = {}
