"""Removal of repeated byte strings with suffix arrays.

Every string of WINDOW bytes holds one anchor: the place of its least hashed gram, the
leftmost of several. The strings that have an anchor in common lie in its context, and
equal strings have equal anchors. So contexts are dealt to shards by the anchor's hash;
a context that occurs several times is there once, with its number. Each shard sorts the
suffixes of its contexts (Larsson-Sadakane refinement), takes common prefixes of
neighbours (Kasai's recurrence), and finds the strings that occur again. An anchor with
very many different contexts is cut into several shards; their sorted lists of strings are
merged by binary search. What is found goes back to all places of a context by a join.

The same search runs over words: a word is one symbol, a 64-bit hash, and a window is a
number of words, whatever their bytes and the white space between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.llm.common import (
    SLICE_BYTES,
    byte_view,
    id_and_text,
    mixed,
    prefix_hash,
    ranges,
    run_hash,
    slices,
    stored,
    table,
)

#: Bytes of a string that counts as repeated, and of the grams that choose its anchor.
WINDOW, GRAM = 400, 64

#: Words of a passage that counts as repeated, and of the grams that choose its anchor.
PASSAGE, PASSAGE_GRAM = 51, 8

#: Bytes of contexts that one suffix array covers.
SHARD_BYTES = 1 << 20

#: Contexts of one anchor that stay in one shard.
SHARD_CONTEXTS = 512

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
#: White space of several bytes, by its number of bytes, as little-endian numbers.
_WIDE = {size: [int.from_bytes(c, "little") for c in (
    chr(k).encode() for k in range(0x80, 0x3001) if chr(k).isspace()) if len(c) == size]
    for size in (2, 3)}
_LEAD = np.zeros(256, bool)
_LEAD[sorted({c & 255 for codes in _WIDE.values() for c in codes})] = True


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: where words start and end, and the first word of each
    text. Words are what str.split() gives."""
    blank = _BLANK[data]
    lead = np.flatnonzero(_LEAD[data])
    for size, codes in _WIDE.items():
        at = lead[lead + size <= len(data)]
        code = sum(data[at + k].astype(np.int64) << 8 * k for k in range(size))
        hit = at[np.isin(code, codes)]
        for k in range(size):
            blank[hit + k] = True
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def units(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What windows count in, bytes or hashes of words, and where each text's begin."""
    if not words:
        return data, offsets
    starts, stops, first = word_places(data, offsets)
    out = np.empty(len(starts), np.uint64)
    cuts = np.flatnonzero(np.diff(starts // SLICE_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(starts)]):
        if a < b:
            low, high = starts[a], stops[b - 1]
            out[a:b] = run_hash(prefix_hash(data[low:high]), starts[a:b] - low, stops[a:b] - low)
    return out, first


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``data`` (bytes or 64-bit symbols) in lexicographic order."""
    n = len(data)
    symbols = data.dtype == np.uint64
    key = data if symbols else words_at(data)
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    # suffixes that end inside the first eight bytes come before longer equal ones
    at = np.arange(n)
    depth = 1 if symbols else 0 if n < 8 or (data[-8:] == 0).any() else 8
    if not depth:
        order = np.argsort(data)
        first[1:] = data[order[1:]] != data[order[:-1]]
        rank[order] = np.maximum.accumulate(np.where(first, at, 0))
        depth = 1
    while True:
        last = np.append(first[1:], True)
        open_ = np.flatnonzero(~(first & last))  # places in groups of several suffixes
        if not len(open_):
            return order
        members = order[open_]
        beyond = members + depth
        second = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + second
        turn = np.argsort(key)
        members, key = members[turn], key[turn]
        order[open_] = members
        new = np.empty(len(open_), bool)
        new[:1] = True
        new[1:] = key[1:] != key[:-1]
        rank[members] = np.maximum.accumulate(np.where(new, open_, 0))
        first[open_] = new
        depth *= 2


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k:k + len(data)]
    return key


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common bytes or symbols of each suffix in ``order`` with the one before it (the first: 0).

    Where the bytes before both suffixes are equal, Kasai's recurrence gives one less than
    the value of the suffix one byte longer; only the others are compared byte by byte.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    own = np.ones(n, bool)
    at = np.arange(1, n)
    other = before[1:]
    own[1:] = (other <= 0) | (data[at - 1] != data[np.maximum(other, 1) - 1])
    start = np.flatnonzero(own)
    near = before[start]
    value = np.zeros(len(start), np.int64)
    symbols = data.dtype == np.uint64
    key = data if symbols else words_at(data)
    live = np.flatnonzero(near >= 0)
    while len(live):
        i, j = start[live] + value[live], near[live] + value[live]
        inside = (i < n) & (j < n)
        live, i, j = live[inside], i[inside], j[inside]
        differ = key[i] ^ key[j]
        same = differ == 0
        if symbols:
            value[live] += same
            live = live[same]
            continue
        bits = np.zeros(len(live), np.int64)
        some = differ[~same]
        high = np.frexp((some >> np.uint64(11)).astype(float))[1] + 11
        low = np.frexp((some & np.uint64(0x7FF)).astype(float))[1]
        bits[~same] = np.where(some >> np.uint64(11) > 0, high, low)
        value[live] += np.where(same, 8, (64 - bits) // 8)
        live = live[same]
    value = np.minimum(value, n - np.maximum(start, near))
    value[near < 0] = 0
    run = np.cumsum(own) - 1
    return (value[run] - (np.arange(n) - start[run]))[order]


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple:
    """Anchors of texts one after the other: text, start of the context in ``data``, strings
    that have the anchor, hash of its gram, hash of the context."""
    n = len(data)
    span = window - gram + 1
    starts = ranges(offsets[:-1], np.maximum(0, np.diff(offsets) - window + 1))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    sums = prefix_hash(data)
    place = np.arange(n - gram + 1)
    hashes = run_hash(sums, place, place + gram)
    rows = -(-len(hashes) // span)
    value = np.full(rows * span, np.iinfo(np.uint64).max)
    value[:len(hashes)] = (hashes >> np.uint64(32) << np.uint64(32)) | place.astype(np.uint64)
    blocks = value.reshape(rows, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + span - 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    begin, anchor = starts[first], anchor[first]
    count = np.diff(np.append(first, len(starts)))
    text = np.searchsorted(offsets, begin, side="right") - 1
    whole = run_hash(sums, begin, begin + count - 1 + window)
    context = mixed(whole ^ (anchor - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, begin, count, hashes[anchor], context


ANCHOR = "doc_id long, txt long, begin int, cnt int, h long, ctx long"

#: (window, gram) of strings of bytes and, if there are two, of runs of words. The lowest
#: bit of an anchor's hash says which it is.
Sizes = tuple[tuple[int, int], ...]


def anchor_table(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """One row per anchor of every text: where its context begins, how many strings it has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for words, (window, gram) in enumerate(sizes):
                    yield from found(part, bool(words), window, gram)

    def found(part: pa.RecordBatch, words: bool, window: int, gram: int) -> Iterator[pa.RecordBatch]:
        data, offsets = units(*byte_view(part.column("text")), words)
        for low in range(0, max(1, len(data) - window + 1), SLICE_BYTES):
            # a long text in blocks of starts; a context ends where its block does
            high = min(len(data), low + SLICE_BYTES + window - 1)
            inside = np.clip(offsets, low, high) - low
            text, begin, count, h, ctx = anchors(data[low:high], inside, window, gram)
            h = h & ~np.uint64(1) | np.uint64(words)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").take(pa.array(text)), part.column("txt").take(pa.array(text)),
                pa.array((begin + low - offsets[text]).astype(np.int32)),
                pa.array(count.astype(np.int32)), pa.array(h.view(np.int64)),
                pa.array(ctx.view(np.int64))], ["doc_id", "txt", "begin", "cnt", "h", "ctx"])

    return stored(docs.select("doc_id", "txt", "text").mapInArrow(run, ANCHOR), "anchors")


NEEDED = "h long, ctx long, n long, shards int, cnt int, bytes binary"


def context_bytes(docs: DataFrame, needed: DataFrame, sizes: Sizes) -> DataFrame:
    """The bytes of the contexts in ``needed``, each read from the row that it names."""
    lists = needed.groupBy("doc_id", "txt").agg(F.collect_list(F.struct(
        "h", "ctx", "n", "shards", "begin", "cnt")).alias("wanted"))
    joined = docs.select("doc_id", "txt", "text").join(lists.withColumnsRenamed({"doc_id": "_id", "txt": "_t"}),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("txt") == F.col("_t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = byte_view(part.column("text"))
                wanted = part.column("wanted")
                flat = wanted.flatten()
                row = np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy())
                words = (flat.field("h").to_numpy() & 1).astype(bool)
                begin = flat.field("begin").to_numpy() + offsets[row]
                size = flat.field("cnt").to_numpy() + sizes[0][0] - 1
                if words.any():
                    starts, stops, first = word_places(data, offsets)
                    place = flat.field("begin").to_numpy()[words] + first[row[words]]
                    last = place + flat.field("cnt").to_numpy()[words] + sizes[1][0] - 2
                    begin[words], size[words] = starts[place], stops[last] - starts[place]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [flat.field(c) for c in ("h", "ctx", "n", "shards", "cnt")] + [pa.array(
                        [raw[a:a + k] for a, k in zip(begin.tolist(), size.tolist())], pa.binary())],
                    [c.split()[0] for c in NEEDED.split(", ")])

    return joined.select("text", "wanted").mapInArrow(run, NEEDED)


def repeated(data: np.ndarray, begin: np.ndarray, count: np.ndarray, times: np.ndarray,
             window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts in one byte array: all their strings' places, which of them occur more
    than once, and their groups of equal strings (numbers in lexicographic order).

    Context k has strings at begin[k], begin[k]+1, ... and stands for times[k] places.
    """
    order = suffix_array(data)
    common = common_prefixes(data, order)
    group = np.empty(len(data), np.int64)
    group[order] = np.cumsum(common < window)
    place = ranges(begin, count)
    weight = np.repeat(times, count)
    total = np.bincount(group[place], weights=weight, minlength=int(group.max(initial=0)) + 1)
    return place, total[group[place]] >= 2, group[place]


SHARD = "h long, ctx long, spans array<int>, part int, keys binary, refs binary, places binary"


def _spans(flags: np.ndarray) -> list[int]:
    """first, beyond, first, beyond, ... of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.tolist()


def shard_search(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """What the suffix arrays of the shards find, stored.

    Rows with ``spans``: the strings of a context that occur again. Rows with ``keys``: for
    an anchor of several shards, the sorted hashes of one shard's different strings that
    fall in a part of the value range; ``refs`` and ``places`` name the strings that still
    lack a second place (refs of the others are not used).
    """
    rows = contexts.withColumn("own", F.pmod("ctx", F.col("shards")).cast("int"))
    rows = rows.withColumn("shard", F.xxhash64("h", "own")).repartition("shard")
    rows = rows.sortWithinPartitions("shard", "h", "ctx")

    def search(held: list) -> Iterator[pa.RecordBatch]:
        unique: dict[tuple, int] = {}
        for k, x in enumerate(held):  # rows that repeat in the documents come once
            unique.setdefault((x[0], x[1]), k)
        for words, (window, _) in enumerate(sizes):
            own = [held[k] for (h, _), k in unique.items() if h & 1 == words]
            if own:
                yield from searched(own, window, bool(words))

    def searched(held: list, window: int, words: bool) -> Iterator[pa.RecordBatch]:
        h, ctx, times, shards, count, raw = zip(*held)
        data, begin = units(np.frombuffer(b"".join(raw), np.uint8),
                            np.cumsum([0] + [len(r) for r in raw]), words)
        begin = begin[:-1]
        count, times = np.array(count, np.int64), np.array(times, np.int64)
        place, again, group = repeated(data, begin, count, times, window)
        edge = np.cumsum(count) - count
        out = []
        for k in range(len(held)):
            spans = _spans(again[edge[k]:edge[k] + count[k]])
            if spans:
                out.append((h[k], ctx[k], spans, None, None, None, None))
        owner = np.repeat(np.arange(len(held)), count)
        parts = np.array(shards, np.int64)
        split = parts[owner] > 1
        if split.any():
            sums = prefix_hash(data)
            chosen = np.flatnonzero(split)
            # one place of each group of equal strings stands for the shard
            chosen = chosen[np.unique(group[chosen], return_index=True)[1]]
            key = run_hash(sums, place[chosen], place[chosen] + window)
            anchor = np.array(h, np.int64)[owner[chosen]]
            part = ((key >> np.uint64(32)) * parts[owner[chosen]].astype(np.uint64)
                    >> np.uint64(32)).astype(np.int64)
            turn = np.lexsort((key, part, anchor))
            chosen, key, anchor, part = chosen[turn], key[turn], anchor[turn], part[turn]
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
            mine = np.array(ctx, np.int64)[owner[chosen]]
            where = np.where(again[chosen], -1, (place[chosen] - begin[owner[chosen]]))
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chosen)]):
                out.append((int(anchor[a]), None, None, int(part[a]), key[a:b].tobytes(),
                            mine[a:b].tobytes(), where[a:b].astype(np.int32).tobytes()))
        yield _batch(out, SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            names = ("h", "ctx", "n", "shards", "cnt", "bytes", "shard")
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if size >= SHARD_BYTES and row[-1] != last:
                    yield from search(held)
                    held, size = [], 0
                held.append(row[:-1])
                size += len(row[5])
                last = row[-1]
        if held:
            yield from search(held)

    return stored(rows.drop("own").mapInArrow(run, SHARD), "repeats")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)],
        [name for name, _ in fields])


def merged(found: DataFrame) -> DataFrame:
    """Strings that lack a second place in their shard and have one in another shard of the
    anchor: (h, ctx, spans). The sorted lists of a part meet; each is looked up by binary
    search in all of them."""
    lists = (found.filter("keys IS NOT NULL").select("h", "part", "keys", "refs", "places")
             .repartition("h", "part").sortWithinPartitions("h", "part"))

    def meet(h: int, runs: list[tuple]) -> list[tuple]:
        every = np.sort(np.concatenate([k for k, _, _ in runs]))
        out = []
        for key, ref, place in runs:
            several = np.searchsorted(every, key, "right") - np.searchsorted(every, key, "left") > 1
            several &= place >= 0
            turn = np.lexsort((place[several], ref[several]))
            ref, place = ref[several][turn], place[several][turn]
            cuts = np.flatnonzero(np.diff(ref)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ref)]):
                if a < b:
                    spans = np.stack([place[a:b], place[a:b] + 1], 1).ravel().tolist()
                    out.append((h, int(ref[a]), spans))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        schema = "h long, ctx long, spans array<int>"
        for batch in batches:
            for h, part, keys, refs, places in zip(*(batch.column(c).to_pylist() for c in (
                    "h", "part", "keys", "refs", "places"))):
                if held and (h, part) != last:
                    yield _batch(meet(last[0], held), schema)
                    held = []
                held.append((np.frombuffer(keys, np.uint64), np.frombuffer(refs, np.int64),
                             np.frombuffer(places, np.int32)))
                last = h, part
        if held:
            yield _batch(meet(last[0], held), schema)

    return lists.mapInArrow(run, "h long, ctx long, spans array<int>")


def repeated_spans(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(doc_id, txt, begin, spans, words) of the strings of ``docs`` (doc_id, txt, text) that
    occur again; starts, in bytes or words, are begin + first ... begin + beyond - 1."""
    every = anchor_table(docs, sizes)
    shared = every.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select("h")
    places = stored(every.join(shared, "h", "left_semi"), "places")
    contexts = stored(places.groupBy("h", "ctx").agg(
        F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("doc_id", "txt", "begin", "cnt"))),
        "contexts")
    shards = contexts.groupBy("h").agg(
        F.ceil(F.count("*") / SHARD_CONTEXTS).cast("int").alias("shards"))
    found = shard_search(context_bytes(docs, contexts.join(shards, "h"), sizes), sizes)
    spans = stored(found.filter("spans IS NOT NULL").select("h", "ctx", "spans")
                   .unionByName(merged(found)), "spans")
    return places.join(spans, ["h", "ctx"]).select(
        "doc_id", "txt", "begin", "spans", (F.col("h").bitwiseAND(F.lit(1)) == 1).alias("words"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``found``, an array of what ``spans`` has for a row besides its keys.

    Rows that repeat wholly have one another's spans; they are listed once.
    """
    rest = [c for c in spans.columns if c not in ("doc_id", "txt")]
    lists = (spans.groupBy("doc_id", "txt").agg(F.collect_set(F.struct(*rest)).alias("found"))
             .withColumnsRenamed({"doc_id": "_id", "txt": "_t"}))
    return docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id"))
                     & (F.col("txt") == F.col("_t")), "left").drop("_id", "_t")


def _united(first: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the ranges first ... beyond - 1 cover, in order."""
    if not len(first):
        return first, beyond
    turn = np.argsort(first, kind="stable")
    first, reach = first[turn], np.maximum.accumulate(beyond[turn])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    start = np.flatnonzero(new)
    return first[start], reach[np.append(start[1:], len(first)) - 1]


@dataclass
class Spans:
    """The column ``found`` of a batch of rows, as ranges of starts for each row."""

    row: np.ndarray    # first range of each row, and beyond the last
    words: np.ndarray  # per range
    first: np.ndarray
    beyond: np.ndarray

    @classmethod
    def of(cls, found: pa.Array) -> Spans:
        flat = found.flatten()
        many = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        spans = flat.field("spans")
        size = spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) // 2
        edge = spans.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
        edge += np.repeat(flat.field("begin").to_numpy().astype(np.int64), size)[:, None]
        words = np.repeat(flat.field("words").to_numpy(zero_copy_only=False).astype(bool), size)
        ends = np.concatenate([[0], np.cumsum(size)])
        return cls(ends[np.concatenate([[0], np.cumsum(many)])], words, edge[:, 0], edge[:, 1])

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = slice(self.row[k], self.row[k + 1])
        return self.words[at], self.first[at], self.beyond[at]


def kept_bytes(raw: bytes, first: np.ndarray, beyond: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without ranges of bytes, and the number of maximal runs of them."""
    if not len(first):
        return raw, 0
    first, beyond = _united(first, beyond)
    gaps = zip([0, *beyond.tolist()], [*first.tolist(), len(raw)])
    return b"".join(raw[i:j] for i, j in gaps), len(first)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, txt (a hash that stands for the text) and text of every row."""
    rows = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", F.xxhash64("text").alias("txt"), "text")


DIGEST = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "n_passage_words long, n_passages long")


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, passage: int = PASSAGE,
            passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``, and
    n_passage_words, n_passages.

    Removed is each byte that a string of ``window`` bytes covers which starts at another
    place too, in the same text or any other; all places are judged on the input. The last
    two say how many words lie in runs of ``passage`` words that come again, however few
    bytes these have, and in how many maximal runs; nothing is removed for them. A null
    text is empty; rows that repeat hold each other's strings; a null doc_id is kept; other
    columns are not read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_view(batch.column("text"))
            spans, out = Spans.of(batch.column("found")), []
            for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                raw = data[a:b].tobytes()
                words, first, beyond = spans[k]
                kept, runs = kept_bytes(raw, first[~words], beyond[~words] + window - 1)
                first, beyond = _united(first[words], beyond[words] + passage - 1)
                out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(),
                            int((beyond - first).sum()), len(first)))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.string() if k == 3 else pa.int64())
                                           for k, c in enumerate(columns))],
                [c.split()[0] for c in DIGEST.split(", ")])

    rows = _keyed(docs)
    spans = repeated_spans(rows, ((window, gram), (passage, min(passage, passage_gram))))
    return with_spans(rows, spans).select("doc_id", "text", "found").mapInArrow(run, DIGEST)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    passage: int = 0, passage_gram: int = PASSAGE_GRAM) -> DataFrame:
    """``docs``, all its rows and columns, with the repeated strings taken out of ``text``.

    With ``passage``, repeated runs of so many words go as well, however few bytes they
    have; both are judged on the input. White space around a run of words stays.
    Bytes of a character that is cut in part go with it; ``n_chars``, if there, is counted
    anew where a text changes; a null text stays null.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text").isNull().alias("none"),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("txt", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, at = byte_view(part.column("text"))
                spans, texts = Spans.of(part.column("found")), []
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    raw = data[a:b].tobytes()
                    words, first, beyond = spans[k]
                    if words.any():
                        starts, stops, _ = word_places(data[a:b], np.array([0, b - a]))
                    beyond = np.concatenate([beyond[~words] + window - 1, stops[
                        beyond[words] + passage - 2] if words.any() else beyond[:0]])
                    first = np.concatenate([first[~words], starts[first[words]] if words.any() else first[:0]])
                    texts.append(kept_bytes(raw, first, beyond)[0].decode(errors="ignore"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("none"), pa.array(texts, pa.string()),
                     part.column("found").is_valid()], ["row", "none", "text", "cut"])

    schema = T.StructType([rows.schema["row"], rows.schema["none"], rows.schema["text"],
                           T.StructField("cut", T.BooleanType())])
    sizes: Sizes = ((window, gram),)
    if passage:
        sizes += ((passage, min(passage, passage_gram)),)
    spans = repeated_spans(rows, sizes)
    out = with_spans(rows, spans).select("row", "none", "text", "found").mapInArrow(run, schema)
    columns = {c: F.col("row")[c] for c in others}
    columns["text"] = F.when(~F.col("none"), F.col("text"))
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("cut"), F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def op1_suffix_dedup(spark, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE: dict[str, str] = {}
