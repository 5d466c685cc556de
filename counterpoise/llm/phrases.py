"""Phrases whose words stand together more often than apart, by sorting suffixes of words.

A suffix is a word's place with the words that follow it in the piece, DEPTH of them at
most; a word is a 64-bit symbol. Suffixes are routed by their two leading words, so all
that share them are in one task, which sorts its suffix pointers by multikey three-way
quicksort: partitions are split by one symbol into less, equal and greater, equal ones go
one word deeper. The size of an equal partition is the count of its words; partitions
smaller than the least count are abandoned at once.

What keeps this whole and small: equal suffixes of a slice of text travel once with their
number. Suffixes stop before words that occur too rarely by a bit map of fixed size. Where
both leading words are very frequent, their pairs travel as mere numbers, and the longer
suffixes are routed by all their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count as numbers

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import (
    SLICE_BYTES,
    byte_view,
    mixed,
    powers,
    ranges,
    run_hash,
    slices,
    stored,
    table,
)

#: Words of the longest phrase.
DEPTH = 3

LEAST, TOP, SHARE = 10, 2000, 50

#: Bytes of text whose equal suffixes are merged before they travel.
MERGED_BYTES = 4 << 20

#: Suffixes that a task sorts at a time, about.
SORTED = 1 << 19

#: Parts of a language's phrases that are ranked by themselves first.
RANKED_PARTS = 64

#: Occurrences from which a word counts as very frequent.
HOT = 1 << 20

#: Bits of a symbol that choose its place in the maps of rare and of very frequent words.
RARE_BITS, HOT_BITS = 26, 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lower-cased texts one after the other: where words start and end, the text and the
    piece that each lies in."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.flatnonzero(_BREAK[data])
    return starts, stops, text, np.searchsorted(breaks, starts) + text


def symbols_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    """64-bit symbols of the words, another hash for each ``seed``."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed))
    out = np.empty(len(starts), np.uint64)
    edges = np.flatnonzero(np.diff(starts // SLICE_BYTES)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)]):
        if a < b:
            first, last = starts[a], stops[b - 1]
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(values[data[first:last]] * powers(int(last - first))[0][:last - first], out=sums[1:])
            out[a:b] = run_hash(sums, starts[a:b] - first, stops[a:b] - first)
    return out


def _tokens(part: pa.RecordBatch, seed: int) -> tuple[np.ndarray, ...]:
    data, offsets = byte_view(part.column("text"))
    data = _LOWER[data]
    starts, stops, text, piece = words_of(data, offsets)
    tongue = part.column("tongue").to_numpy().view(np.uint64)
    symbols = mixed(symbols_of(data, starts, stops, seed) ^ tongue[text])
    symbols[symbols == 0] = 1  # 0: no word
    return data, starts, stops, text, piece, symbols


def _read(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("tongue"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def vocabulary(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, symbol, n of every different word of a language, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=MERGED_BYTES):
                data, starts, stops, text, _, symbols = _tokens(part, seed)
                symbol, first, n = np.unique(symbols, return_index=True, return_counts=True)
                size = stops[first] - starts[first]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                raw = data[ranges(starts[first], size)].tobytes()
                word = pa.StringArray.from_buffers(
                    len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(text[first])), word,
                     pa.array(symbol.view(np.int64)), pa.array(n)], ["lang", "word", "symbol", "n"])

    found = _read(docs).mapInArrow(run, "lang string, word string, symbol long, n long")
    return stored(found.groupBy("symbol", "lang", "word").agg(F.sum("n").alias("n")), "words")


def _slot(symbol: str, bits: int) -> Column:
    return F.shiftrightunsigned(symbol, 64 - bits)


def _frequent_map(words: DataFrame, least: int) -> np.ndarray:
    """2^RARE_BITS bits, set where a word of at least ``least`` occurrences falls. It is made
    in blocks of 2^16 bits, so only the map itself comes to the driver."""
    def mark(found: pa.Table) -> pa.Table:
        slot = found.column("slot").to_numpy()
        bits = np.zeros(1 << 16, bool)
        bits[slot & 0xFFFF] = True
        return pa.table({"block": pa.array([int(slot[0] >> 16)], pa.int64()),
                         "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = words.filter(F.col("n") >= least).select(_slot("symbol", RARE_BITS).alias("slot"))
    blocks = slots.withColumn("_block", F.shiftright("slot", 16)).groupBy("_block").applyInArrow(
        mark, "block long, bits binary")
    out = np.zeros((1 << RARE_BITS - 16, 1 << 13), np.uint8)
    for block, bits in blocks.collect():
        out[block] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _hot_map(words: DataFrame) -> np.ndarray:
    """One byte for each of 2^HOT_BITS slots: whether a very frequent word falls there."""
    out = np.zeros(1 << HOT_BITS, bool)
    hot = words.filter(F.col("n") >= HOT).select(_slot("symbol", HOT_BITS).alias("slot")).distinct()
    for (slot,) in hot.collect():
        out[slot] = True
    return out


SUFFIXES = "kind int, part int, first binary, second binary, third binary, times binary"


def routed_suffixes(docs: DataFrame, seed: int, parts: int, frequent: Broadcast, hot: Broadcast) -> DataFrame:
    """Suffixes of at least two words, those of a slice and a part in one row. Kind 0 is
    routed by two words (third 0: the suffix ends), kind 1 by three."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size=MERGED_BYTES):
                yield from _routed(part, seed, parts, frequent.value, hot.value)

    return _read(docs).mapInArrow(run, SUFFIXES)


def _routed(part: pa.RecordBatch, seed: int, parts: int, frequent: np.ndarray,
            hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    piece, symbols = _tokens(part, seed)[-2:]
    if len(symbols) < DEPTH:  # so that the steps below need no cases
        piece = np.concatenate([piece, -1 - np.arange(DEPTH)])
        symbols = np.concatenate([symbols, np.zeros(DEPTH, np.uint64)])
    slot = (symbols >> np.uint64(64 - RARE_BITS)).astype(np.int64)
    known = (frequent[slot >> 3] << (slot & 7).astype(np.uint8) & 128) > 0
    joined = (piece[1:] == piece[:-1]) & known[1:] & known[:-1]
    at = np.flatnonzero(joined)
    one, two = symbols[at], symbols[at + 1]
    none = np.uint64(0)
    three = np.where(np.append(joined, [False, False])[at + 1], np.append(symbols, none)[at + 2], none)
    both = hot[(one >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
    both &= hot[(two >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
    pair = mixed(one * np.uint64(0x9E3779B97F4A7C15) + two)
    longer = both & (three > 0)
    kinds = [(0, one, two, np.where(both, none, three), pair),
             (1, one[longer], two[longer], three[longer], mixed(pair[longer] ^ three[longer]))]
    for kind, a, b, c, route in kinds:
        if not len(a):
            continue
        turn = np.lexsort((c, route))
        a, b, c, route = a[turn], b[turn], c[turn], route[turn]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(a))).astype(np.uint32)
        a, b, c = a[first], b[first], c[first]
        to = ((route[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        edge = np.flatnonzero(np.diff(to)) + 1
        edge = [0, *edge.tolist(), len(to)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * (len(edge) - 1), pa.int32()), pa.array(to[edge[:-1]])]
            + [pa.array([x[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())
               for x in (a, b, c, times)], [c.split()[0] for c in SUFFIXES.split(", ")])


def sorted_counts(symbols: np.ndarray, times: np.ndarray, least: int) -> Iterator[tuple]:
    """(depth, pointers, counts) of the prefixes of two words and more that occur at least
    ``least`` times, by multikey three-way quicksort of pointers to suffixes.

    symbols[d] holds the symbols at depth d, 0 where a suffix has ended; times says for how
    many places a suffix stands. All partitions of a round are split side by side.
    """
    depths = len(symbols)
    pointer = np.arange(symbols.shape[1])
    size, depth = np.array([len(pointer)]), np.zeros(1, np.int64)
    while len(pointer):
        owner = np.repeat(np.arange(len(size)), size)
        begin = np.cumsum(size) - size
        key = symbols[depth[owner], pointer]
        pivot = key[begin + size // 2]
        side = (key >= pivot[owner]).astype(np.int64) + (key > pivot[owner])
        target = 3 * owner + side  # less, equal, greater
        held = np.bincount(target, minlength=3 * len(size))
        weight = np.bincount(target, weights=times[pointer], minlength=3 * len(size)).astype(np.int64)
        edge = np.cumsum(held) - held
        place = np.empty(len(pointer), np.int64)
        for k in range(3):  # the place of each pointer in its new partition, order kept
            mine = np.flatnonzero(side == k)
            sums = held[k::3]
            place[mine] = np.arange(len(mine)) - np.repeat(np.cumsum(sums) - sums, sums) + np.repeat(
                edge[k::3], sums)
        moved = np.empty_like(pointer)
        moved[place] = pointer
        equal = np.arange(3 * len(size)) % 3 == 1
        deeper = np.repeat(depth, 3) + equal
        ended = equal & (np.repeat(pivot, 3) == 0)
        open_ = (held > 0) & (weight >= least) & ~ended
        found = np.flatnonzero(open_ & equal & (deeper >= 2))
        for words in range(2, depths + 1):
            some = found[deeper[found] == words]
            if len(some):
                yield words, moved[edge[some]], weight[some]
        open_ &= deeper < depths
        pointer = moved[np.repeat(open_, held)]
        size, depth = held[open_], deeper[open_]


COUNTS = "words int, w1 long, w2 long, w3 long, a long"


def phrase_counts(suffixes: DataFrame, least: int = LEAST) -> DataFrame:
    """words, w1, w2, w3 (0: none) and a of every phrase that occurs ``least`` times, stored."""
    names = ("first", "second", "third")
    rows = suffixes.repartition("kind", "part").sortWithinPartitions("kind", "part")

    def count(kind: int, held: dict) -> pa.RecordBatch:
        symbols = np.stack([np.frombuffer(b"".join(held[c]), np.uint64) for c in names])
        times = np.frombuffer(b"".join(held["times"]), np.uint32).astype(np.int64)
        out = [np.empty((0, 5), np.int64)]
        for words, at, n in sorted_counts(symbols, times, least):
            if words > 2 or not kind:
                third = symbols[2, at] if words > 2 else np.zeros(len(at), np.uint64)
                out.append(np.stack([np.full(len(at), words), *(x.view(np.int64) for x in (
                    symbols[0, at], symbols[1, at], third)), n], 1))
        found = np.concatenate(out)
        return pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0].astype(np.int32)), *(pa.array(found[:, k].copy()) for k in range(1, 5))],
            [c.split()[0] for c in COUNTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in (*names, "times")}
        last = None
        for batch in batches:
            for kind, part, *raw in zip(*(batch.column(c).to_pylist() for c in (
                    "kind", "part", *names, "times"))):
                if last is not None and last != (kind, part):
                    yield count(last[0], held)
                    held = {c: [] for c in held}
                last = kind, part
                for c, x in zip(held, raw):
                    held[c].append(x)
        if last is not None:
            yield count(last[0], held)

    return stored(rows.mapInArrow(run, COUNTS), "phrases")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in whole numbers of up to 38 digits."""
    return F.expr(f"(cast(1000000 AS decimal(38,0)) * cast({a} AS decimal(19,0)) "
                  f"* cast({a} AS decimal(19,0))) div (cast({left} AS decimal(19,0)) "
                  f"* cast({right} AS decimal(19,0)))")


def scored(counts: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, w1, w2, w3, a, l, r, score of every candidate; l and r of the cut with
    the lowest score, the first of several."""
    pairs = counts.filter("words = 2").select("w1", "w2", "a")
    known = words.select("symbol", "lang", "word", "n")

    def word(rows: DataFrame, k: int) -> DataFrame:
        one = known.select(F.col("symbol").alias(f"w{k}"), F.col("word").alias(f"t{k}"),
                           F.col("n").alias(f"f{k}"), *(["lang"] if k == 1 else []))
        return rows.join(one, f"w{k}")

    two = word(word(pairs, 1), 2).select(
        "lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "w1", "w2",
        F.lit(0).cast("long").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score("a", "f1", "f2").alias("score"))
    three = (counts.filter("words = 3").select("w1", "w2", "w3", "a")
             .join(pairs.withColumnRenamed("a", "f12"), ["w1", "w2"])
             .join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"),
                                F.col("a").alias("f23")), ["w2", "w3"]))
    three = word(word(word(three, 1), 2), 3)
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "w1", "w2", "w3", "a",
        F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"))
    return two.unionByName(three)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut at .,;:!? and line ends into pieces, those at blanks
    and tabs into words. Candidates are phrases of two or three words that occur at least
    ``least`` times in pieces; one whose words lie in a longer candidate with ``share``
    percent of its count goes. A null lang is ``und``, a null text empty; rows that repeat
    count each; other columns are not read; an empty table gives no rows.
    """
    for seed in numbers():
        words = vocabulary(docs, seed)
        if words.groupBy("symbol").count().filter("count > 1").isEmpty():
            break  # else two words have one symbol: another hash
    total = words.agg(F.sum("n")).first()[0] or 0
    context = docs.sparkSession.sparkContext
    maps = [context.broadcast(m) for m in (_frequent_map(words, least), _hot_map(words))]
    parts = max(1, -(-total // SORTED))
    counts = phrase_counts(routed_suffixes(docs, seed, parts, *maps), least)
    found = stored(scored(counts, words.filter(F.col("n") >= least)), "candidates")
    three = found.filter("w3 != 0")
    inside = (three.select("w1", "w2", "a").unionByName(
        three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2").agg(F.max("a").alias("longer")))
    two = found.filter("w3 = 0").join(inside, ["w1", "w2"], "left")
    two = two.filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    kept = two.unionByName(three)  # first the best of each of some parts of a language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_PARTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*best)
    ranked = kept.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
    sizes = words.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n"))
    return ranked.join(sizes, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM pieces),
places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
suffixes AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM places),
f1 AS (SELECT lang, a, count(*) AS f FROM suffixes GROUP BY lang, a),
f2 AS (SELECT lang, a, b, count(*) AS f FROM suffixes WHERE b IS NOT NULL GROUP BY lang, a, b),
f3 AS (SELECT lang, a, b, c, count(*) AS f FROM suffixes WHERE c IS NOT NULL GROUP BY lang, a, b, c
  HAVING count(*) >= 10),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
two AS (
  SELECT p.lang, p.a, p.b, p.f, x.f AS l, y.f AS r,
    (1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.a = p.a JOIN f1 y ON y.lang = p.lang AND y.a = p.b
  WHERE p.f >= 10),
cuts AS (
  SELECT p.lang, p.a, p.b, p.c, p.f, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
    (1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * yz.f))::BIGINT AS s1,
    (1000000::HUGEINT * p.f * p.f // (xy.f::HUGEINT * z.f))::BIGINT AS s2
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.a = p.a
  JOIN f2 yz ON yz.lang = p.lang AND yz.a = p.b AND yz.b = p.c
  JOIN f2 xy ON xy.lang = p.lang AND xy.a = p.a AND xy.b = p.b
  JOIN f1 z ON z.lang = p.lang AND z.a = p.c),
inside AS (
  SELECT lang, a, b, max(f) AS longer FROM (
    SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY lang, a, b),
kept AS (
  SELECT t.lang, t.a || ' ' || t.b AS phrase, t.f AS a, l, r, score
  FROM two t LEFT JOIN inside i ON i.lang = t.lang AND i.a = t.a AND i.b = t.b
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * t.f
  UNION ALL
  SELECT lang, a || ' ' || b || ' ' || c, f, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END,
    CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM cuts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

QUERIES = {"op11_phrases": op11_phrases}
ORACLE = {"op11_phrases": SQL}
