"""Join of n-gram sets by Jaccard similarity, through prefix trees.

1. Survey. Each task hashes the shingles of its texts and asks the owners of the hash space
   which of them occur in no other text. A text with more such shingles than a likeness
   leaves room for has no partner; only the others go on, once for each different set.
2. Postings. Shingles are ordered, the rarest first. Of two alike sets, each has one of the
   other's shingles so early that enough can follow; only these places are posted. Sets
   that share postings, directly or by others, form a bundle.
3. Prefix tree. A task stores the sets of a bundle in a trie, the most frequent shingles
   first, and walks it with blocks of sets. The overlap with a path is shared by all sets
   below; a subtree is left when what remains of both, or the lengths below it, cannot
   reach the threshold, or when all of it is already joined to the set.

Bundles beyond a task's bounds are taken apart into their postings, and large postings into
parts: first random parts, which join what is dense; then whatever has another component
than most of its posting meets every part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import byte_view, id_and_text, mixed, slices, stored, table
from counterpoise.llm.components import components, linked_rows
from counterpoise.llm.phrases import symbols_of

#: Words of a shingle; percent of the union that two alike sets share.
SHINGLE, SHARE = 4, 85

#: Bytes of text that ask together, and bytes of text for each owner of a part of the hashes.
ASKING_BYTES, OWNED_BYTES = 2 << 20, 24 << 20

#: Bits of a hash that an owner tells apart; two hashes in one slot count as the same.
SLOT_BITS = 24

#: Sets, and shingles of all sets together, that a task compares.
SETS, SHINGLES = 4096, 4 << 20

#: Sets up to which their names travel to every task (8 bytes each).
BROADCAST_SETS = 1 << 20

#: Bytes of the table in which a block of sets looks up shingles, and sets of a block.
BLOCK_BYTES, BLOCK_SETS = 64 << 20, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple:
    """(text, hash) of the different shingles of texts one after the other, in order."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    text = np.searchsorted(offsets, starts, side="right") - 1
    symbols = symbols_of(data, starts, stops, 0)
    n = len(symbols)
    many = np.bincount(text, minlength=len(offsets) - 1)
    left = (np.cumsum(many)[text] - np.arange(n)) if n else np.empty(0, np.int64)  # words from here on
    short = many[text] < words
    h = symbols.copy()
    for k in range(1, words):
        more = left > k
        at = np.minimum(np.arange(n) + k, max(n - 1, 0))
        h = np.where(more, mixed(h * np.uint64(0x9E3779B97F4A7C15) + symbols[at] + np.uint64(k)), h)
    whole = np.zeros(n, bool)
    whole[(np.cumsum(many) - many)[many > 0]] = True
    keep = np.where(short, whole, left >= words)
    text, h = text[keep], h[keep]
    turn = np.lexsort((h, text))
    text, h = text[turn], h[turn]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def _class_of(text: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit name of the set of each text."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(0xA5A5A5A5)))])
    edge = np.searchsorted(text, np.arange(rows + 1))
    size = np.diff(edge).astype(np.uint64)
    return mixed((sums[edge[1:]] - sums[edge[:-1]]) ^ (size * np.uint64(0xD6E8FEB86659FD93)))


SURVEY = ("part int, slice long, row int, doc_id long, txt long, cls long, n long, "
          "slots binary, owners binary, known binary")


def _packed(slots: np.ndarray) -> bytes:
    return slots.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16


def _survey(docs: DataFrame, parts: int, words: int) -> DataFrame:
    """A row for each text (part -1) and one for what a slice of texts asks each part."""
    names = [c.split()[0] for c in SURVEY.split(", ")]

    def ask(part: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
        text, h = shingle_sets(*byte_view(part.column("text")), words)
        rows = part.num_rows
        cls = _class_of(text, h, rows).view(np.int64)
        size = np.bincount(text, minlength=rows)
        none = pa.nulls(rows, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, -1, np.int32)), pa.array(np.full(rows, number)),
             pa.array(np.arange(rows, dtype=np.int32)), part.column("doc_id"), part.column("txt"),
             pa.array(cls), pa.array(size), none, none, none], names)
        turn = np.argsort(h, kind="stable")
        text, h = text[turn], h[turn]
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = h[1:] != h[:-1]
        single = new[:-1] & new[1:]
        first = new[:-1] & ~new[1:]
        owner = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        slot = (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        out = []
        edge = np.searchsorted(owner, np.arange(parts + 1))
        for k in np.unique(owner).tolist():
            at = slice(edge[k], edge[k + 1])
            one = single[at]
            mine, whose = slot[at][one], text[at][one]
            turn = np.argsort(whose, kind="stable")
            out.append((k, _packed(mine[turn]), whose[turn].astype(np.uint32).tobytes(),
                        _packed(slot[at][first[at]])))
        if out:
            to, slots, owners, known = zip(*out)
            empty = [pa.nulls(len(to), t) for t in (pa.int32(), *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array([number] * len(to), pa.int64()), *empty,
                 *(pa.array(x, pa.binary()) for x in (slots, owners, known))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, size=ASKING_BYTES):
                yield from ask(part, number)
                number += 1

    rows = id_and_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                    F.xxhash64("text").alias("txt"))
    return stored(rows.mapInArrow(run, SURVEY), "survey")


def _answers(survey: DataFrame) -> DataFrame:
    """slice, owners, alone: how many shingles of a text no other text has, by part."""
    asked = (survey.filter("part >= 0").select("part", "slice", "slots", "owners", "known")
             .repartition("part").sortWithinPartitions("part"))
    names = ["slice", "owners", "alone"]

    def answer(held: list[tuple]) -> pa.RecordBatch:
        count = np.bincount(_unpacked(b"".join(x[1] for x in held)), minlength=1 << SLOT_BITS)
        seen = np.minimum(count, 2).astype(np.int8)
        seen[_unpacked(b"".join(x[3] for x in held))] = 2
        out = []
        for number, slots, owners, _ in held:
            alone = seen[_unpacked(slots)] == 1
            whose, n = np.unique(np.frombuffer(owners, np.uint32)[alone], return_counts=True)
            if len(whose):
                out.append((number, whose.tobytes(), n.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
            names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, *rest in zip(*(batch.column(c).to_pylist() for c in (
                    "part", "slice", "slots", "owners", "known"))):
                if held and part != last:
                    yield answer(held)
                    held = []
                last = part
                held.append(tuple(rest))
        if held:
            yield answer(held)

    return asked.mapInArrow(run, "slice long, owners binary, alone binary")


def surveyed(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, txt (hash of the text), cls (name of the set), n (its size) and alone (its
    shingles that no other text has, some missed) of every row, stored."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    survey = _survey(docs, -(-size // OWNED_BYTES) or 1, words)

    def gather(texts: pa.Table, answers: pa.Table) -> pa.Table:
        alone = np.zeros(texts.num_rows, np.int64)
        for whose, n in zip(answers.column("owners").to_pylist(), answers.column("alone").to_pylist()):
            alone[np.frombuffer(whose, np.uint32)] += np.frombuffer(n, np.uint32)
        rows = texts.column("row").to_numpy()
        return texts.select(["doc_id", "txt", "cls", "n"]).append_column("alone", pa.array(alone[rows]))

    texts = survey.filter("part < 0").select("slice", "row", "doc_id", "txt", "cls", "n")
    return stored(texts.groupBy("slice").cogroup(_answers(survey).groupBy("slice")).applyInArrow(
        gather, "doc_id long, txt long, cls long, n long, alone long"), "texts")


def hopeful_sets(docs: DataFrame, rows: DataFrame, words: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """cls, n, hs (hashes) of the different sets that may have a partner, stored."""
    hopeful = rows.filter((F.col("n") > 0) & (F.col("alone") <= F.expr(f"(n * {100 - share}) div 100")))
    wanted = stored(hopeful.groupBy("cls").agg(F.min("txt").alias("_txt")).select("_txt").distinct(),
                    "wanted")
    if wanted.count() <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    texts = (docs.select(F.coalesce("text", F.lit("")).alias("text"))
             .withColumn("txt", F.xxhash64("text")))
    texts = texts.join(wanted, F.col("txt") == F.col("_txt"), "left_semi").dropDuplicates(["txt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text, h = shingle_sets(*byte_view(part.column("text")), words)
                rows = part.num_rows
                edge = np.searchsorted(text, np.arange(rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_class_of(text, h, rows).view(np.int64)), pa.array(np.diff(edge)),
                     pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(h.view(np.int64)))],
                    ["cls", "n", "hs"])

    return stored(texts.select("text").mapInArrow(run, "cls long, n long, hs array<long>"), "sets")


def postings(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """h, cls, n: the places at which a set must share a shingle with any partner; only of
    shingles that are posted several times. Stored."""
    every = sets.select("cls", "n", F.explode("hs").alias("h"))
    held = every.groupBy("h").agg(F.count("*").alias("held")).filter("held > 1")
    own = Window.partitionBy("cls")
    shared = (every.join(held, "h")
              .withColumn("rank", F.row_number().over(own.orderBy("held", "h")))
              .withColumn("k", F.count("*").over(own)))
    room = F.expr(f"(n * {100 - share}) div 100") + 1 - (F.col("n") - F.col("k"))
    posted = stored(shared.filter(F.col("rank") <= room).select("h", "cls", "n"), "posted")
    several = posted.groupBy("h").agg(F.count("*").alias("_c")).filter("_c > 1").select("h")
    return stored(posted.join(several, "h"), "postings")


def _tree(sets: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """The trie of lexicographically sorted sets, paths pressed together, in preorder:
    (depth above, depth, first set, beyond last set, number of the next node outside)."""
    open_: list[list[int]] = []  # depth, first set
    closed: list[tuple[int, int, int, int]] = []
    for k in range(len(sets) + 1):
        common = 0
        if 0 < k < len(sets):
            a, b = sets[k - 1], sets[k]
            size = min(len(a), len(b))
            differ = np.flatnonzero(a[:size] != b[:size])
            common = int(differ[0]) if len(differ) else size
        first = k
        while open_ and open_[-1][0] > common:
            depth, first = open_.pop()
            above = max(common, open_[-1][0] if open_ else 0)
            closed.append((above, depth, first, k))
        if k < len(sets):
            if common and (not open_ or open_[-1][0] < common):
                open_.append([common, first])
            open_.append([len(sets[k]), k])
    closed.sort(key=lambda node: (node[2], node[1]))
    after = np.searchsorted([node[2] for node in closed], [node[3] for node in closed])
    return [(*node, step) for node, step in zip(closed, after.tolist())]


def forest(sets: list[np.ndarray], share: int = SHARE, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest set that links reach from each of the different, sorted ``sets``; sets with
    one ``root`` are linked from the start.

    Blocks of sets walk the trie of all sets. A block's overlaps with a path are a vector;
    it goes down only with the members that can still reach a partner there.
    """
    n = len(sets)
    root = np.arange(n) if root is None else root.copy()
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    token, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(token), np.int64)
    rank[np.argsort(-held, kind="stable")] = np.arange(len(token))
    number = rank[number]
    turn = np.lexsort((number, owner))
    edge = np.concatenate([[0], np.cumsum(size)])
    ranked = [number[turn[a:b]] for a, b in zip(edge, edge[1:])]
    order = np.array(sorted(range(n), key=lambda k: ranked[k].astype(">u4").tobytes()))
    ranked = [ranked[k] for k in order]
    size, place = size[order], np.empty(n, np.int64)
    place[order] = np.arange(n)
    root = _renamed(place, root, order)
    nodes = _tree(ranked)
    least = [int(size[first:beyond].min()) for _, _, first, beyond, _ in nodes]
    most = [int(size[first:beyond].max()) for _, _, first, beyond, _ in nodes]
    step = max(1, min(BLOCK_SETS, BLOCK_BYTES // len(token)))
    for low in range(0, n, step):
        block = np.arange(low, min(low + step, n))
        change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        if change[-1] == 0:
            break
        has = np.zeros((len(token), len(block)), np.uint8)
        for b, k in enumerate(block):
            has[ranked[k], b] = 1
        keys = np.concatenate([ranked[k] + b * len(token) for b, k in enumerate(block)])
        ends = np.cumsum(size[block])
        linked: list[tuple[np.ndarray, int]] = []
        at, path = 0, [(0, np.arange(len(block)), np.zeros(len(block), np.int64))]
        while at < len(nodes):
            above, depth, first, beyond, after = nodes[at]
            while path[-1][0] > above:
                path.pop()
            _, active, overlap = path[-1]
            mine = block[active]
            use = mine < beyond - 1  # a pair is met once, with its earlier set as walker
            if change[beyond - 1] == change[first]:
                use &= root[mine] != root[first]
            active, overlap = active[use], overlap[use]
            if len(active):
                edge_tokens = ranked[first][above:depth]
                overlap = overlap + has[edge_tokens].sum(0, dtype=np.int64)[active]
                last = ranked[first][depth - 1]
                rest = ends[active] - np.searchsorted(keys, active * len(token) + last, "right")
                own = size[block[active]]
                if size[first] == depth:  # a set ends here
                    alike = (100 * overlap >= share * (own + depth - overlap)) & (block[active] < first)
                    if alike.any():
                        linked.append((block[active[alike]], first))
                best = np.clip(depth + rest, max(least[at], depth), most[at])
                can = overlap + np.minimum(rest, best - depth)
                use = 100 * can >= share * (own + best - can)
                active, overlap = active[use], overlap[use]
            if len(active) and after > at + 1:
                path.append((depth, active, overlap))
                at += 1
            else:
                at = after
        if linked:
            root = linked_rows(n, np.concatenate([a for a, _ in linked]),
                               np.concatenate([np.full(len(a), b) for a, b in linked]), root)
    return _renamed(order, root, place)


def _renamed(number: np.ndarray, root: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Roots of rows k = back[...] named by ``number`` of their smallest row."""
    named = number[root[back]]
    least = np.full(len(root), len(root))
    np.minimum.at(least, named, np.arange(len(root)))
    return least[named]


def _links(rows: DataFrame, share: int) -> DataFrame:
    """(a, b): links between the sets of each group of ``rows`` (grp, cls, root, hs) that
    join what the group holds, those of equal root left out."""
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "cls")

    def found(held: list[tuple]) -> pa.RecordBatch:
        cls = np.array([x[0] for x in held], np.int64)
        _, first, start = np.unique([x[1] for x in held], return_index=True, return_inverse=True)
        before = first[start]
        after = forest([x[2] for x in held], share, before)
        new = np.flatnonzero(after != before)
        return pa.RecordBatch.from_arrays([pa.array(cls[new]), pa.array(cls[after[new]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, name = [], None, None
        for batch in batches:
            hs = batch.column("hs")
            value, edge = hs.flatten().to_numpy().view(np.uint64), hs.value_lengths().to_numpy()
            edge = np.concatenate([[0], np.cumsum(edge)])
            for k, (grp, cls, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in (
                    "grp", "cls", "root")))):
                if held and grp != last:
                    yield found(held)
                    held, name = [], None
                if cls != name:
                    held.append((cls, root, value[edge[k]:edge[k + 1]].copy()))
                last, name = grp, cls
        if held:
            yield found(held)

    return dealt.mapInArrow(run, "a long, b long").filter("a != b")


def _parts(n: str, k: str) -> Column:
    return F.greatest(F.ceil(F.col(k) / SETS), F.ceil(F.col(n) / SHINGLES)).cast("int")


def _large_links(posted: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links of bundles that are too large for a task, from their postings."""
    sized = posted.groupBy("h").agg(F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(
        F.xxhash64("cls").cast("decimal(20,0)")).alias("_same"))
    # postings of the same sets are one
    sized = sized.groupBy("_n", "_k", "_same").agg(F.min("h").alias("h")).select(
        "h", _parts("_n", "_k").alias("parts"))
    rows = stored(posted.join(sized, "h"), "large")
    dealt = rows.withColumn("deal", F.explode(F.when(
        F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    part = F.pmod(F.xxhash64("cls", "deal"), F.col("parts"))
    dealt = dealt.select(F.xxhash64("h", "deal", part).alias("grp"), "cls", F.col("cls").alias("root"))
    links = stored(_links(dealt.join(sets.select("cls", "hs"), "cls"), share), "links")
    split = rows.filter("parts > 1")
    if split.isEmpty():
        return links
    # the parts of a large posting: sets outside its largest component meet all of its sets
    roots = components(links).withColumnRenamed("node", "_cls")
    split = split.join(roots, F.col("cls") == F.col("_cls"), "left").select(
        "h", "cls", "n", "parts", F.coalesce("root", "cls").alias("root"))
    split = stored(split, "split")
    by_root = split.groupBy("h", "root").agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))
    largest = (by_root.groupBy("h").agg(
        F.max(F.struct("_k", "root")).alias("_top"), F.sum("_k").alias("_all"), F.sum("_n").alias("_sum"))
        .join(by_root.select("h", F.col("root").alias("_r"), F.col("_n").alias("_own")), "h")
        .filter((F.col("_r") == F.col("_top.root")) & (F.col("_all") > F.col("_top._k")))
        .select("h", F.col("_r").alias("main"), (F.col("_all") - F.col("_top._k")).alias("_k"),
                (F.col("_sum") - F.col("_own")).alias("_n"))
        .select("h", "main", _parts("_n", "_k").alias("others")))
    split = split.join(largest, "h")
    all_parts = split.withColumn("a", F.pmod(F.xxhash64("cls"), F.col("parts"))).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    rest = split.filter("root != main").withColumn(
        "b", F.pmod(F.xxhash64("cls"), F.col("others"))).withColumn(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = all_parts.select("h", "a", "b", "cls", "root").unionByName(
        rest.select("h", "a", "b", "cls", "root"))
    both = both.select(F.xxhash64("h", "a", "b").alias("grp"), "cls", "root")
    return links.unionByName(stored(_links(both.join(sets.select("cls", "hs"), "cls"), share), "links"))


def alike(sets: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b): links that join all ``sets`` (cls, n, hs) which chains of likeness join."""
    posted = postings(sets, share)
    bundles = stored(components(posted.select(F.col("cls").alias("a"), F.col("h").alias("b")))
                     .withColumnsRenamed({"node": "_cls", "root": "bundle"}), "bundles")
    member = stored(sets.select("cls", "n").join(bundles, F.col("cls") == F.col("_cls"))
                    .select("cls", "n", "bundle"), "members")
    large = (member.groupBy("bundle").agg(F.count("*").alias("_k"), F.sum("n").alias("_n"))
             .filter((F.col("_k") > SETS) | (F.col("_n") > SHINGLES)).select("bundle"))
    large = stored(large, "oversize")
    whole = member.join(large, "bundle", "left_anti").select(
        F.col("bundle").alias("grp"), "cls", F.col("cls").alias("root"))
    links = stored(_links(whole.join(sets.select("cls", "hs"), "cls"), share), "links")
    if large.isEmpty():
        return links
    apart = member.join(large, "bundle", "left_semi").select("cls")
    return links.unionByName(_large_links(posted.join(apart, "cls", "left_semi"), sets, share))


def near_duplicates(docs: DataFrame, words: int = SHINGLE, share: int = SHARE,
                    join: Callable[[DataFrame, int], DataFrame] = alike) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two texts link when they share ``share`` percent of the union of their sets of
    ``words``-word shingles (a shorter text: all its words are one). component_id is the
    smallest doc_id that links reach, the own one included. A null text is empty; texts
    without words link with nothing, not even each other; rows that repeat come back each;
    a null doc_id never is a component's id unless the component has no other (then it is
    null). Shingles and sets are told apart by 64-bit hashes. Other columns are not read;
    an empty table gives no rows.
    """
    rows = surveyed(docs, words)
    roots = components(join(hopeful_sets(docs, rows, words, share), share))
    full = rows.filter("n > 0")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("first"))
    classes = stored(classes.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "first", F.coalesce("root", "cls").alias("root")), "classes")
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(named, "root").select("cls", "component_id")
    out = full.join(classes, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_trie(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM lists),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * k >= 85 * (len(x.s) + len(y.s) - k)),
reached AS (
  SELECT doc_id, doc_id AS node FROM sets
  UNION SELECT doc_id, b FROM reached JOIN links ON a = node)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(node) FROM reached r WHERE r.doc_id = t.doc_id)
  AS component_id FROM sets t
"""

QUERIES = {"op13_trie": op13_trie}
ORACLE = {"op13_trie": SQL}
