"""Merkle manifest of a dataset, with proofs made by Octopus multiproofs.

Every row is a leaf. The leaves of a source form a tree by doc_id in which three
consecutive nodes have one parent, and the subroots of the sources form one more tree of
the same kind. Leaves get their places from a range sort, so a large source lies in many
partitions; trees grow storey by storey, each block of 3^7 nodes in one task.

Proofs are made in chunks of consecutive leaves. A chunk works out the smallest set of
nodes that its leaves do not give, fetches each of them once by a join, hashes the shared
interiors itself, and writes down the proof of each leaf from what it then holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.llm.common import fold, stored, table

#: Nodes under one parent.
ARITY = 3

#: Levels that a task hashes at a time; a block has ARITY ** STOREY nodes at most.
STOREY = 7

#: Leaves of a chunk (a power of two, for rows are numbered by partition in high bits).
CHUNK = 4096

#: Chunks that fetch one copy of a node; nodes that more chunks ask for are copied.
ASKERS = 1024

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: each field as its number of bytes, a colon and its value; null: -."""
    fields = F.concat(*map(_written, (doc_id, source, lang, n_chars, text)))
    return F.sha2(fields.cast("binary"), 256)


def leaves(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and claim (the leaf with ``claimed_text`` in place of text)."""
    columns = {c: F.col(c) for c in FIELDS}
    own = leaf(**columns)
    claim = own if claimed_text is None else leaf(**columns | {"text": claimed_text})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source",
                       own.alias("leaf"), claim.alias("claim"))


@dataclass
class Manifest:
    """leaves: doc_id, source, leaf, claim, tree (place of the source), pos, n (leaves of the
    tree), chunk. nodes: tree, n, level, idx, digest of every node, leaves included. tops:
    tree, subroot, root, path (proof of the subroot in the tree of the sources)."""

    leaves: DataFrame
    nodes: DataFrame
    tops: DataFrame


def _sorted_runs(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted over all partitions by group and order, with part and row (numbers of
    the partition and of the row), and for each group in each partition: part, group, first
    (row), before (rows of the group in earlier partitions) and n (rows of the group)."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn(
        "row", F.monotonically_increasing_id()), "sorted")
    whole = Window.partitionBy(group)
    runs = (ranged.groupBy("part", group).agg(F.min("row").alias("first"), F.count("*").alias("_k"))
            .withColumn("before", F.sum("_k").over(whole.orderBy("part")) - F.col("_k"))
            .withColumn("n", F.sum("_k").over(whole)).drop("_k"))
    return ranged, runs


def _levels(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    level = 0
    while ARITY ** level < n:
        level += 1
    return level


def _width(n: int, level: int) -> int:
    return -(-n // ARITY ** level)


def _storeys(rows: DataFrame) -> DataFrame:
    """All nodes of the trees whose leaves are ``rows`` (tree, n, idx, digest), with level."""
    block = ARITY ** STOREY

    def build(found: pa.Table) -> pa.Table:
        tree, n, level = (found.column(c)[0].as_py() for c in ("tree", "n", "level"))
        turn = np.argsort(found.column("idx").to_numpy())
        below = found.column("digest").take(pa.array(turn)).to_pylist()
        first = int(found.column("idx").to_numpy().min())
        levels, places, digests = [], [], []
        for level in range(level + 1, min(level + STOREY, _levels(n)) + 1):
            below = [digest(*below[k:k + ARITY]) for k in range(0, len(below), ARITY)]
            first //= ARITY
            levels += [level] * len(below)
            places += range(first, first + len(below))
            digests += below
        return pa.table({"tree": pa.array([tree] * len(levels), pa.int64()),
                         "n": pa.array([n] * len(levels), pa.int64()),
                         "level": pa.array(levels, pa.int32()),
                         "idx": pa.array(places, pa.int64()),
                         "digest": pa.array(digests, pa.string())})

    now = rows.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    nodes, most, level = now, rows.agg(F.max("n")).first()[0] or 0, 0
    while ARITY ** level < most:
        now = now.filter(F.col("n") > ARITY ** level).withColumn("_block", F.expr(f"idx div {block}"))
        new = stored(now.groupBy("tree", "_block").applyInArrow(
            build, "tree long, n long, level int, idx long, digest string"), "nodes")
        level += STOREY
        now = new.filter(F.col("level") == level)
        nodes = nodes.unionByName(new)
    return nodes


def _subroots(nodes: DataFrame) -> DataFrame:
    """tree and digest of the one node that remains in each tree."""
    below = F.pow(F.lit(float(ARITY)), F.col("level") - 1)
    last = F.col("n") <= F.pow(F.lit(float(ARITY)), "level")
    return nodes.filter(last & ((F.col("level") == 0) | (F.col("n") > below))).select("tree", "digest")


def missing(places: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that proofs of the leaves at ``places`` of a tree of n
    leaves need and that cannot be hashed from those leaves and other nodes named here."""
    known = np.unique(places)
    for level in range(_levels(n)):
        run = np.unique(known // ARITY)
        members = (run[:, None] * ARITY + np.arange(ARITY)).ravel()
        members = members[members < _width(n, level)]
        yield level, np.setdiff1d(members, known, assume_unique=True)
        known = run


def _copies(n: int, level: int) -> int:
    """Copies of a node that are kept for all the chunks that may ask for it."""
    return -(-min(n, ARITY ** (level + 1)) // (CHUNK * ASKERS))


def _fetched(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunk, tree, level, idx, digest: what each chunk of ``claims`` (chunk, tree, pos, n)
    lacks, each node once for a chunk."""
    lists = claims.groupBy("chunk", "tree", "n").agg(F.collect_list("pos").alias("places"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for chunk, tree, n, places in zip(*(batch.column(c).to_pylist() for c in (
                    "chunk", "tree", "n", "places"))):
                for level, idx in missing(np.array(places, np.int64), n):
                    row = chunk, tree, level, None, chunk % _copies(n, level)
                    for k, value in enumerate(row):
                        out[k] += idx.tolist() if k == 3 else [value] * len(idx)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(),
                                                      pa.int64(), pa.int64()))],
                ["chunk", "tree", "level", "idx", "copy"])

    wanted = lists.mapInArrow(ask, "chunk long, tree long, level int, idx long, copy long")
    covered = F.least(F.col("n").cast("double"), F.pow(F.lit(float(ARITY)), F.col("level") + 1))
    copies = F.ceil(covered / (CHUNK * ASKERS)).cast("long")
    held = nodes.select("tree", "level", "idx", "digest", F.explode(
        F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    return wanted.join(held, ["tree", "level", "idx", "copy"]).select(
        "chunk", "tree", "level", "idx", "digest", F.lit(None).cast("string").alias("root"),
        F.lit(None).cast("array<string>").alias("path"))


PROOF = ("doc_id long, tree long, leaf string, subroot string, root string, "
         "proof array<string>, folded_root string")


def _expand(claims: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs of the leaves of a chunk from its leaves and the nodes that it fetched."""
    known: dict[tuple[int, int, int], str] = {}
    above: dict[int, tuple[str | None, list[str]]] = {}
    for tree, level, idx, value, root, path in zip(*(fetched.column(c).to_pylist() for c in (
            "tree", "level", "idx", "digest", "root", "path"))):
        if level < 0:
            above[tree] = root, path
        else:
            known[tree, level, idx] = value
    rows = list(zip(*(claims.column(c).to_pylist() for c in (
        "doc_id", "tree", "pos", "n", "leaf", "claim"))))
    at: dict[int, tuple[int, set[int]]] = {}
    for _, tree, pos, n, own, _ in rows:
        known[tree, 0, pos] = own
        at.setdefault(tree, (n, set()))[1].add(pos)
    for tree, (n, places) in at.items():  # interiors that several leaves share, once
        for level in range(_levels(n)):
            width = _width(n, level)
            places = {k // ARITY for k in places}
            for k in places:
                known[tree, level + 1, k] = digest(*(
                    known[tree, level, j] for j in range(k * ARITY, min(width, (k + 1) * ARITY))))
    out = []
    for doc_id, tree, pos, n, own, claim in rows:
        proof, idx, now, honest = [], pos, claim, claim == own
        for level in range(_levels(n)):
            first = idx - idx % ARITY
            last = min(_width(n, level), first + ARITY)
            left = "".join(known[tree, level, j] for j in range(first, idx))
            right = "".join(known[tree, level, j] for j in range(idx + 1, last))
            proof.append(f"{left}:{right}")
            idx //= ARITY
            now = known[tree, level + 1, idx] if honest else digest(left, now, right)
        subroot = known[tree, _levels(n), 0]
        root, path = above.get(tree, (subroot, []))
        for step in path:
            left, _, right = step.partition(":")
            now = digest(left, now, right)
        out.append((doc_id, tree, own, subroot, root, proof + path, now))
    columns = list(zip(*out)) or [[]] * 7
    kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.list_(pa.string()), pa.string())
    return pa.table({c.split()[0]: pa.array(list(x), t) for c, x, t in zip(
        PROOF.split(", "), columns, kinds)})


def _proven(claims: DataFrame, fetched: DataFrame) -> DataFrame:
    return claims.groupBy("chunk").cogroup(fetched.groupBy("chunk")).applyInArrow(_expand, PROOF)


def manifest(found: DataFrame) -> Manifest:
    """The trees over ``found`` (doc_id, source, leaf, claim: what ``leaves`` gives).

    Leaves of a source lie by doc_id, null first; equal ids by leaf; a null source is one
    of its own and the first. An empty table has no nodes.
    """
    found = stored(found.withColumn("_seq", F.monotonically_increasing_id()), "leaves")
    rows, runs = _sorted_runs(found, "source", ["doc_id", "leaf", "_seq"])
    runs = stored(runs, "runs")
    sources = runs.select("source", "n").distinct().withColumn("_all", F.lit(0))
    ranged, whole = _sorted_runs(sources.withColumnRenamed("n", "size"), "_all", ["source"])
    tree = F.col("row") - F.col("first") + F.col("before")
    trees = stored(ranged.join(whole, ["part", "_all"]).select(
        F.col("source").alias("_source"), tree.alias("tree"), F.col("n").alias("trees"),
        F.shiftrightunsigned("row", CHUNK.bit_length() - 1).alias("chunk")), "trees")
    placed = runs.join(trees.drop("chunk"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("part").alias("_part"), "_source", "first", "before", "n", "tree")
    placed = rows.join(placed, (F.col("part") == F.col("_part"))
                       & F.col("source").eqNullSafe(F.col("_source")))
    placed = stored(placed.select(
        "doc_id", "source", "leaf", "claim", "tree", "n", tree.alias("pos"),
        F.shiftrightunsigned("row", CHUNK.bit_length() - 1).alias("chunk")), "placed")
    nodes = _storeys(placed.select("tree", "n", F.col("pos").alias("idx"), F.col("leaf").alias("digest")))
    subroots = stored(_subroots(nodes), "subroots").join(trees, "tree").select(
        F.lit(-1).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("idx"),
        "digest", "chunk")
    upper = _storeys(subroots)
    claims = subroots.select(F.col("idx").alias("doc_id"), "tree", "n", F.col("idx").alias("pos"),
                             F.col("digest").alias("leaf"), F.col("digest").alias("claim"), "chunk")
    tops = stored(_proven(claims, _fetched(claims, upper)).select(
        F.col("doc_id").alias("tree"), F.col("leaf").alias("subroot"),
        F.col("subroot").alias("root"), F.col("proof").alias("path")), "tops")
    return Manifest(placed, nodes, tops)


def proofs(made: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, tree, leaf, subroot, root, proof, folded_root of ``wanted`` (all leaves of the
    manifest or any part of them).

    proof has a string for each level up to the root: the siblings left of the node, a
    colon, the siblings right of it. folded_root is what claim and proof hash to; it is the
    root just where the claim is the leaf.
    """
    claims = made.leaves if wanted is None else wanted
    copy = F.pmod("chunk", F.ceil(F.col("n") / (CHUNK * ASKERS)).cast("long"))
    asking = claims.select("chunk", "tree", "n").distinct().select("chunk", "tree", copy.alias("copy"))
    sizes = made.leaves.filter("pos = 0").select("tree", F.explode(F.sequence(
        F.lit(0).cast("long"), F.ceil(F.col("n") / (CHUNK * ASKERS)).cast("long") - 1)).alias("copy"))
    above = asking.join(made.tops.join(sizes, "tree"), ["tree", "copy"]).select(
        "chunk", "tree", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"),
        F.lit(None).cast("string").alias("digest"), "root", "path")
    return _proven(claims.drop("source"), _fetched(claims, made.nodes).unionByName(above))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Where 2 divides crc32 of the doc_id as text (null: empty text), the claim is the leaf of
    the text without its newlines. Rows that repeat are leaves each; a lone leaf is its
    tree's root and its proof is empty; other columns are not read; an empty table gives
    no rows.
    """
    text = F.when(fold(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    made = manifest(leaves(docs, text.otherwise(F.col("text"))))
    siblings = F.replace(F.array_join("proof", ""), F.lit(":"), F.lit(""))
    return proofs(made).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle(spark, folder: str) -> DataFrame:
    return audit(table(spark, folder, "documents"))


#: crc32 bit by bit; 3988292384 is the reversed polynomial of the checksum.
SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR, '-')
    || coalesce(strlen(source)::VARCHAR || ':' || source, '-')
    || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR, '-') AS head,
    xor(4294967295, list_reduce(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '')) + 1),
        lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)),
      4294967295::BIGINT)) AS crc
  FROM documents),
claims AS (
  SELECT doc_id, source,
    sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(
      strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), ''), '-'))
      ELSE sha256(head || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) END AS claim
  FROM fields),
places AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n
  FROM claims),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, n, leaf AS digest FROM places
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // 3, n),
every AS (
  SELECT tree, level, idx, n, digest FROM nodes
  UNION ALL SELECT -1, level, idx, n, digest FROM upper),
around AS (
  SELECT tree, level, idx,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, idx // 3 ORDER BY idx
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM every WHERE n > 1),
climb AS (
  SELECT tree AS home, pos AS own, tree, 0 AS level, pos AS idx, n, claim AS now, '' AS proof
  FROM places
  UNION ALL
  SELECT c.home, c.own, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END,
    CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.idx // 3 ELSE c.tree END,
    CASE WHEN c.n > 1 THEN (c.n + 2) // 3 ELSE (SELECT count(*) FROM subroots) END,
    CASE WHEN c.n > 1 THEN sha256(a.before || c.now || a.after) ELSE c.now END,
    c.proof || coalesce(a.before || a.after, '')
  FROM climb c LEFT JOIN around a ON a.tree = c.tree AND a.level = c.level AND a.idx = c.idx
  WHERE c.n > 1 OR c.tree >= 0)
SELECT p.doc_id, p.leaf, s.digest AS subroot, u.digest AS root, sha256(c.proof) AS proof_sha256,
  c.now AS folded_root, c.now = u.digest AS verified
FROM places p JOIN climb c ON c.home = p.tree AND c.own = p.pos AND c.tree = -1 AND c.n = 1
JOIN subroots s ON s.tree = p.tree JOIN upper u ON u.n = 1
"""

QUERIES = {"op12_merkle": op12_merkle}
ORACLE = {"op12_merkle": SQL}
