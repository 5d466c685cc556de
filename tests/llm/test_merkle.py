"""Manifest and proofs against a plain version of the contract."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from counterpoise.llm import merkle
from tests.llm.conftest import DOC_SCHEMA


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    fields = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], text)]
    return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def climb(nodes):
    """Levels of a tree and its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[k:k + 3]) for k in range(0, len(now), 3)])
    return levels


def siblings(levels, pos):
    for level in levels[:-1]:
        first = pos // 3 * 3
        yield level[first:pos], level[pos + 1:first + 3]
        pos //= 3


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, climb([leaf_of(r, r[1]) for r in own])))
    top = climb([levels[-1][0] for _, levels in trees])
    out = []
    for k, (own, levels) in enumerate(trees):
        for pos, r in enumerate(own):
            text, ident = r[1], "" if r[0] is None else str(r[0])
            if zlib.crc32(ident.encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            path = [*siblings(levels, pos), *siblings(top, k)]
            now = leaf_of(r, text)
            for left, right in path:
                now = H(*left, now, *right)
            out.append((r[0], levels[0][pos], levels[-1][0], top[-1][0], H(*(
                x for left, right in path for x in left + right)), now, now == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(partitions)
    return sorted(map(tuple, merkle.audit(docs).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(merkle, "STOREY", 2)
    monkeypatch.setattr(merkle, "CHUNK", 4)
    monkeypatch.setattr(merkle, "ASKERS", 2)


EDGE = [(1, "a\nb", "en", "s", 3), (2, "a\nb", "en", "s", 3), (None, "x\n", None, "s", None),
        (3, None, None, None, None), (4, "", "de", "", 0), (5, "é\n\n漢", "de", "é", 4),
        (6, "z", "de", "z", 1), (6, "z", "de", "z", 1), (6, "y\n", "de", "z", 2),
        (-7, "long\n" * 50_000, "en", "s", 250_000)]


def test_edge_cases(spark, small):
    assert found(spark, EDGE) == expected(EDGE)
    assert found(spark, EDGE[:1]) == expected(EDGE[:1])
    assert found(spark, []) == []


@pytest.mark.parametrize("sizes", [[1], [2, 3, 4], [9, 10, 27, 28], [1] * 30, [200, 1, 1, 82]])
def test_trees_of_many_sizes(spark, small, sizes):
    rows = [(k * 7 % 1009 + 1009 * s, f"t\n{k}", "en", f"s{s}", k) for s, n in enumerate(sizes)
            for k in range(n)]
    assert found(spark, rows) == expected(rows)


def test_proofs_of_a_part_fetch_only_what_is_missing(spark, small):
    rows = [(k, f"t{k}", "en", f"s{k % 2}", 1) for k in range(100)]
    made = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, DOC_SCHEMA)))
    wanted = made.leaves.filter("doc_id % 10 = 3")
    got = merkle.proofs(made, wanted).collect()
    assert sorted(r.doc_id for r in got) == list(range(3, 100, 10))
    for r in got:
        now = r.leaf
        for step in r.proof:
            left, right = step.split(":")
            now = H(left, now, right)
        assert now == r.root == r.folded_root


def test_missing_nodes_are_minimal():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 27, 100):
        places = np.unique(rng.integers(0, n, 7))
        asked = {(level, int(k)) for level, idx in merkle.missing(places, n) for k in idx}
        below = {(0, int(k)) for k in places}
        need = set()
        for level in range(merkle._levels(n)):
            width = -(-n // 3 ** level)
            mine = {k for lv, k in below if lv == level}
            need |= {(level, j) for k in mine for j in range(k // 3 * 3, min(width, k // 3 * 3 + 3))
                     if j not in mine}
            below |= {(level + 1, k // 3) for k in mine}
        assert asked == need


def test_nodes_that_many_chunks_want_are_copied(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 2)
    monkeypatch.setattr(merkle, "ASKERS", 1)
    rows = [(k, "t\n", "en", "s", 2) for k in range(60)]
    assert found(spark, rows) == expected(rows)


def test_extra_columns_with_clashing_names(spark, small):
    docs = spark.createDataFrame(EDGE, DOC_SCHEMA).selectExpr(
        "*", "1 AS tree", "2 AS pos", "'x' AS leaf", "3 AS part", "4 AS row", "5 AS `a.b`")
    assert sorted(map(tuple, merkle.audit(docs).collect()), key=str) == expected(EDGE)


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    assert sorted(map(tuple, merkle.audit(docs).collect()), key=str) == expected(rows)
