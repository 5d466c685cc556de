"""SimHash groups and components against brute force."""

import os

import numpy as np
import pytest
import xxhash

from counterpoise.llm import simhash
from counterpoise.llm.components import components
from tests.llm.conftest import DOC_SCHEMA, documents


def print_of(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def smallest(prints, ids, radius=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[find(i)] = find(j)
    first = {}
    for k, i in enumerate(ids):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return [first.get(find(k)) for k in range(len(ids))]


def expected(texts, ids):
    prints = [print_of(t) for t in texts]
    return sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, smallest(prints, ids))),
                  key=str)


TEXTS = ["", None, "  \n", "one", "ONE", "one two", "one two three", "One two\tthree four",
         "é É ñ", "é É ñ", "a b c d e f g h i j k l m n o p q r s t u v w x y z",
         "a b c d e f g h i j k l m n o p q r s t u v w x y z z",
         "word " * 500, "word " * 501, " ".join(str(k) for k in range(70_000))]


def test_edge_cases(spark):
    ids = [7, 3, 9, None, 4, 5, 6, 6, None, 11, 12, 13, 14, 15, 16]
    found = simhash.near_duplicates(documents(spark, TEXTS, ids)).collect()
    assert sorted(map(tuple, found), key=str) == expected(TEXTS, ids)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == expected([r.text for r in rows], [r.doc_id for r in rows])


@pytest.mark.parametrize("blocks,group,tile", [(4, 64, 16), (5, 8192, 256), (6, 40, 7)])
def test_links_reach_whatever_brute_force_reaches(spark, monkeypatch, blocks, group, tile):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(blocks)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))
            for c in centre for _ in range(100)]
    far = rng.integers(0, 1 << 63, 100, dtype=np.uint64).tolist()
    prints = sorted({*near, *far, 0, 1, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    links = simhash.near_links(frame, blocks=blocks)
    assert links.count() < 60 * len(prints)
    roots = {r.node: r.root for r in components(links).collect()}
    groups = smallest(prints, list(range(len(prints))))
    ours = {}
    for k, p in enumerate(signed):
        ours.setdefault(roots.get(p, p), set()).add(k)
    brute = {}
    for k, g in enumerate(groups):
        brute.setdefault(g, set()).add(k)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, brute.values()))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (600, 600)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {tuple(r) for r in found} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}


def test_first_of_each_group_stays(spark):
    rows = [(4, "x y z", "en", "s", 5), (2, "X y z", "en", "s", 5), (2, "X y z", "de", "s", 5),
            (9, "other words here", None, None, None), (None, "x y z", "en", "s", 5)]
    kept = simhash.keep_first(spark.createDataFrame(rows, DOC_SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9]


def test_different_texts_under_one_id_stay(spark):
    rows = [(1, "first text of this id"), (1, "something else altogether here"), (2, "a third text"),
            (None, "only text without id"), (None, "only text without ID"), (None, "one more of them"),
            (3, "First text of this id"), (2, "a third text"), (4, None), (5, "")]
    kept = simhash.keep_first(documents(spark, [t for _, t in rows], [i for i, _ in rows]))
    found = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert found == sorted({(1, "first text of this id"), (1, "something else altogether here"),
                            (2, "a third text"), (None, "only text without id"),
                            (None, "one more of them"), (4, "")}, key=str)


def test_extra_columns_with_clashing_names(spark):
    docs = documents(spark, ["x y z", "X y z", "other"]).selectExpr(
        "*", "1 AS print", "2 AS root", "'a' AS component_id", "doc_id AS _kept")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert simhash.near_duplicates(docs).count() == 3
