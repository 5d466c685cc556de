"""The n-gram join against brute force."""

import os
import re

import numpy as np
import pytest

from counterpoise.llm import trie
from tests.llm.conftest import documents

ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, n=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if w]
    return {tuple(words[k:k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def expected(texts, ids, share=85):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= share * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for k, i in enumerate(ids):
        if i is not None:
            first[find(k)] = min(i, first.get(find(k), i))
    return sorted(((i, len(s), first.get(find(k))) for k, (i, s) in enumerate(zip(ids, sets))), key=str)


def found(spark, texts, ids=None, partitions=3):
    out = trie.near_duplicates(documents(spark, texts, ids, partitions)).collect()
    return sorted(map(tuple, out), key=str)


BASE = " ".join(f"w{k}" for k in range(60))
EDGE = ["", None, " \n", "one", "ONE", "one two three", "One two\tthree", "one two three four",
        "é É", "é É", "É é", BASE, BASE + " x", "y " + BASE, BASE.replace("w30", "z"), "a " * 50,
        "a " * 3, "a a a a", "a\x1cb c d"]


def test_edge_cases(spark):
    ids = [7, 3, 9, None, 4, 5, 6, 6, None, 11, 12, 13, 14, 15, None, 17, 18, 19, 20]
    assert found(spark, EDGE, ids) == expected(EDGE, ids)
    assert found(spark, []) == []
    assert found(spark, [""]) == [(0, 0, 0)]


def clusters(seed, groups, copies, words=40, edits=4):
    """Texts in groups of near copies, some a little more and some a little less alike."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g % 3}w{k}" if k < words // 3 else f"q{g}w{k}" for k in range(words)]
        for _ in range(copies):
            own = list(base)
            for k in rng.choice(words, rng.integers(0, edits), replace=False):
                own[k] = f"e{rng.integers(0, 5)}"
            out.append(" ".join(own[: words - rng.integers(0, 6)]))
    return out


@pytest.mark.parametrize("sets,block", [(4096, 256), (4096, 3), (6, 256), (3, 2), (12, 5)])
def test_bundles_of_any_size(spark, monkeypatch, sets, block):
    monkeypatch.setattr(trie, "SETS", sets)
    monkeypatch.setattr(trie, "BLOCK_SETS", block)
    monkeypatch.setattr(trie, "ASKING_BYTES", 3000)
    monkeypatch.setattr(trie, "OWNED_BYTES", 5000)
    texts = clusters(sets, 6, 14)
    ids = list(range(len(texts)))
    assert found(spark, texts) == expected(texts, ids)


def test_forest_against_all_pairs():
    rng = np.random.default_rng(4)
    for trial in range(60):
        base = rng.choice(200, 40, replace=False)
        sets = {}
        for _ in range(30):
            some = np.unique(np.concatenate([rng.permutation(base)[:rng.integers(1, 41)],
                                             rng.integers(200, 210, rng.integers(0, 4))]))
            sets[some.tobytes()] = some
        sets = list(sets.values())
        share = int(rng.integers(40, 100))
        start = np.arange(len(sets))
        if trial % 2:
            start[len(sets) // 2:] = len(sets) // 2
        link = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
                if 100 * len(np.intersect1d(a, b)) >= share * len(np.union1d(a, b))]
        want = start.copy()
        while True:
            before = want.copy()
            for i, j in link:
                want[(want == want[i]) | (want == want[j])] = min(want[i], want[j])
            if (want == before).all():
                break
        assert trie.forest(sets, share, start).tolist() == want.tolist()


def test_survey_misses_no_partner(spark):
    texts = clusters(1, 5, 4) + [f"lone{k} " * 9 for k in range(5)]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in trie.surveyed(docs).collect()}
    sets = [shingles(t) for t in texts]
    for k, s in enumerate(sets):
        alone = sum(all(x not in other for j, other in enumerate(sets) if j != k) for x in s)
        assert rows[k].n == len(s) and rows[k].alone == alone


def test_long_text(spark):
    long = " ".join(f"t{k % 977}u{k % 1009}" for k in range(500_000))
    texts = [long, "x " + long, "short text of five words", long[:2_000_000]]
    ids = list(range(4))
    assert found(spark, texts) == expected(texts, ids)


def test_extra_columns_with_clashing_names(spark):
    docs = documents(spark, [BASE, BASE + " x", "other"]).selectExpr(
        "*", "1 AS cls", "2 AS root", "'a' AS component_id", "3 AS h", "4 AS txt", "5 AS `a.b`")
    assert sorted(map(tuple, trie.near_duplicates(docs).collect())) == [(0, 57, 0), (1, 58, 0), (2, 1, 2)]


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.collect()
    got = sorted(map(tuple, trie.near_duplicates(docs).collect()), key=str)
    assert got == expected([r.text for r in rows], [r.doc_id for r in rows])
