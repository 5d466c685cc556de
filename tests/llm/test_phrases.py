"""Collocations against a plain version of the contract."""

import collections
import os
import re

import numpy as np
import pytest

from counterpoise.llm import phrases
from tests.llm.conftest import DOC_SCHEMA

ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def expected(rows, least=10, top=2000, share=50):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        candidates = {}
        for g, a in count.items():
            if len(g) > 1 and a >= least:
                cuts = [(10 ** 6 * a * a // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                candidates[g] = (a, count[g[:k]], count[g[k:]], score)
        inside = collections.Counter()
        for g, (a, *_) in candidates.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], a)
        kept = [(-s, -a, " ".join(g).encode(), l, r) for g, (a, l, r, s) in candidates.items()
                if len(g) == 3 or not inside[g] or 100 * inside[g] < share * a]
        for rank, (s, a, g, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n, -s))
    return sorted(out)


def found(spark, rows, partitions=3, **more):
    docs = spark.createDataFrame(
        [(k, t, lang, "s", 0) for k, (t, lang) in enumerate(rows)], DOC_SCHEMA).repartition(partitions)
    return sorted(map(tuple, phrases.collocations(docs, **more).collect()))


EDGE = [(None, "en"), ("", "en"), (" \t\n", None), ("a", "en"), ("a b", "en"), ("A b\x0bc.d", None),
        ("A  B\tc!a b c?a b c", "en"), ("a b c", "en"), ("a b c", "en"), ("é É é É", "fr"),
        ("a b a b a b", "und"), ("x y z w " * 30, "de"), ("    a\x85b a\x85b", "de")]


def test_edge_cases(spark):
    assert found(spark, EDGE, least=2) == expected(EDGE, least=2)
    assert found(spark, EDGE, least=1, top=3) == expected(EDGE, least=1, top=3)
    assert found(spark, []) == []
    assert found(spark, [(None, None)]) == []


@pytest.mark.parametrize("hot,parts", [(1 << 20, 1 << 20), (40, 50), (1, 7)])
def test_hot_words_and_many_parts(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "SORTED", parts)
    monkeypatch.setattr(phrases, "MERGED_BYTES", 200)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(12)]
    chance = 1 / np.arange(1, 13)
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words, 40, p=chance / chance.sum()))
        rows.append((text.replace(" w7 ", ", ").replace(" w8 ", "\n"), ["en", "de", None][k % 3]))
    assert found(spark, rows, least=3) == expected(rows, least=3)


def test_symbols_that_collide_get_another_hash(spark, monkeypatch):
    real = phrases.symbols_of

    def clash(data, starts, stops, seed):
        symbols = real(data, starts, stops, seed)
        return symbols if seed else symbols % np.uint64(2)

    monkeypatch.setattr(phrases, "symbols_of", clash)
    rows = [("a b c d a b c", "en")] * 4
    assert found(spark, rows, least=2) == expected(rows, least=2)


def test_multikey_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 5, (3, 400)).astype(np.uint64)
    symbols[2, rng.random(400) < 0.3] = 0
    times = rng.integers(1, 4, 400)
    want = collections.Counter()
    for k in range(400):
        want[tuple(symbols[:2, k].tolist())] += times[k]
        if symbols[2, k]:
            want[tuple(symbols[:, k].tolist())] += times[k]
    for least in (1, 10, 60):
        got = {}
        for words, at, n in phrases.sorted_counts(symbols, times, least):
            for p, c in zip(at, n):
                assert tuple(symbols[:words, p].tolist()) not in got
                got[tuple(symbols[:words, p].tolist())] = c
        assert got == {g: c for g, c in want.items() if c >= least}


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000
    words = spark.createDataFrame([(1, "en", "a", big + 1), (2, "en", "b", big + 5)],
                                  "symbol long, lang string, word string, n long")
    counts = spark.createDataFrame([(2, 1, 2, 0, big)], phrases.COUNTS)
    row = phrases.scored(counts, words).first()
    assert row.score == 10 ** 6 * big * big // ((big + 1) * (big + 5))


def test_long_text(spark, monkeypatch):
    text = " ".join(f"t{k % 977} u{k % 13}" for k in range(300_000))
    rows = [(text, "en"), ("x" * 3_000_000 + " y", "en")]
    assert found(spark, rows) == expected(rows)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(k, "a b c", "en", "s", 0) for k in range(12)], DOC_SCHEMA).selectExpr(
        "*", "1 AS rank", "2 AS n", "'x' AS phrase", "3 AS symbol", "4 AS `a.b`")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == expected([("a b c", "en")] * 12)


def test_whole_documents(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == expected(rows)
