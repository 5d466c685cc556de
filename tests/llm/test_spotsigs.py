"""Spot signatures against plain Python."""

import hashlib
import re

import pytest

from counterpoise.llm import spotsigs
from tests.llm.conftest import DOC_SCHEMA, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def spots(text):
    words = WORD.findall(text.lower())
    common = set(spotsigs.COMMON)
    content = [k for k, w in enumerate(words) if w not in common]
    out = set()
    for j in range(len(content) - spotsigs.CHAIN + 1):
        k = content[j]
        if k > 0 and words[k - 1] in common:
            out.add((words[k - 1], *(words[content[j + n]] for n in range(spotsigs.CHAIN))))
    return out or {("whole", *words)}


def alike(a, b):
    x, y = spots(a), spots(b)
    return len(x & y) / len(x | y)


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    round(alike(text, edited), 9), round(alike(text, after), 9)))
    return sorted(out, key=str)


def check(found, rows):
    got = found.collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9),
                    round(r.near_next, 9)) for r in got), key=str) == expected(rows)
    by_print = {}
    for r in got:
        assert len(r.fingerprint) % 8 == 0 and len(r.edited_fingerprint) % 8 == 0
        by_print.setdefault(r.fingerprint, []).append(r)
    return by_print


TEXTS = ["", None, "the quick brown fox of the north runs to a far hill", "The quick, brown fox!",
         "le chat noir dort dans la grande maison bleue", "x" * 20_000, "𝄞𝄞𝄞 é the ñ one two three",
         "the quick brown fox of the north runs to a far hill", "of of of the the", "of a b c d " * 3000]


@pytest.mark.parametrize("ids", [list(range(10)), [5, 5, 5, 2, 2, 9, None, None, 1, -4],
                                 [7] * 10, [None] * 10, [10 ** 17 + k for k in range(10)]])
@pytest.mark.parametrize("rows", [1, 3, 512])
def test_next_and_likeness(spark, monkeypatch, ids, rows):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", rows)
    check(spotsigs.fingerprint_edits(documents(spark, TEXTS, ids)), list(zip(ids, TEXTS)))


def test_single_row_and_none(spark):
    check(spotsigs.fingerprint_edits(documents(spark, ["of one two three"], [3])),
          [(3, "of one two three")])
    assert spotsigs.fingerprint_edits(documents(spark, [])).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    docs = documents(spark, TEXTS).selectExpr("*", "1 AS sigs", "2 AS at", "'z' AS guest")
    prints = check(spotsigs.fingerprint_edits(docs), list(enumerate(TEXTS)))
    assert sorted(len(v) for v in prints.values()) == [1, 1, 1, 1, 1, 1, 2, 2]


def test_near_duplicates_lose_no_pair(spark):
    base = [f"the w{k} of the v{k} in x{k} and y{k} z{k}" for k in range(60)]
    texts = [" ".join(base[s:s + n] + [f"of q{s} r{n} t{s}"] * e)
             for s in (0, 1, 30) for n in (18, 20, 24, 30) for e in (0, 1, 2)] + ["", "alone"]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    members, pairs = spotsigs.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA))
    classes = {}
    for r in members.collect():
        classes.setdefault(r.class_id, []).append(r.doc_id)
    found = {frozenset((i, j)) for r in pairs.collect() for i in classes[r.a] for j in classes[r.b]}
    found |= {frozenset((i, j)) for c in classes.values() for i in c for j in c if i != j}
    want = {frozenset((i, j)) for i in range(len(texts)) for j in range(i)
            if alike(texts[i], texts[j]) >= 0.8}
    assert found == want and len(want) > 20


def near_pairs(spark, texts):
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    members, pairs = spotsigs.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA))
    classes = {r.class_id: r.doc_id for r in members.collect()}
    return {frozenset((classes[r.a], classes[r.b])) for r in pairs.collect()}


def test_a_third_of_the_rows_share_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "GROUP_ROWS", 16)
    emitted, inner = [], spotsigs.candidates

    def counted(*given):
        emitted.append(inner(*given).count())
        return inner(*given)

    monkeypatch.setattr(spotsigs, "candidates", counted)

    def parts(kind, numbers):
        return [f"the {kind}x{k} {kind}y{k} {kind}z{k}" for k in numbers]

    shared = parts("s", range(8))
    texts = [" ".join(shared + parts(f"t{k}t", range(2))) for k in range(100)]
    texts += [" ".join(parts(f"u{k}u", range(10))) for k in range(200)]
    assert near_pairs(spark, texts) == set()
    assert emitted.pop() == 0
    # nine of ten shared: all pairs of them are alike, and every one is found in parts
    alike_ones = [" ".join(shared + parts("s", [8]) + parts(f"v{k}v", range(1))) for k in range(40)]
    assert alike(alike_ones[0], alike_ones[1]) > 0.8
    want = {frozenset((i, j)) for i in range(40) for j in range(i)}
    assert near_pairs(spark, alike_ones + texts[100:120]) == want
