"""Scores of the language model against plain counts, and normalisation."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.llm import lm
from counterpoise.llm.common import fold
from tests.llm.conftest import documents

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
QUICK = lm.Training(steps=50)


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def check(found, rows):
    """Base columns of (doc_id, text) rows; returns the scores by doc_id."""
    def out(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    count = collections.Counter(t for i, x in rows if not out(i) for t in tokens_of(x))
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(tokens_of(x)), sum(count[t] > 0 for t in tokens_of(x)), total,
                   round(sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1)))
                             for t in tokens_of(x)), 5)) for i, x in rows)
    got = found.collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    return got


def score(docs, how=QUICK):
    return lm.score_documents(docs, fold(F.col("doc_id"), 5) == 1, how)


TEXTS = ["", None, "a b c", "A B\tC\x1cd", "é É é", " \n", "word " * 3000, "x" * 9000, "a b c", "Ü a"]


def test_base_columns(spark):
    check(score(documents(spark, TEXTS)), list(enumerate(TEXTS)))
    ids = [5, 5, None, None, 1, 2, 3, 3, 3, 10 ** 15]
    check(score(documents(spark, TEXTS, ids).selectExpr("*", "1 AS token", "2 AS bundle")),
          list(zip(ids, TEXTS)))


def test_no_rows_and_no_training_rows(spark):
    assert score(documents(spark, [])).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    check(score(documents(spark, ["a b", "c", None], held)), list(zip(held, ["a b", "c", None])))


def test_bundles_do_not_matter(spark, monkeypatch):
    texts = [f"word{k % 7} and w{k % 3} " * (k % 5) for k in range(80)]
    whole = {r.doc_id: r.score for r in score(documents(spark, texts)).collect()}
    found = score(documents(spark, texts, partitions=7)).collect()
    assert all(abs(r.score - whole[r.doc_id]) < 1e-6 for r in found)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(3)
    context = rng.integers(0, 40, 4000) * lm.CLASSES + rng.integers(0, 40, 4000)
    target = (context % lm.CLASSES) % 5 + 60      # the class before decides
    cell, n = np.unique(context * lm.CLASSES + target, return_counts=True)
    model = lm.train(cell, n, lm.Training(steps=600))
    assert np.allclose((10.0 ** model.astype(float)).sum(1), 1, atol=1e-4)
    share = np.bincount(target, minlength=lm.CLASSES) / len(target)
    unigram = np.log10(share[target]).mean()
    assert model[context, target].mean() > unigram + 0.3


def test_every_counted_trigram_trains():
    """Two trigrams in 100,000, which draws would miss, change classes with each other."""
    def trained(a, b):
        cell = np.array([5 * lm.CLASSES + 5, 70 * lm.CLASSES + a, 71 * lm.CLASSES + b])
        return lm.train(cell, np.array([100_000, 1, 1]), lm.Training(steps=2, batch=64))

    one, other = trained(90, 91), trained(91, 90)
    assert one[70, 90] - one[70, 91] > other[70, 90] - other[70, 91]
    assert one[71, 91] - one[71, 90] > other[71, 91] - other[71, 90]


def test_steps_end_with_a_whole_pass():
    cell = np.arange(0, 1000 * lm.CLASSES, lm.CLASSES) + np.arange(1000) % lm.CLASSES
    parts = lm._dealt(cell, np.ones(1000, int), 300)
    assert sorted(np.concatenate([c for c, _ in parts]).tolist()) == list(range(1000))
    assert max(len(c) for c, _ in parts) <= 300 and sum(s.sum() for _, s in parts) == 1000
    whole = lm.train(cell, np.ones(1000, int), lm.Training(steps=4, batch=300))
    assert np.array_equal(whole, lm.train(cell, np.ones(1000, int), lm.Training(steps=1, batch=300)))


def test_probabilities_of_all_tokens_sum_to_one(spark):
    """Class probability times probability within the class, over all known and one unknown."""
    found = lm.Classes(20, 6, np.array([5, 6, 9] + [0] * 125), np.array([1, 1, 4] + [0] * 125),
                       np.array([77]))
    counts = np.array([4, 3, 1, 1])
    inside = (counts + 0.5) / (found.tokens_of[2] + 0.5 * (found.distinct_of[2] + 1))
    unknown = 0.5 / (found.tokens_of[2] + 0.5 * (found.distinct_of[2] + 1))
    assert abs(inside.sum() + unknown - 1) < 1e-12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = check(lm.score_documents(docs, fold(F.col("doc_id"), 5) == 1), rows)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain per held-out token, log10:", gain)
    assert gain > 0.05
