"""Toxicity and quality: held-out accuracy, and the cases without a model."""

import os
import zlib

import numpy as np
import pytest

from counterpoise.llm import quality, toxicity
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.1"


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("score,label,folds,held,cut", [
    (toxicity.score_toxicity, "toxic", 5, 0, 0.5), (quality.score_quality, "quality", 4, 2, 0.7)])
def test_held_out_accuracy(spark, score, label, folds, held, cut):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (fold(r.doc_id, folds) == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    tested = [r for r in rows if r.held_out]
    truth = np.array([r[label] for r in tested])
    guess = np.array([r.predicted for r in tested])
    points = np.array([r.score for r in tested])
    accuracy = (truth == guess).mean()
    good, bad = points[truth == 1], points[truth == 0]
    area = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    print(label, "accuracy", accuracy, "area", area,
          "of label 1 found", guess[truth == 1].mean(), "of label 0 taken", guess[truth == 0].mean())
    assert accuracy > 0.93 and area > 0.88


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_without_labels_and_odd_texts(spark, score):
    texts = ["", None, "plain words " * 20_000, "\n\n", "a", "é" * 300]
    docs = documents(spark, texts, [1, None, 2, 2, 3, 4]).selectExpr(
        "*", "doc_id AS score", "text AS label", "1 AS predicted")
    for rows in ([], [(1, None, None), (None, 1, 1)], [(1, 1, 1)], [(3, 0, 0), (3, 0, 0)],
                 [(1, 0, 0), (2, 1, 1), (3, 0, 0), (4, 1, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        found = score(docs, labels).collect()
        assert len(found) == len(texts)
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    assert score(docs.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = documents(spark, [f"good text number {k}" if k % 2 else f"ugly ugly {k}"
                             for k in range(60)])
    rows = [(k, k % 2, 1 - k % 2) for k in range(60)]
    for score, folds, held in ((toxicity.score_toxicity, 5, 0), (quality.score_quality, 4, 2)):
        flipped = [(k, 1 - q, 1 - t) if fold(k, folds) == held else (k, q, t) for k, q, t in rows]
        found = [sorted(map(tuple, score(docs, spark.createDataFrame(
            x, "doc_id long, quality int, toxic int")).collect())) for x in (rows, flipped)]
        assert found[0] == found[1]


def test_the_quality_threshold_covers_all_labelled_rows(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) + "!" * (
        int(rng.random() < share)) for _ in range(rng.integers(5, 60)))
        for share in np.repeat([0.1, 0.3], [300, 100])]
    texts += ["a calm and long text " * 4000 + str(k) for k in range(40)]  # over FIT_BYTES
    rows = [(k, int(k < 300 or k >= 400)) for k in range(440)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    docs = documents(spark, texts)
    model = quality.train_quality(docs, labels, rows=30)
    scores = docs.select("doc_id", quality.quality(docs["text"], model).alias("s")).collect()
    assert sum(r.s < quality.THRESHOLD for r in scores) == 100


@pytest.mark.parametrize("values,bad", [
    ([1.0, 2.0], 1), ([5.0] * 9, 4), (list(range(1000)), 1), (list(range(1000)), 999),
    ([0.0] * 700 + list(range(300)), 500), (np.random.default_rng(0).normal(size=5000), 1234)])
def test_the_threshold_is_exact(spark, monkeypatch, values, bad):
    monkeypatch.setattr(quality, "ACCURACY", 100)
    rows = [(int(k >= bad), float(x)) for k, x in enumerate(values)]
    found = quality.threshold(spark.createDataFrame(rows, "label int, strength double"))
    order = sorted(map(float, values))
    assert found == (order[bad - 1] + order[bad]) / 2


def test_windows_keep_every_word():
    text = b"  one two\n" + b"x" * 500 + b" three four " * 30
    for size in (1, 10, 64, 10_000):
        parts = toxicity.windows(text, size)
        assert b" ".join(parts).split() == text.split()
        assert all(len(p) < size + 500 for p in parts)
    assert toxicity.windows(b" ") == [b""]


def test_toxic_rows_go(spark):
    insults = ["you are a blorfnik", "total zzkretin here", "such a blorfnik zzkretin"]
    texts = [f"{insults[k % 3]} in line {k}" if k % 4 == 0 else f"a calm word in line {k}"
             for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)],
                                   "doc_id long, toxic int")
    docs = documents(spark, texts + [None], [*range(200), 999])
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert 999 in ids
    assert len(ids & set(range(0, 200, 4))) < 5 and len(ids) > 145


