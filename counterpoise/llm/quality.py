"""Document quality by pairwise ranking.

A Bradley-Terry model: the odds that a document is preferred to another are the ratio of
their strengths, and the log strength is linear in features of the text. Preference pairs
are a labelled good and a labelled bad document; the logistic loss on the differences of
their features is minimised. A quantile of the learned scores is the threshold.

The weights come from a bounded sample of the labelled rows, the threshold from all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import fold, id_and_text, stored, table
from counterpoise.llm.toxicity import labelled_sample

#: Labelled rows of a class that a model is fitted on, the largest text among them, and
#: the number of preference pairs.
FIT_ROWS = 4000
FIT_BYTES = 64_000
PAIRS = 40_000

#: Parts of the rows that the first step of the threshold tells apart.
ACCURACY = 10_000

#: Rows whose fold is HELD_OUT train nothing. Scores from THRESHOLD on count as good.
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

_UPPER, _LETTER, _DIGIT, _SYMBOL, _ENDING = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_SYMBOL[list(b'"#$%&*+/<=>@[\\]^_`{|}~')] = True
_ENDING[list(b"!?;")] = True
_SPLIT_LINES = re.compile(rb"\n")

FEATURES = 12


def features(text: str | None) -> list[float]:
    """Shares of characters, repeated words and lines, lengths; all finite, empty texts too."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    letters = max(1, int(count[_LETTER].sum()))
    words = raw.split()
    n = max(1, len(words))
    common = Counter(words)
    most = common.most_common(1)[0][1] if common else 0
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in _SPLIT_LINES.split(raw) if x.strip()]
    return [
        min(1.0, count[_UPPER].sum() / letters), np.sqrt(count[_UPPER].sum() / letters),
        np.sqrt(count[_SYMBOL].sum() / size), np.sqrt(count[_ENDING].sum() / size),
        np.sqrt(count[_DIGIT].sum() / size), np.sqrt(adjacent / n),
        len(common) / n, most / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(words)), np.log1p(len(raw) / n),
        np.log1p(len(common)) / np.log1p(n),
    ]


@dataclass(frozen=True)
class Quality:
    """Score: a logistic curve of features x weights, THRESHOLD where that equals ``cut``."""

    weights: tuple[float, ...]
    cut: float

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return rows @ np.array(self.weights)

    def score(self, strength: Column) -> Column:
        shift = float(np.log(THRESHOLD / (1 - THRESHOLD)))
        x = strength - F.lit(self.cut) + F.lit(shift)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def fit(good: np.ndarray, bad: np.ndarray,
        pairs: int = PAIRS, ridge: float = 1.0, steps: int = 50) -> Quality:
    """The weights of a model, from the features of good and bad documents; ``cut`` is for
    ``threshold`` to find. Without documents of both classes the weights are zero, and every
    score is 1 or, if all are bad, 0.5."""
    if not len(good) or not len(bad):
        return Quality((0.0,) * FEATURES, 1.0 if len(bad) else -5.0)
    both = np.concatenate([good, bad])
    middle, scale = both.mean(0), both.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    rng = np.random.default_rng(7)
    difference = (good[rng.integers(0, len(good), pairs)]
                  - bad[rng.integers(0, len(bad), pairs)]) / scale
    w = np.zeros(both.shape[1])
    for _ in range(steps):  # the preferred document comes first: the loss is log(1+exp(-x))
        p = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        slope = -difference.T @ p + ridge * w
        curve = (difference * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ difference
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Quality(tuple((w / scale).tolist()), 0.0)


def threshold(rated: DataFrame) -> float | None:
    """The strength below which lies as large a share of ``rated`` (label, strength) as is
    bad: half-way between the two rows next to it. None without rows of both classes.

    It is exact and takes all rows: a sketch gives borders around the place, and only the
    distinct strengths between them, about one in ACCURACY, come to the driver.
    """
    n, bad = rated.agg(F.count("*"), F.count_if(F.col("label") <= 0)).first()
    if not 0 < bad < n:
        return None
    margin = 2 / ACCURACY
    while True:
        low, high = rated.agg(F.percentile_approx("strength", [
            max(0.0, bad / n - margin), min(1.0, (bad + 1) / n + margin)], ACCURACY)).first()[0]
        below = rated.filter(F.col("strength") < low).count()
        near = sorted(map(tuple, rated.filter(F.col("strength").between(low, high))
                          .groupBy("strength").agg(F.count("*").alias("n")).collect()))
        upto = below + np.cumsum([k for _, k in near])
        if below < bad and upto[-1] > bad:
            first, second = np.searchsorted(upto, [bad, bad + 1])
            return float((near[first][0] + near[second][0]) / 2)
        margin *= 4


def fitted(docs: DataFrame, labels: DataFrame, train: Column, rows: int = FIT_ROWS) -> Quality:
    texts, _ = labelled_sample(docs, labels, "quality", train, rows, FIT_BYTES)
    good, bad = (np.array([features(t) for t in part]).reshape(-1, FEATURES) for part in texts)
    return fit(good, bad)


def with_threshold(model: Quality, rated: DataFrame, labels: DataFrame, train: Column) -> Quality:
    """``model`` with the cut by all rows of ``rated`` (doc_id, strength) that ``train``
    allows and ``labels`` names. A document with several labels has the largest."""
    if not any(model.weights):
        return model
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train)
             .groupBy("doc_id").agg(F.max("quality").alias("label")))
    cut = threshold(rated.select("doc_id", "strength").join(known, "doc_id"))
    return model if cut is None else replace(model, cut=cut)


def train_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None,
                  rows: int = FIT_ROWS) -> Quality:
    """A model from the labelled documents (``labels``: doc_id, quality) that ``train`` allows."""
    train = F.lit(True) if train is None else train
    model = fitted(docs, labels, train, rows)
    return with_threshold(model, stored(rate(docs, model), "strengths"), labels, train)


def rate(docs: DataFrame, model: Quality, *more: Column) -> DataFrame:
    """doc_id, strength and ``more`` of every row of ``docs`` (null text: empty)."""
    return id_and_text(docs, *more).withColumn("strength", strength(F.col("text"), model)).drop("text")


def strength(text: Column, model: Quality) -> Column:
    """Strength of a text column (null: empty), from the whole text and nothing else."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        rows = np.array([features(x.as_py()) for x in column]).reshape(-1, FEATURES)
        return pa.array(model.strength(rows))

    return score(text)


def quality(text: Column, model: Quality) -> Column:
    """Score of a text column (null: empty), 0 to 1."""
    return model.score(strength(text, model))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (null text: empty).

    Rows that repeat are scored each; a null doc_id falls in the fold of the empty text;
    other columns are not read; an empty table gives no rows.
    """
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = fitted(docs, labels, ~held)
    rated = stored(rate(docs, model), "strengths")
    model = with_threshold(model, rated, labels, ~held)
    scored = rated.select(
        "doc_id", held.alias("held_out"), model.score(F.col("strength")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_quality(spark, folder: str) -> DataFrame:
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
