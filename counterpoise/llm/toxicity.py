"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what toxic text
has of its own. A text is cut into windows of words; a window that the compressor with
the toxic dictionary shortens more than the other is closer to toxic text. A logistic
curve over the windows' differences, calibrated on labelled rows that trained no
dictionary, gives the score; 0.5 is the threshold.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from counterpoise.llm.common import fold, id_and_text, table

#: Labelled rows of a class that a model is fitted on: half train the dictionaries, half
#: calibrate. Rows are taken by the hash of their id, texts up to FIT_BYTES.
FIT_ROWS = 3000
FIT_BYTES = 32_000

#: Least bytes of a window; words are not cut.
WINDOW = 64

#: Length of the byte strings that mark toxic text (a word counts with a blank before it),
#: the share of toxic rows that must hold one, and how much more often than in ordinary
#: text it must occur per word.
GRAM, GRAM_SHARE, GRAM_LIFT = 5, 0.03, 10.0

ORDINARY_DICTIONARY, TOXIC_DICTIONARY = 32_768, 1_024

#: Windows of ordinary fit texts that train its dictionary: of all of them, those with the
#: least hash.
PLAIN_WINDOWS = 60_000

#: Bytes that a window must be shorter by before the difference counts.
NOISE = 1


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Whole words, in order, so many that a window has ``size`` bytes; one at least."""
    words = text.split()
    if not words:
        return [b""]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    joined = b" ".join(words)
    out, a = [], 0
    while a < len(joined):
        k = int(np.searchsorted(ends, a + size))
        b = int(ends[min(k, len(ends) - 1)])
        out.append(joined[a:b - 1])
        a = b
    return out


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _words(text: bytes) -> list[bytes]:
    return [b" " + w for w in _WORD.findall(text)]


def _occurrences(texts: list[bytes]) -> tuple[Counter, Counter, int]:
    """Of byte strings: how often they occur and in how many texts; the number of words."""
    often, held, total = Counter(), Counter(), 0
    for text in texts:
        own: Counter = Counter()
        for word, n in Counter(_words(text)).items():
            total += n
            for gram in {word[k:k + GRAM] for k in range(len(word) - GRAM + 1)}:
                own[gram] += n
        often.update(own)
        held.update(own.keys())
    return often, held, total


def _marks(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Byte strings that toxic texts have much more often than ordinary ones."""
    often, held, words = _occurrences(toxic)
    other, _, rest = _occurrences(ordinary)
    least = max(3, GRAM_SHARE * len(toxic))
    return {g for g, n in often.items() if held[g] >= least
            and n / max(1, words) > GRAM_LIFT * (other[g] + 1) / max(1, rest)}


def _own_parts(text: bytes, own: set[bytes]) -> list[bytes]:
    """The longest parts of the words of ``text`` that strings of ``own`` cover."""
    out = []
    for word in _words(text):
        end = start = -1
        for k in range(len(word) - GRAM + 1):
            if word[k:k + GRAM] in own:
                if k > end:
                    if end >= 0:
                        out.append(word[start:end])
                    start = k
                end = k + GRAM
        if end >= 0:
            out.append(word[start:end])
    return out


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples. The trainer drops what few samples share; the samples
    themselves fill what it leaves of ``size``, the most common ones last."""
    try:
        content = zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        content = b""
    rest, room = [], size - len(content)
    for sample, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        room -= len(sample) + 1
        if room < 0:
            break
        rest.append(sample)
    return b" ".join([content, *rest[::-1]])


@dataclass(frozen=True)
class Toxicity:
    """``weights`` of (1, largest difference, log sum of differences, log windows)."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for content in (self.ordinary, self.ordinary + b" " + self.toxic + b" "):
            params = zstandard.ZstdCompressionParameters(
                window_log=17, hash_log=17, chain_log=17, min_match=5,
                strategy=zstandard.STRATEGY_DFAST, write_checksum=False,
                write_content_size=False)
            held = zstandard.ZstdCompressionDict(
                content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        return made

    def scores(self, texts: list[str | None]) -> np.ndarray:
        both = self.compressors()
        rows = np.array([features(both, lowered(t)) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(rows @ np.array(self.weights), -500, 500)))


def features(both: list[zstandard.ZstdCompressor], text: bytes) -> list[float]:
    parts = windows(text)
    lengths = []
    for c in both:
        n: list[int] = []
        for a in range(0, len(parts), 4096):
            n += [len(x) for x in c.multi_compress_to_buffer([p or b" " for p in parts[a:a + 4096]])]
        lengths.append(np.array(n))
    gain = lengths[0] - lengths[1]
    return [1.0, float(max(0, gain.max())),
            float(np.log1p(np.maximum(gain - NOISE, 0).sum())), float(np.log(len(parts)))]


def logistic(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray,
             ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method; the first column is the constant."""
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (weight * (p - labels)) + ridge * w
        curve = (rows * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows
        step = np.linalg.solve(curve + ridge * np.eye(len(w)), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(toxic: list[bytes], ordinary: list[bytes], n_toxic: int, n_ordinary: int) -> Toxicity:
    """A model from two lists of lower-case texts; the counts are those of all labelled
    rows. Without texts of both classes the score is the share of toxic rows."""
    total = n_toxic + n_ordinary
    if not toxic or not ordinary:
        share = min(max(n_toxic / total if total else 0.0, 1e-6), 1 - 1e-6)
        return Toxicity(b" ", b" ", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    train = [toxic[::2], ordinary[::2]]
    check = [toxic[1::2] or toxic, ordinary[1::2] or ordinary]
    own = _marks(*train)
    parts = [p for text in train[0] for p in _own_parts(text, own)]
    plain = [w for text in train[1] for w in windows(text) if not _own_parts(w, own)]
    plain.sort(key=lambda w: (xxh64_intdigest(w), w))
    model = Toxicity(_trained(ORDINARY_DICTIONARY, plain[:PLAIN_WINDOWS]),
                     _trained(TOXIC_DICTIONARY, parts) or b" ", (0.0,) * 4)
    both = model.compressors()
    rows = np.array([features(both, t) for k in range(2) for t in check[k]])
    labels = np.repeat([1.0, 0.0], [len(check[0]), len(check[1])])
    each = np.repeat([n_toxic / len(check[0]), n_ordinary / len(check[1])],
                     [len(check[0]), len(check[1])])
    each = each * len(rows) / each.sum()
    return Toxicity(model.ordinary, model.toxic, tuple(logistic(rows, labels, each).tolist()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column,
                    rows: int, text_bytes: int) -> tuple[list[list], list[int]]:
    """Texts of the classes 1 and 0, at most ``rows`` each, and the numbers of labelled rows.

    Only rows for which ``train`` (of doc_id) holds. The sample is taken by the hash of
    the id and joined to the documents by a broadcast of ``rows`` ids at most. A document
    with several labels has the largest.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
             .groupBy("doc_id").agg(F.max(label).alias("label")))
    counts = {int(r["label"] > 0): r["n"] for r in known.groupBy(
        (F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    texts = []
    for value in (1, 0):
        chosen = (known.filter((F.col("label") > 0) == F.lit(bool(value)))
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id"))
        found = (id_and_text(docs).filter(F.octet_length("text") <= text_bytes)
                 .join(F.broadcast(chosen), "doc_id"))
        texts.append([r["text"] for r in found.orderBy(
            F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).collect()])
    return texts, [counts.get(1, 0), counts.get(0, 0)]


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None,
                   rows: int = FIT_ROWS) -> Toxicity:
    """A model from the labelled documents (``labels``: doc_id, toxic) that ``train`` allows."""
    texts, counts = labelled_sample(
        docs, labels, "toxic", F.lit(True) if train is None else train, rows, FIT_BYTES)
    return fit([lowered(t) for t in texts[0]], [lowered(t) for t in texts[1]], *counts)


def toxicity(text: Column, model: Toxicity) -> Column:
    """Score of a text column (null: empty), 0 to 1. Every text is read whole, in windows
    of bounded size; scores depend on nothing but the text."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        both = model.compressors()
        weights = np.array(model.weights)
        rows = np.array([features(both, lowered(x.as_py())) for x in column]).reshape(-1, 4)
        return pa.array(1 / (1 + np.exp(-np.clip(rows @ weights, -500, 500))))

    return score(text)


#: Rows whose fold is HELD_OUT train nothing.
FOLDS, HELD_OUT = 5, 0


def default_model(docs: DataFrame, labels: DataFrame) -> Toxicity:
    return train_toxicity(docs, labels, fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows whose text scores 0.5 or more."""
    model = default_model(docs, labels)
    return docs.filter(toxicity(F.coalesce(F.col("text"), F.lit("")), model) < 0.5)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (null text: empty).

    Rows that repeat are scored each; a null doc_id falls in the fold of the empty text;
    other columns are not read; an empty table gives no rows.
    """
    model = default_model(docs, labels)
    scored = id_and_text(docs).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark, folder: str) -> DataFrame:
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
