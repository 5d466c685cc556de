"""Token log-probabilities of a log-bilinear model trained with noise-contrastive estimation.

The vocabulary is open, so a token's probability is that of its class, given the classes
of the two tokens before it, times that of the token within its class. The classes are
the end mark, the most frequent words and groups of words with the same beginning. The
class model is log-bilinear: position weights turn the context's vectors into a prediction,
whose products with all classes' vectors are normalised; as there are few contexts, batched
matrix products give the whole table of log-probabilities. It is trained on the class
trigrams of all training tokens, counted by Spark. Within a class, and for the base score,
a token's probability comes from its count in all training tokens.

Texts are read once: a bundle of documents is stored as the list of its distinct tokens
(64-bit hashes) and their places. Counts travel to the bundles by joins on the token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import (
    byte_view,
    fold,
    id_and_text,
    prefix_hash,
    run_hash,
    slices,
    stored,
    table,
)

#: Classes: the end mark, FREQUENT words, and the rest by the hash of their beginning.
CLASSES, FREQUENT = 128, 47

#: Bytes of a word's beginning that choose its class.
BEGINNING = 3

#: Bytes of text in a bundle.
BUNDLE_BYTES = 4 << 20

#: Rows whose fold is HELD_OUT train nothing.
FOLDS, HELD_OUT = 5, 1

#: Hash and group that stand for the end mark.
END_TOKEN, END_GROUP = 0, 255
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokenized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after the other: token hashes, group by beginning, tokens per text.

    Every text ends with END_TOKEN. Groups count from 0; the end mark has END_GROUP.
    """
    texts = len(offsets) - 1
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    sums = prefix_hash(data)
    words = run_hash(sums, starts, stops).view(np.int64)
    words[words == END_TOKEN] = 1
    groups = run_hash(sums, starts, np.minimum(stops, starts + BEGINNING))
    groups = (groups % np.uint64(CLASSES - 1 - FREQUENT)).astype(np.uint8)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(owner, minlength=texts)
    total = count + 1
    tokens = np.full(int(total.sum()), END_TOKEN, np.int64)
    group = np.full(len(tokens), END_GROUP, np.uint8)
    body = np.ones(len(tokens), bool)
    body[np.cumsum(total) - 1] = False
    tokens[body], group[body] = words, groups
    return tokens, group, total


BUNDLE = ("bundle string, doc_ids array<long>, held_out array<boolean>, n_tokens array<long>, "
          "places binary, tokens array<long>, groups binary, counts array<long>")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, packer = 0, zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch, size=BUNDLE_BYTES):
            tokens, group, total = tokenized(*byte_view(part.column("text")))
            held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            distinct, first, places = np.unique(tokens, return_index=True, return_inverse=True)
            train = np.repeat(~held, total)
            counts = np.bincount(places[train], minlength=len(distinct))
            name = f"{TaskContext.get().partitionId()}-{number}"
            number += 1
            yield pa.RecordBatch.from_arrays([
                pa.array([name]), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([held.tolist()], pa.list_(pa.bool_())),
                pa.array([total], pa.list_(pa.int64())),
                pa.array([packer.compress(places.astype("<i4").tobytes())], pa.binary()),
                pa.array([distinct], pa.list_(pa.int64())),
                pa.array([group[first].tobytes()], pa.binary()),
                pa.array([counts], pa.list_(pa.int64()))], [c.split()[0] for c in BUNDLE.split(", ")])


def bundled(docs: DataFrame, held_out: Column) -> DataFrame:
    """The documents as bundles of token places, stored."""
    return stored(id_and_text(docs, held_out.alias("held_out")).mapInArrow(_bundles, BUNDLE), "bundles")


def token_counts(bundles: DataFrame) -> DataFrame:
    """(token, c, grp) of every token of the training documents, stored."""
    rows = bundles.mapInArrow(_bundle_tokens, "bundle string, at int, token long, grp int, n long")
    return stored(rows.filter("n > 0").groupBy("token").agg(
        F.sum("n").alias("c"), F.min("grp").alias("grp")), "token-counts")


def _bundle_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            tokens = batch.column("tokens")[k].values
            group = np.frombuffer(batch.column("groups")[k].as_py(), np.uint8)
            n = len(tokens)
            for a in range(0, n, 50_000):
                b = min(n, a + 50_000)
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("bundle")[k].as_py()] * (b - a)),
                    pa.array(np.arange(a, b, dtype=np.int32)), tokens[a:b],
                    pa.array(group[a:b].astype(np.int32)),
                    batch.column("counts")[k].values[a:b]], ["bundle", "at", "token", "grp", "n"])


@dataclass(frozen=True)
class Classes:
    """Numbers of the training tokens: all, distinct, and of each class; the classes'
    frequent words in the order of their numbers, from 1 on."""

    train_tokens: int
    distinct: int
    tokens_of: np.ndarray
    distinct_of: np.ndarray
    frequent: np.ndarray

    def of(self, tokens: np.ndarray, group: np.ndarray) -> np.ndarray:
        out = by_group(group)
        order = np.argsort(self.frequent)
        known = self.frequent[order]
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            hit = known[at] == tokens
            out[hit] = order[at[hit]] + 1
        return out

    def column(self) -> Column:
        """The class of a row of ``token`` and ``grp``."""
        place = F.when(F.col("token") == END_TOKEN, F.lit(0))
        for k, token in enumerate(self.frequent.tolist()):
            place = place.when(F.col("token") == token, F.lit(k + 1))
        return place.otherwise(F.col("grp") + 1 + FREQUENT)


def by_group(group: np.ndarray) -> np.ndarray:
    """Classes of tokens that are not frequent words."""
    return np.where(group == END_GROUP, 0, group.astype(np.int64) + 1 + FREQUENT)


def classes(counts: DataFrame) -> Classes:
    top = [r["token"] for r in counts.filter(F.col("token") != END_TOKEN)
           .orderBy(F.desc("c"), "token").limit(FREQUENT).collect()]
    tokens_of, distinct_of = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    named = Classes(0, 0, tokens_of, distinct_of, np.array(top, np.int64))
    for r in counts.groupBy(named.column().alias("k")).agg(
            F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens_of[r["k"]], distinct_of[r["k"]] = r["c"], r["v"]
    return Classes(int(tokens_of.sum()), int(distinct_of.sum()), tokens_of, distinct_of,
                   named.frequent)


def contexts(kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For each token the classes of the two before it as one number; before a text's
    first token stands the end mark."""
    one, two = np.zeros_like(kinds), np.zeros_like(kinds)
    one[1:], two[2:] = kinds[:-1], kinds[:-2]
    first = np.cumsum(total) - total
    one[first] = 0
    two[first] = 0
    second = first[total > 1] + 1
    two[second] = 0
    return two * CLASSES + one


def trigrams(bundles: DataFrame, found: Classes) -> DataFrame:
    """(cell, n): how often a class follows a context in the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                tokens = row["tokens"].values.to_numpy()
                group = np.frombuffer(row["groups"].as_py(), np.uint8)
                places, total, held = _texts(row)
                kinds = found.of(tokens, group)[places]
                train = np.repeat(~held, total)
                cell = contexts(kinds, total) * CLASSES + kinds
                np.add.at(cells, cell[train], 1)
        some = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(cells[some])], ["cell", "n"])

    return (bundles.select("places", "tokens", "groups", "n_tokens", "held_out")
            .mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")))


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bundle's texts: the places of their tokens, their numbers, which are held out."""
    total = row["n_tokens"].values.to_numpy()
    places = zstandard.ZstdDecompressor().decompress(
        row["places"].as_py(), max_output_size=max(1, 4 * int(total.sum())))
    held = row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool)
    return np.frombuffer(places, "<i4"), total, held


@dataclass(frozen=True)
class Training:
    """Settings of noise-contrastive estimation: ``batch`` contexts a step, and ``noise``
    noise classes to each observed one."""

    width: int = 24
    noise: int = 32
    batch: int = 2048
    steps: int = 3000
    rate: float = 0.15
    seed: int = 11


def _summed(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each class."""
    return np.stack([np.bincount(kinds, column, CLASSES) for column in rows.T], 1)


def _dealt(cell: np.ndarray, n: np.ndarray, batch: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All counted cells as (contexts, counts by class) of at most ``batch`` contexts each,
    which weigh about the same."""
    context, row = np.unique(cell // CLASSES, return_inverse=True)
    seen = np.zeros((len(context), CLASSES))
    np.add.at(seen, (row, cell % CLASSES), n)
    order = np.argsort(-seen.sum(1), kind="stable")
    parts = -(-len(context) // batch)
    return [(context[order[k::parts]], seen[order[k::parts]]) for k in range(parts)]


def train(cell: np.ndarray, n: np.ndarray, how: Training = Training()) -> np.ndarray:
    """Log10-probabilities, contexts x classes, of the log-bilinear model.

    Nothing is drawn: a step takes some of the contexts with the counts of all classes that
    follow them, and the noise at its expectation, and moves the weights (Adagrad) to tell
    them apart. Steps go on to the end of a pass over all contexts, so each counted trigram
    trains as often as it was counted, pass by pass. Afterwards the scores are normalised
    over all classes.
    """
    rng = np.random.default_rng(how.seed)
    share = np.full(CLASSES, 0.5)
    if len(cell):
        np.add.at(share, cell % CLASSES, n)
    share = share / share.sum()
    vectors = rng.normal(0, 0.1, (CLASSES, how.width))
    words = rng.normal(0, 0.1, (CLASSES, how.width))
    near, far = np.ones(how.width), np.ones(how.width)
    bias = np.log(share)
    weights = [vectors, words, near, far, bias]
    speed = [np.full_like(w, 1e-2) for w in weights]
    log_noise = np.log(how.noise * share)
    parts = _dealt(cell, n, how.batch)
    scale = CLASSES * len(parts) / max(1, n.sum())
    passes = -(-how.steps // len(parts)) if parts else 0
    for at in (k for _ in range(passes) for k in rng.permutation(len(parts))):
        context, seen = parts[at]
        two, one = np.divmod(context, CLASSES)
        guess = vectors[one] * near + vectors[two] * far
        odds = guess @ words.T + (bias - log_noise)
        data = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))       # P(data)
        # observed classes go up by 1 - P(data), noise classes down by P(data)
        up = seen - data * (seen + how.noise * seen.sum(1, keepdims=True) * share)
        by_guess = up @ words
        slopes = [
            _summed(one, by_guess * near) + _summed(two, by_guess * far),
            up.T @ guess,
            (by_guess * vectors[one]).sum(0), (by_guess * vectors[two]).sum(0),
            up.sum(0)]
        for w, g, s in zip(weights, slopes, speed):
            g = g * scale
            s += g * g
            w += how.rate * g / np.sqrt(s)
    two, one = np.divmod(np.arange(CLASSES ** 2), CLASSES)
    scores = (vectors[one] * near + vectors[two] * far) @ words.T + bias
    scores -= scores.max(1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(1, keepdims=True))
    return (scores / np.log(10)).astype(np.float32)


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def score_bundles(bundles: DataFrame, counts: DataFrame, found: Classes,
                  model: np.ndarray) -> DataFrame:
    """Scores of all documents. The counts of a bundle's tokens come by two joins: on the
    token, and on the bundle."""
    rows = bundles.select("bundle", "tokens", "groups", "counts").mapInArrow(
        _bundle_tokens, "bundle string, at int, token long, grp int, n long")
    named = counts.select("token", "c", found.column().cast("byte").alias("kind"))
    known = (rows.select("bundle", "at", "token").join(named, "token")
             .groupBy("bundle").agg(F.collect_list(F.struct(
                 (F.col("at").cast("long") * CLASSES + F.col("kind")).alias("key"), "c"))
                 .alias("known")))
    joined = bundles.drop("counts", "tokens").join(known, "bundle", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_of, distinct_of = found.tokens_of, found.distinct_of
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                places, total, held = _texts(row)
                kinds = by_group(np.frombuffer(row["groups"].as_py(), np.uint8))
                c = np.zeros(len(kinds), np.int64)
                if row["known"].is_valid:
                    pairs = row["known"].values
                    at, kind = np.divmod(pairs.field("key").to_numpy(), CLASSES)
                    c[at] = pairs.field("c").to_numpy()
                    kinds[at] = kind
                seen, kinds = c[places], kinds[places]
                base = np.log10((seen + 0.5) / (found.train_tokens + 0.5 * (found.distinct + 1)))
                inside = np.log10((seen + 0.5) / (total_of[kinds] + 0.5 * (distinct_of[kinds] + 1)))
                # the end mark and the frequent words are all of their class
                inside[kinds <= len(found.frequent)] = 0.0
                ahead = model[contexts(kinds, total), kinds].astype(np.float64)
                first = np.cumsum(total) - total

                def per_text(values):
                    return np.add.reduceat(values, first) if len(first) else values[:0]

                yield pa.RecordBatch.from_arrays([
                    row["doc_ids"].values, pa.array(held), pa.array(total),
                    pa.array(per_text((seen > 0).astype(np.int64))),
                    pa.array(np.full(len(total), found.train_tokens)),
                    pa.array(per_text(base)), pa.array(per_text(ahead + inside))],
                    [s.split()[0] for s in SCORES.split(", ")])

    return joined.mapInArrow(run, SCORES)


def score_documents(docs: DataFrame, held_out: Column, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from the rows for which ``held_out`` is false, scores all. A null text is empty
    and has one token, its end; rows that repeat count and are scored each; a null doc_id
    is kept; other columns are not read; an empty table gives no rows. Without training
    rows every token is unknown and the class model is uniform over nothing but chance.
    """
    bundles = bundled(docs, held_out)
    counts = token_counts(bundles)
    found = classes(counts)
    # at most CLASSES ** 3 cells come to the driver, whatever the size of the corpus
    cells = trigrams(bundles, found).toArrow().sort_by("cell")
    model = train(cells["cell"].to_numpy(), cells["n"].to_numpy(), how)
    return score_bundles(bundles, counts, found, model)


def op3_lm_scores(spark, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"),
                           fold(F.col("doc_id"), FOLDS) == HELD_OUT)


QUERIES = {"op3_lm_scores": op3_lm_scores}
ORACLE: dict[str, str] = {}
