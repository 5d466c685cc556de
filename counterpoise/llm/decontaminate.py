"""Benchmark decontamination with a broadcast set of n-grams, in DataFrame functions only.

A benchmark window is WINDOW consecutive words of an item (all words, if it has fewer). A
document is first probed at every few words with shorter grams: any place of a window
covers a probed gram, so documents without a hit are done. In the others every window is
looked up by hash, and hits are verified by joining their words to the benchmark's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.common import table

#: Words of a window.
WINDOW = 10

#: What separates words: all ASCII characters but letters and digits.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest number of benchmark grams that travel to all tasks as a set; beyond it the
#: probed grams are rows that are joined, with the same result.
BROADCAST_GRAMS = 50_000


def words_of(text: Column) -> Column:
    """Words of a text as an array: A-Z lower-cased, other characters left; null: none."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def gram_of(length: int) -> int:
    """Length of the probed grams for windows of ``length`` words; they are probed every
    ``length - gram + 1`` words, so a window covers one wherever it starts."""
    return (length + 1) // 2


def _hash_at(words: Column, start: Column, length: int) -> Column:
    return F.xxhash64(*(F.element_at(words, (start + (k + 1)).cast("int")) for k in range(length)))


def _among(hashes: list[int], length: int) -> Callable[[Column], Column]:
    return lambda start: _hash_at(F.col("_w"), start, length).isin(hashes)


def _probe(length: int) -> Callable[[Column], Column]:
    return lambda start: F.struct(
        F.lit(length).alias("m"), _hash_at(F.col("_w"), start, gram_of(length)).alias("h"))


def _starts(words: Column, length: int, step: int) -> Column:
    """Positions 0, step, ... at which ``length`` words lie in ``words``."""
    last = F.size(words) - length
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(
        F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, words, grams) of every distinct window; items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(window))
    at = F.sequence(F.lit(1), F.size("_w") - length + 1)
    rows = items.select("item_id", length.alias("length"), F.explode(F.transform(
        at, lambda k: F.slice("_w", k, length))).alias("words"))
    return rows.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    A null text has no words; an empty benchmark hits nothing; items that repeat an id
    count once, and a null item_id is left out of the ids but its windows hit. Rows of
    ``docs`` that repeat come back each; a null doc_id is kept; other columns are not read.
    """
    windows = benchmark_windows(benchmark, window)
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    words = docs.select("doc_id", F.xxhash64("text").alias("_text"),
                        words_of(F.col("text")).alias("_w"))
    hits = [F.array().cast(HITS)]
    for length in lengths:
        grams, whole = (_bounded(x) for x in _benchmark_grams(windows, length))
        if grams is None or whole is None:
            return _digest(_probed_by_join(words, windows, lengths), windows)
        probed = F.exists(
            _starts(F.col("_w"), gram_of(length), length - gram_of(length) + 1),
            _among(grams, gram_of(length)))
        hits.append(F.when(probed, _windows_at(F.filter(
            _starts(F.col("_w"), length, 1),
            _among(whole, length)), length)))
    found = F.concat(*(F.coalesce(h, F.array().cast(HITS)) for h in hits))
    return _digest(words.select(
        "doc_id", "_text", F.size("_w").cast("long").alias("n_words"), found.alias("hits")), windows)


HITS = "array<struct<pos:int,words:array<string>>>"


def _windows_at(starts: Column, length: int) -> Column:
    return F.transform(starts, lambda k: F.struct(
        k.alias("pos"), F.slice("_w", k + 1, length).alias("words")))


def _benchmark_grams(windows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Hashes of the probed grams and of the whole windows of one length."""
    own, gram = windows.filter(F.col("length") == length), gram_of(length)
    grams = own.select(F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(length - gram)),
        lambda k: _hash_at(F.col("words"), k, gram))).alias("h")).distinct()
    return grams, own.select(_hash_at(F.col("words"), F.lit(0), length).alias("h")).distinct()


def _bounded(hashes: DataFrame) -> list[int] | None:
    found = hashes.limit(BROADCAST_GRAMS + 1).collect()
    return [r["h"] for r in found] if len(found) <= BROADCAST_GRAMS else None


def _probed_by_join(words: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """For a benchmark beyond the bound: probed grams of documents are rows that meet the
    benchmark's grams in a join; documents with a hit give all their windows."""
    hits, probes, grams = [], [], []
    for length in lengths:
        gram = gram_of(length)
        probes.append(F.transform(
            _starts(F.col("_w"), gram, length - gram + 1), _probe(length)))
        grams.append(_benchmark_grams(windows, length)[0].select(F.lit(length).alias("m"), "h"))
        hits.append(_windows_at(_starts(F.col("_w"), length, 1), length))
    known = grams[0]
    for more in grams[1:]:
        known = known.union(more)
    candidates = (words.select("doc_id", "_text", F.explode(F.array_distinct(F.concat(*probes)))
                               .alias("g")).select("doc_id", "_text", "g.*")
                  .join(known, ["m", "h"], "left_semi")
                  .select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"),
                          F.lit(True).alias("_found")).distinct())
    joined = words.join(candidates, F.col("doc_id").eqNullSafe(F.col("_id"))
                        & (F.col("_text") == F.col("_t")), "left")
    return joined.select(
        "doc_id", "_text", F.size("_w").cast("long").alias("n_words"),
        F.when(F.col("_found"), F.concat(*hits)).otherwise(F.array().cast(HITS)).alias("hits"))


def _digest(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Verifies ``hits`` (pos, words) of rows (doc_id, _text, n_words) and sums them up.

    Rows of equal id and text have equal hits: they are one until the end.
    """
    keys = ["doc_id", "_text", "n_words"]
    once = rows.groupBy(*keys).agg(F.count("*").alias("copies"), F.any_value("hits").alias("hits"))
    places = once.select(*keys, "copies", F.explode_outer("hits").alias("hit"))
    items = windows.groupBy(F.col("words").alias("_words")).agg(
        F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    checked = places.join(items, F.col("hit.words") == F.col("_words"), "left")
    # ids of items come once per place; their number is bounded by the benchmark
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids"))))
    spans = F.array_sort(F.collect_set(F.when(F.col("_words").isNotNull(), F.struct(
        F.col("hit.pos").alias("a"), (F.col("hit.pos") + F.size("_words")).alias("b")))))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"])))
            .cast("long").alias("n")))["n"]
    summed = (checked.groupBy(*keys, "copies").agg(flat.alias("ids"), spans.alias("spans"))
              .withColumn("n_hit", covered))
    out = summed.select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all its columns, without the rows that hold a benchmark window.

    Rows without a doc_id are judged like the others, by their text.
    """
    found = contamination(docs.select(
        F.struct("doc_id", F.xxhash64("text").alias("t")).alias("doc_id"), "text"),
        benchmark, window)
    bad = found.filter("contaminated").select(
        F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.t").alias("_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"])
                     & (F.xxhash64(docs["text"]) == bad["_t"]), "left_anti")


def op9_decontaminate(spark, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
b AS (
  SELECT item_id,
         list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
         array_to_string(words[k:k + least(len(words), 10) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS k
        FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, k, n, array_to_string(words[k:k + n - 1], ' ') AS win
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS k
        FROM d, sizes WHERE len(words) >= n)),
hits AS (SELECT dw.rid, dw.k, dw.n, bw.item_id FROM dw JOIN bw USING (win, n)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM hits))
  GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE = {"op9_decontaminate": SQL}
