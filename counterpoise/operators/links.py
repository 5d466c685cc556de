"""Opposite-label nearest-neighbour links and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import Features
from counterpoise.operators.neighbors import knn_join

MODES = ("one_sided", "mutual")


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def nearest_labels(df: DataFrame, key: str, features: Features, label: str, *,
                   metric: str = "euclidean", strategy: str = "auto") -> DataFrame:
    """Every row with its nearest neighbour and both labels: (id, label, nid, nlabel, dist)."""
    found = knn_join(df, df, k=1, key=key, features=features, metric=metric,
                     query_columns=[label], candidate_columns=[label], strategy=strategy)
    return found.select(F.col("qid").alias("id"), F.col(f"q_{label}").alias("label"),
                        "nid", F.col(f"n_{label}").alias("nlabel"), "dist")


def opposite_links(labelled: DataFrame) -> DataFrame:
    """Directed links: rows whose nearest neighbour carries another label."""
    return labelled.where(~F.col("label").eqNullSafe(F.col("nlabel")))


def mutual_pairs(links: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest neighbour: (low, high), once per pair."""
    ends = links.select(F.least("id", "nid").alias("low"), F.greatest("id", "nid").alias("high"))
    return (ends.groupBy("low", "high").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == 2).select("low", "high"))


def removed_ids(links: DataFrame, mode: str = "one_sided") -> DataFrame:
    """Distinct ids to remove.

    ``one_sided`` takes both ends of every directed link, ``mutual`` both ends of the
    mutual pairs only. A popular neighbour is reduced map-side by the distinct.
    """
    check_mode(mode)
    if mode == "mutual":
        # A row has one nearest neighbour, so it is in at most one pair.
        pairs = mutual_pairs(links)
        return pairs.select(F.explode(F.array("low", "high")).alias("id"))
    return links.select(F.explode(F.array("id", "nid")).alias("id")).distinct()


def drop_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is not listed."""
    gone = ids.select(F.col("id").alias(key))
    return df.join(gone, key, "left_anti")


def link_report(df: DataFrame, links: DataFrame, mode: str = "one_sided") -> DataFrame:
    """(n_rows, n_directed, n_mutual_pairs, n_removed, n_kept) in one row."""
    parts = [("n_rows", df), ("n_directed", links), ("n_mutual_pairs", mutual_pairs(links)),
             ("n_removed", removed_ids(links, mode))]
    counts = None
    for name, part in parts:
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        counts = one if counts is None else counts.unionByName(one)
    wide = counts.agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name)
                        for name, _ in parts])
    return wide.withColumn("n_kept", F.col("n_rows") - F.col("n_removed"))
