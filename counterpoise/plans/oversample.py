"""Oversampling: synthetic minority rows up to a wanted class ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.distance import check_metric
from counterpoise.functions.features import (
    Features, feature_names, feature_vector, is_array_column)
from counterpoise.functions.keys import with_row_key
from counterpoise.materialize import materialize
from counterpoise.operators.classes import (
    SamplingPlan, is_minority, majority_rows, measured_minority, minority_rows, partners_per_row,
    plan_of_counts, sampling_plan)
from counterpoise.operators.neighbors import Known, knn_join
from counterpoise.operators.sampling import (
    SEED, SLICE_COPIES, choose_nearest, choose_random, number_copies, replicate_rows, with_copies)
from counterpoise.operators.synthesis import (
    gap_draw, interpolate, interpolate_entries, synthetic_key)

__all__ = ["chosen_partners", "oversample", "oversample_keyless", "oversample_report",
           "passed_through", "sampling_plan", "synthetic_rows"]

CHOICES = ("nearest", "random")

# Bytes of a row key: a hash in hex digits, a colon, a number and its offset.
KEY_BYTES = 104


def check_choice(choose: str, k: int, pct: float) -> None:
    if choose not in CHOICES:
        raise ValueError(f"choose must be one of {CHOICES}, not {choose!r}")
    if partners_per_row(pct) > k:
        raise ValueError(
            f"pct {pct} asks for {partners_per_row(pct)} partners per row, but k is {k}")


def chosen_partners(
    minority: DataFrame, key: str, features: Features, plan: SamplingPlan, *,
    k: int = 5, seed: int = SEED, choose: str = "nearest", metric: str = "euclidean",
    strategy: str = "auto", known: Known | None = None,
) -> DataFrame:
    """Sampled base rows with their n chosen partners, both vectors carried along.

    (qid, copy, rank, nid, dist, qvec, nvec). Choosing the nearest n of k needs no more
    than n neighbours to be found. ``known`` are sizes that need not be measured again.
    """
    # Copies of a base row share its neighbours: they are found once, then repeated.
    found = knn_join(
        with_copies(minority, key, plan.fraction, seed), minority,
        k=plan.n if choose == "nearest" else k, key=key, features=features, metric=metric,
        query_columns=["copies"], vectors=True, strategy=strategy, known=known)
    found = number_copies(found, "q_copies", mean=plan.fraction)
    found = found.select("qid", "copy", "rank", "nid", "dist", "qvec", "nvec")
    if choose == "nearest":
        return choose_nearest(found, plan.n)
    return choose_random(found, plan.n, seed)


def passed_through(df: DataFrame, key: str, features: Features, label: str, minority,
                   plan: SamplingPlan, seed: int = SEED) -> DataFrame:
    """Majority rows as they are and sampled minority rows with their copies, in one scan;
    in two where minority rows have so many copies that these are dealt out."""
    positive = is_minority(label, minority)
    if plan.fraction <= SLICE_COPIES / 2:
        kept = number_copies(with_copies(df, key, plan.fraction, seed, "_copies", among=positive),
                             "_copies", "_copy")
    else:
        rare = replicate_rows(minority_rows(df, label, minority), key, plan.fraction, seed)
        kept = (majority_rows(df, label, minority).withColumn("_copy", F.lit(1))
                .unionByName(rare.withColumnRenamed("copy", "_copy")))
    name = F.col(key).cast("string")
    own = F.when(positive, F.concat_ws(":", F.lit("orig"), name, F.col("_copy").cast("string"))
                 ).otherwise(F.concat_ws(":", F.lit("maj"), name))
    return kept.select(
        own.alias("id"), *_feature_values(df, features), F.col(label).alias("label"),
        F.when(positive, "sampled").otherwise("majority").alias("origin"))


def synthetic_rows(
    rare: DataFrame, key: str, features: Features, plan: SamplingPlan, *,
    k: int = 5, seed: int = SEED, choose: str = "nearest", metric: str = "euclidean",
    strategy: str = "auto", known: Known | None = None,
) -> DataFrame:
    """Interpolated rows (id, features…) for the sampled rows of the minority."""
    partners = chosen_partners(rare, key, features, plan, k=k, seed=seed, choose=choose,
                               metric=metric, strategy=strategy, known=known)
    drawn = partners.withColumn("_u", gap_draw(seed))
    qvec, nvec, u = F.col("qvec"), F.col("nvec"), F.col("_u")
    if is_array_column(rare, features):
        values = [interpolate(qvec, nvec, u).alias(features)]
    else:
        names = feature_names(rare, features)
        values = [v.alias(n) for n, v in
                  zip(names, interpolate_entries(qvec, nvec, u, len(names)))]
    return drawn.select(synthetic_key().alias("id"), *values)


def _row_bytes(df: DataFrame, key: str | None, features: Features) -> Column:
    """Bytes of a row of key and features, or somewhat more."""
    size = F.lit(16.0) if key is None else F.octet_length(F.col(key).cast("string")) + F.lit(32.0)
    if is_array_column(df, features):
        return size + 8 * F.size(features)
    return size + 8 * len(feature_names(df, features))


def _feature_values(df: DataFrame, features: Features) -> list[Column]:
    if is_array_column(df, features):
        return [feature_vector(df, features).alias(features)]
    return [F.col(c).cast("double").alias(c) for c in feature_names(df, features)]


def _labelled(df: DataFrame, label, origin: str) -> DataFrame:
    return df.withColumns({"label": label, "origin": F.lit(origin)})


def oversample(
    df: DataFrame, key: str, features: Features, label: str, minority, pct: float, *,
    k: int = 5, seed: int = SEED, choose: str = "nearest", metric: str = "euclidean",
    strategy: str = "auto",
) -> DataFrame:
    """Rebalance ``df`` so that the minority class reaches ``pct`` % of the majority.

    Returns synthetic rows, all majority rows and the *sampled* minority rows as
    (id, features…, label, origin). ``key`` must be unique; for tables without one see
    ``oversample_keyless``.
    """
    check_choice(choose, k, pct)
    check_metric(metric)
    columns = list(dict.fromkeys([key, *feature_names(df, features)]))
    # Measured, cut into cells, searched and searched for: read the table for it only once.
    rare, n_pos, n_neg, size = measured_minority(
        df, label, minority, columns, _row_bytes(df, key, features))
    plan = plan_of_counts(n_pos, n_neg, minority, pct)
    made = synthetic_rows(rare, key, features, plan, k=k, seed=seed, choose=choose,
                          metric=metric, strategy=strategy, known=Known(n_pos, size))
    made = _labelled(made, F.lit(minority).cast(df.schema[label].dataType), "synthetic")
    return made.unionByName(passed_through(df, key, features, label, minority, plan, seed))


def oversample_keyless(
    df: DataFrame, features: Features, label: str, minority, pct: float, *,
    k: int = 5, seed: int = SEED, choose: str = "nearest", metric: str = "euclidean",
    strategy: str = "auto",
) -> DataFrame:
    """The same for a table without a unique key: (features…, label, origin).

    Only minority rows are keyed, by content; the majority passes through untouched
    without a shuffle.
    """
    check_choice(choose, k, pct)
    check_metric(metric)
    values = _feature_values(df, features)
    content, n_pos, n_neg, size = measured_minority(
        df, label, minority, values, _row_bytes(df, None, features))
    plan = plan_of_counts(n_pos, n_neg, minority, pct)
    rare = materialize(with_row_key(content, "_key"))
    made = synthetic_rows(rare, "_key", features, plan, k=k, seed=seed, choose=choose, metric=metric,
                          strategy=strategy, known=Known(n_pos, size + n_pos * KEY_BYTES)).drop("id")
    name = F.lit(minority).cast(df.schema[label].dataType)
    sampled = replicate_rows(rare, "_key", plan.fraction, seed).drop("_key", "copy")
    rest = majority_rows(df, label, minority)
    rest = rest.select(*values, F.col(label).alias("label"), F.lit("majority").alias("origin"))
    return (_labelled(made, name, "synthetic").unionByName(_labelled(sampled, name, "sampled"))
            .unionByName(rest))


def oversample_report(balanced: DataFrame) -> DataFrame:
    """Rows per origin."""
    return balanced.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
