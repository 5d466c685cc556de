"""Link cleaning, alone or after oversampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.features import Features, feature_names
from counterpoise.materialize import materialize
from counterpoise.operators.links import (
    check_mode, drop_ids, link_report, nearest_labels, opposite_links, removed_ids)
from counterpoise.plans.oversample import oversample


def _links(df: DataFrame, key: str, features: Features, label: str, metric: str,
           strategy: str) -> DataFrame:
    columns = dict.fromkeys([key, *feature_names(df, features), label])
    return opposite_links(nearest_labels(
        df.select(*columns), key, features, label, metric=metric, strategy=strategy))


def link_clean(df: DataFrame, key: str, features: Features, label: str, *,
               mode: str = "one_sided", metric: str = "euclidean",
               strategy: str = "auto") -> DataFrame:
    """Remove rows whose nearest neighbour has another label, together with that neighbour.

    ``one_sided`` follows every directed link, ``mutual`` only pairs that are each other's
    nearest neighbour.
    """
    check_mode(mode)
    links = _links(df, key, features, label, metric, strategy)
    return drop_ids(df, key, removed_ids(links, mode))


def link_clean_report(df: DataFrame, key: str, features: Features, label: str, *,
                      mode: str = "one_sided", metric: str = "euclidean",
                      strategy: str = "auto") -> DataFrame:
    """Counts of rows, directed links, mutual pairs, removed and kept rows."""
    links = materialize(_links(df, key, features, label, metric, strategy).select("id", "nid"))
    return link_report(df.select(F.col(key)), links, mode)


def oversample_then_clean(df: DataFrame, key: str, features: Features, label: str, minority,
                          pct: float, *, mode: str = "one_sided", metric: str = "euclidean",
                          strategy: str = "auto", **options) -> DataFrame:
    """Oversample, then remove opposite-label links from the result."""
    balanced = materialize(oversample(df, key, features, label, minority, pct, metric=metric,
                                      strategy=strategy, **options))
    return link_clean(balanced, "id", features, "label", mode=mode, metric=metric,
                      strategy=strategy)
