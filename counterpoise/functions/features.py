"""Feature vectors: a list of numeric columns, or one array column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Features = str | Sequence[str]


def is_array_column(df: DataFrame, features: Features) -> bool:
    return isinstance(features, str) and isinstance(df.schema[features].dataType, T.ArrayType)


def feature_names(df: DataFrame, features: Features) -> list[str]:
    if isinstance(features, str):
        return [features]
    if not features:
        raise ValueError("at least one feature column is needed")
    return list(features)


def feature_vector(df: DataFrame, features: Features) -> Column:
    """The features of a row as array<double>."""
    if is_array_column(df, features):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in feature_names(df, features)])


def unpack(df: DataFrame, features: Features, vector: Column) -> list[Column]:
    """Turn a vector back into the table's own feature columns."""
    if is_array_column(df, features):
        return [vector.alias(features)]
    return [vector[i].alias(c) for i, c in enumerate(feature_names(df, features))]


def measurable(vector: Column) -> Column:
    """False for vectors with a missing or NaN entry: they have no neighbours."""
    return vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
