"""Minority / majority split, class counts and the sampling plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from counterpoise.materialize import materialize


def is_minority(label: str, minority) -> Column:
    """One definition for both sides of the split; a missing label is majority."""
    return F.col(label).eqNullSafe(F.lit(minority))


def minority_rows(df: DataFrame, label: str, minority) -> DataFrame:
    return df.where(F.col(label) == F.lit(minority))


def majority_rows(df: DataFrame, label: str, minority) -> DataFrame:
    return df.where(~is_minority(label, minority))


def class_counts(df: DataFrame, label: str, minority) -> DataFrame:
    """Both counts in one pass over one column: (n_pos, n_neg)."""
    return df.agg(
        F.count_if(is_minority(label, minority)).alias("n_pos"),
        F.count_if(~is_minority(label, minority)).alias("n_neg"),
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("label", "n")


def partners_per_row(pct: float) -> int:
    return max(1, int(pct / 100))


def sampling_plan_table(df: DataFrame, label: str, minority, pct: float) -> DataFrame:
    """(n_pos, n_neg, n, fraction) as a one-row frame; fraction is null without minority."""
    n = partners_per_row(pct)
    target = F.col("n_neg").cast("double") * F.lit(float(pct)) / F.lit(100.0)
    fraction = target / F.nullif(F.col("n_pos").cast("double"), F.lit(0.0)) / F.lit(float(n + 1))
    return class_counts(df, label, minority).select(
        "n_pos", "n_neg", F.lit(n).alias("n"), fraction.alias("fraction"))


@dataclass(frozen=True)
class SamplingPlan:
    """How many synthetic rows to make.

    ``pct`` is the wanted size of the minority class in the output as a percentage of
    the majority: ``fraction * n_pos`` base rows get ``n`` synthetic partners each.
    """

    n_pos: int
    n_neg: int
    n: int
    fraction: float


def sampling_plan(df: DataFrame, label: str, minority, pct: float) -> SamplingPlan:
    """The same plan as scalars; the one small job that must run before a plan is built."""
    row = class_counts(df, label, minority).first()
    return plan_of_counts(row["n_pos"], row["n_neg"], minority, pct)


def plan_of_counts(n_pos: int, n_neg: int, minority, pct: float) -> SamplingPlan:
    if pct <= 0:
        raise ValueError("pct must be positive")
    if n_pos == 0:
        raise ValueError(f"no row carries the minority label {minority!r}")
    n = partners_per_row(pct)
    return SamplingPlan(n_pos, n_neg, n, float(n_neg) * float(pct) / 100.0 / n_pos / float(n + 1))


def measured_minority(df: DataFrame, label: str, minority, columns: Sequence[str | Column],
                      size: Column) -> tuple[DataFrame, int, int, float]:
    """The minority's ``columns``, written once, with both class counts and the sum of
    ``size`` over the minority, all observed in that one scan of ``df``.

    The rows are written by the tasks that observe them, so a task that runs again counts
    once.
    """
    seen = Observation()
    positive = is_minority(label, minority)
    observed = df.observe(
        seen, F.count_if(positive).alias("n_pos"), F.count_if(~positive).alias("n_neg"),
        F.sum(F.when(positive, size.cast("double"))).alias("size"))
    rare = materialize(minority_rows(observed, label, minority).select(*columns))
    found = seen.get
    return rare, found["n_pos"], found["n_neg"], found["size"] or 0.0
