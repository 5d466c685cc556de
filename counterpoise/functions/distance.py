"""Distances as unrolled column arithmetic (whole-stage codegen, no lambdas)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def distance(xs: Sequence[Column], ys: Sequence[Column], metric: str = "euclidean") -> Column:
    """Distance of two points given as equally long lists of double columns, as float.

    Terms are added in feature order in double precision and the result is rounded to
    a 32-bit float, which is the value neighbours are ranked by.
    """
    check_metric(metric)
    if len(xs) != len(ys) or not xs:
        raise ValueError("both points need the same, non-zero number of features")
    gaps = [x.cast("double") - y.cast("double") for x, y in zip(xs, ys)]
    if metric == "manhattan":
        return reduce(add, [F.abs(g) for g in gaps]).cast("float")
    return F.sqrt(reduce(add, [g * g for g in gaps])).cast("float")
