"""Interpolated rows between a base row and its chosen neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.functions.keys import hash_uniform
from counterpoise.operators.sampling import SEED


def gap_draw(seed: int = SEED) -> Column:
    """One draw in [0, 1) per synthetic row, shared by all its features."""
    return hash_uniform(seed, "gap", "qid", "copy", "rank")


def interpolate(base: Column, other: Column, u: Column) -> Column:
    """base + (other - base) * u, entry by entry of two vectors."""
    return F.zip_with(base, other, lambda x, y: x + (y - x) * u)


def interpolate_entries(base: Column, other: Column, u: Column, width: int) -> list[Column]:
    """The same for a known width, as plain arithmetic columns."""
    return [base[i] + (other[i] - base[i]) * u for i in range(width)]


def synthetic_key() -> Column:
    return F.concat_ws(":", F.lit("syn"), F.col("qid").cast("string"),
                       F.col("copy").cast("string"), F.col("rank").cast("string"))


def synthesize(partners: DataFrame, width: int | None = None, seed: int = SEED) -> DataFrame:
    """One synthetic row per chosen partner: (id, features…).

    ``partners`` has ``qid, copy, rank, qvec, nvec``. With ``width`` the entries come as
    columns ``f0…``, otherwise as one array column ``vec``.
    """
    drawn = partners.withColumn("_u", gap_draw(seed))
    qvec, nvec, u = F.col("qvec"), F.col("nvec"), F.col("_u")
    if width is None:
        return drawn.select(synthetic_key().alias("id"), interpolate(qvec, nvec, u).alias("vec"))
    entries = interpolate_entries(qvec, nvec, u, width)
    return drawn.select(synthetic_key().alias("id"),
                        *[e.alias(f"f{i}") for i, e in enumerate(entries)])
