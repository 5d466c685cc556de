"""Sampling with and without replacement, and the choice of partners."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from counterpoise.functions.keys import hash_uniform

# Fixed value: the seed of the sampling steps.
SEED = 1234

# A larger mean is the sum of several independent draws with means up to this one.
LADDER_MEAN = 30.0
LADDER_TAIL = 1e-12

# Beyond this mean a count is drawn by rejection, in a number of draws that does not grow.
SUM_MEAN = 3_000.0
# Tries of the rejection; each fails with a probability of about an eighth at most, and a
# row whose tries all fail gets the mean.
TRIES = 24

# Copies of a row that one task makes, where rows may have more; a row has no more than
# MOST_SLICES slices.
SLICE_COPIES = 1_000
MOST_SLICES = 100_000


def poisson_ladder(mean: float) -> list[float]:
    """Cumulative Poisson probabilities until the tail is below ``LADDER_TAIL``."""
    cumulative, term, total, i = [], math.exp(-mean), 0.0, 0
    while 1.0 - total > LADDER_TAIL and i < 400:
        total += term
        cumulative.append(total)
        i += 1
        term *= mean / i
    return cumulative


def poisson_copies(draw: Column, mean: float) -> Column:
    """Poisson(mean) copies for uniform draws; ``mean`` up to LADDER_MEAN."""
    count = F.lit(len(poisson_ladder(mean)))
    for i, bound in reversed(list(enumerate(poisson_ladder(mean)))):
        count = F.when(draw < F.lit(bound), i).otherwise(count)
    return count


def poisson_sum(key: str, mean: float, seed: int) -> Column:
    """Poisson(mean) copies of a row: a sum of independent Poisson draws is one."""
    draws = math.ceil(mean / LADDER_MEAN)
    uniform = F.transform(F.sequence(F.lit(1), F.lit(draws)),
                          lambda i: hash_uniform(seed, "copies", key, i))
    return F.aggregate(uniform, F.lit(0), lambda total, u: total + poisson_copies(u, mean / draws))


@dataclass(frozen=True)
class Rejection:
    """Constants of transformed rejection for a Poisson mean (Hörmann's PTRS, 1993)."""

    mean: float
    scale: float
    bend: float
    log_alpha: float
    inner: float

    @staticmethod
    def of(mean: float) -> Rejection:
        scale = 0.931 + 2.53 * math.sqrt(mean)
        return Rejection(mean, scale, -0.059 + 0.02483 * scale,
                         math.log(1.1239 + 1.1328 / (scale - 3.4)), 0.9277 - 3.6224 / (scale - 2.0))


# Half of the step of the keyed draws, so that no draw is zero.
HALF_STEP = 2.0**-33


def poisson_rejection(key: str, mean: float, seed: int) -> Column:
    """Poisson(mean) copies of a row, for large means, by transformed rejection.

    Every try has two draws that the key and its number name; a row stops at the first try
    that is accepted.
    """
    r = Rejection.of(mean)

    def count(i: Column) -> Column:
        draws = F.array(F.struct((hash_uniform(seed, "reject", key, i) + HALF_STEP - 0.5).alias("u"),
                                 (hash_uniform(seed, "accept", key, i) + HALF_STEP).alias("v")))
        draws = F.transform(draws, lambda d: F.struct(
            d["v"].alias("v"), (0.5 - F.abs(d["u"])).alias("edge"),
            F.floor((2 * r.bend / (0.5 - F.abs(d["u"])) + r.scale) * d["u"] + (mean + 0.43)
                    ).cast("double").alias("n")))
        return F.get(F.transform(draws, lambda d: F.when(accepted(d["v"], d["edge"], d["n"]), d["n"])), 0)

    def accepted(v: Column, edge: Column, n: Column) -> Column:
        # log of the probability of n, by the series of the factorial
        log = (n - mean - n * F.log1p((n - mean) / mean) - 0.5 * F.log(n * (2 * math.pi)) - 1 / (12 * n))
        bound = F.log(v) + r.log_alpha - F.log(r.bend / (edge * edge) + r.scale)
        return ((edge >= 0.07) & (v <= r.inner)) | (
            (n >= 1) & ~((edge < 0.013) & (v > edge)) & F.when(n >= 1, bound <= log))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"),
                        lambda found, i: F.when(found.isNotNull(), found).otherwise(count(i)))
    return F.coalesce(first, F.lit(math.floor(mean + 0.5))).cast("int" if mean < 1e9 else "long")


def with_copies(df: DataFrame, key: str, fraction: float, seed: int = SEED,
                name: str = "copies", among: Column | None = None) -> DataFrame:
    """Add the number of copies of each row and drop rows that get none.

    Up to fraction 1 a row is kept once or dropped (sampling without replacement), beyond
    it is drawn Poisson(fraction) times. Rows outside ``among`` are always kept once. The
    draw is its own column, so the hash is computed once per row.
    """
    if fraction > LADDER_MEAN:
        draw = poisson_sum if fraction <= SUM_MEAN else poisson_rejection
        drawn, count = df, draw(key, fraction, seed)
        if among is not None:
            count = F.when(among, count).otherwise(1)
        return drawn.withColumn(name, count).where(F.col(name) >= 1)
    tag = "sample" if fraction <= 1.0 else "copies"
    draw = hash_uniform(seed, tag, key)
    drawn = df.withColumn("_u", draw if among is None else F.when(among, draw))
    if fraction <= 1.0:
        count = F.when(F.col("_u") < F.lit(float(fraction)), 1).otherwise(0)
    else:
        count = poisson_copies(F.col("_u"), fraction)
    if among is not None:
        count = F.when(F.col("_u").isNull(), 1).otherwise(count)
    return drawn.withColumn(name, count).drop("_u").where(F.col(name) >= 1)


def sample_rows(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """Bernoulli sample on a hash of the key, so unlike ``df.sample`` it does not depend on
    partitioning; a fraction of 1 or more keeps every row."""
    if fraction >= 1.0:
        return df
    return df.where(hash_uniform(seed, "sample", key) < F.lit(float(fraction)))


def number_copies(df: DataFrame, copies: str = "copies", name: str = "copy",
                  mean: float = 1.0) -> DataFrame:
    """Repeat each row as often as ``copies`` says, numbered from 1.

    Where ``mean`` copies are many, rows are cut into slices of copies first, which are
    dealt to all tasks, so that few rows are not repeated by few tasks.
    """
    if mean <= SLICE_COPIES / 2:
        return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(copies)
    kind = df.schema[copies].dataType
    step = F.lit(max(SLICE_COPIES, math.ceil(mean / MOST_SLICES))).cast(kind)
    cut = df.withColumn("_from", F.explode(F.sequence(F.lit(1).cast(kind), F.col(copies), step)))
    dealt = cut.repartition(task_count(df), F.xxhash64(*(f"`{c}`" for c in cut.columns)))
    last = F.least(F.col(copies), F.col("_from") + step - 1)
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_from"), last))).drop(copies, "_from")


def task_count(df: DataFrame) -> int:
    """Tasks that work at a time, or partitions of a shuffle if they are more."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def replicate_rows(df: DataFrame, key: str, fraction: float, seed: int = SEED) -> DataFrame:
    """Bernoulli sample up to fraction 1, Poisson copies beyond; adds ``copy``."""
    return number_copies(with_copies(df, key, fraction, seed), mean=fraction)


def choose_nearest(neighbors: DataFrame, n: int) -> DataFrame:
    """The first n of the k neighbours."""
    return neighbors.where(F.col("rank") <= n)


def choose_random(neighbors: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """A seeded random n of the k neighbours, drawn afresh for every copy of a row.

    Groups hold at most k rows.
    """
    group = ["qid", "copy"] if "copy" in neighbors.columns else ["qid"]
    draw = hash_uniform(seed, "choose", *group, "nid")
    order = Window.partitionBy(*group).orderBy(draw, "nid")
    return (neighbors.withColumn("_choice", F.row_number().over(order))
            .where(F.col("_choice") <= n).drop("_choice"))
