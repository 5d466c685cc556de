"""Stable row keys and keyed hash randomness.

Nothing here depends on where a row physically sits, so a lost executor, a
different partition count or a re-run gives the same keys and the same draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identical rows are re-expanded from their count. Where there are more than a few, in
# slices of at most this many rows that are dealt to many tasks: what a task writes is then
# a share of all rows, however few rows are distinct.
COPIES_IN_PLACE = 16
COPIES_PER_SLICE = 10_000
TASKS_PER_SLOT = 4

# The content that is hashed must differ wherever rows differ: microseconds, the offset of
# repeated hours and absent fields all show.
CONTENT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def hash_uniform(seed: int, tag: str, *ids: Column | str) -> Column:
    """Uniform double in [0, 1): first 8 hex digits of md5('seed:tag:id…') / 2^32."""
    parts = [F.lit(str(seed)), F.lit(tag)]
    parts += [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def with_row_key(df: DataFrame, name: str = "id", key: Column | None = None) -> DataFrame:
    """Add a string key that is unique per row.

    Pass ``key`` when the table has a natural unique key. Otherwise the key is the
    hash of the row's content plus a copy number among identical rows. Identical rows
    are counted with a map-side partial aggregate and expanded again afterwards, so a
    hot row never meets in one task.
    """
    if key is not None:
        return df.withColumn(name, key.cast("string"))
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    content = F.sha2(F.to_json(F.struct(*columns), CONTENT), 256)
    first = F.lit(1).cast("bigint")
    step = F.lit(COPIES_PER_SLICE).cast("bigint")
    usual = counted.where(F.col("_n") <= COPIES_IN_PLACE).select(
        *columns, content.alias("_content"), first.alias("_from"), F.col("_n").alias("_to"))
    # Slices are small rows of much work, so their number, not their size, says how many
    # tasks share them.
    hot = counted.where(F.col("_n") > COPIES_IN_PLACE).select(
        *columns, content.alias("_content"), "_n",
        F.explode(F.sequence(first, F.col("_n"), step)).alias("_from"),
    ).repartition(_expanding_tasks(df)).select(
        *columns, "_content", "_from",
        F.least(F.col("_n"), F.col("_from") + step - 1).alias("_to"))
    return usual.unionByName(hot).select(
        *columns, "_content", F.explode(F.sequence("_from", "_to")).alias("_copy"),
    ).select(F.concat_ws(":", "_content", "_copy").alias(name), *columns)


def _expanding_tasks(df: DataFrame) -> int:
    """Some tasks per slot, or partitions of a shuffle if they are more."""
    spark = df.sparkSession
    return max(TASKS_PER_SLOT * spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))
