"""Delimited text in and out, and checked parsing of raw lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.materialize import materialize


def _reader(spark: SparkSession, delimiter: str):
    return (spark.read.option("sep", delimiter).option("mode", "FAILFAST")
            .option("quote", "").option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True)
            # Unread columns must still be counted, or a short row would pass.
            .option("columnPruning", False))


def read_delimited(spark: SparkSession, path: str | list[str], names: Sequence[str],
                   delimiter: str = ",") -> DataFrame:
    """All columns as trimmed strings; a row of another width fails the read."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _reader(spark, delimiter).schema(schema).csv(path)


def read_numeric(spark: SparkSession, path: str | list[str], names: Sequence[str],
                 delimiter: str = ",") -> DataFrame:
    """An all-numeric table (label last); anything else fails the read."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return _reader(spark, delimiter).schema(schema).csv(path)


def line_tokens(line: str | Column, delimiter: str = ",") -> Column:
    """Tokens of a raw line, empty ones at its end included."""
    return F.split(F.col(line) if isinstance(line, str) else line, f"\\Q{delimiter}\\E", -1)


def width_fault(tokens: Column, width: int) -> Column:
    """What is wrong with the number of tokens of a line; null if nothing is."""
    found = F.coalesce(F.size(tokens), F.lit(0)).cast("string")
    return F.when(tokens.isNull() | (F.size(tokens) != width), F.concat(
        F.lit(f"expected {width} tokens, found "), found))


def split_line(line: str | Column, width: int, delimiter: str = ",") -> Column:
    """Tokens of a raw line; a line of another width is an error."""
    line = F.col(line) if isinstance(line, str) else line
    tokens = line_tokens(line, delimiter)
    fault = width_fault(tokens, width)
    wrong = F.raise_error(F.concat(F.lit(f"expected {width} tokens: "), line))
    return F.when(fault.isNotNull(), wrong).otherwise(tokens)


def _named(names: Sequence[str], trim: bool) -> list[Column]:
    return [(F.trim(F.get("_t", F.lit(i))) if trim else F.get("_t", F.lit(i))).alias(n)
            for i, n in enumerate(names)]


def parse_lines(df: DataFrame, line: str, names: Sequence[str], delimiter: str = ",",
                keep: Sequence[str] = (), trim: bool = True) -> DataFrame:
    """Raw lines as string columns, width checked."""
    tokens = df.select(*keep, split_line(line, len(names), delimiter).alias("_t"))
    return tokens.select(*keep, *_named(names, trim))


def parse_or_reject(df: DataFrame, line: str, names: Sequence[str], delimiter: str = ",",
                    keep: Sequence[str] = (), trim: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same without an error: parsed lines, and (keep, line, reason) of those that are
    not of ``names``' width. The lines are split once, and both are read from what that wrote.
    """
    tokens = line_tokens(line, delimiter)
    split = materialize(df.select(*keep, F.col(line).alias("_line"), tokens.alias("_t"),
                                  width_fault(tokens, len(names)).alias("_reason")))
    good = split.where(F.col("_reason").isNull()).select(*keep, *_named(names, trim))
    bad = split.where(F.col("_reason").isNotNull())
    return good, bad.select(*keep, F.col("_line").alias("line"), F.col("_reason").alias("reason"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, number, line) of text files, lines numbered from 1 in each file.

    Files are read in blocks by many tasks. A block's lines are numbered as they come, and
    a count of the lines in earlier blocks of the file, one row for each block, is added.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return lines.join(blocks, ["file", "_block"]).select(
        "file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("number"), "line")


def parse_numeric_lines(df: DataFrame, line: str, names: Sequence[str], delimiter: str = ",",
                        keep: Sequence[str] = ()) -> DataFrame:
    """Raw lines of numbers as double columns; the last one is the label."""
    parsed = parse_lines(df, line, names, delimiter, keep)
    return parsed.select(*keep, *[F.col(n).cast("double").alias(n) for n in names])


def delimited_line(columns: Sequence[str | Column], delimiter: str = ",",
                   decimals: int | None = None) -> Column:
    """One output line; doubles as written by the engine, or with fixed decimals.

    A null is an empty token, as ``read_delimited`` reads it.
    """
    def text(c: str | Column) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.coalesce(c.cast("string"), F.lit(""))

    if decimals is None:
        return F.concat_ws(delimiter, *[text(c) for c in columns])
    *numbers, last = columns
    fixed = []
    for c in numbers:
        c = F.col(c) if isinstance(c, str) else c
        fixed.append(F.when(c.isNull(), F.lit("")).otherwise(F.format_string(f"%.{decimals}f", c)))
    return F.concat_ws(delimiter, *fixed, text(last))


def write_delimited(df: DataFrame, path: str, delimiter: str = ",",
                    mode: str = "errorifexists") -> None:
    """Write every partition in parallel; there is no single-file funnel."""
    df.write.mode(mode).option("sep", delimiter).option("quote", "").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
