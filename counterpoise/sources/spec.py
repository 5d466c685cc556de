"""Encoding specs: what each column of a labelled table is and how it is coded.

As a DataFrame a spec has one row per numeric attribute and one per category:
(pos, name, kind, min, max, category, code), kind being numeric, nominal or class. The
class comes last. ``Spec`` is the same metadata on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from counterpoise.materialize import materialize

# Up to so many categories of a column are held on the driver and looked up in a literal;
# the codes of a longer list stay a table and are joined, with the same result.
LISTED = 1_000

# Ranges of values in which the categories of a column are numbered.
RANGES = 256

SPEC_COLUMNS = ("pos", "name", "kind", "min", "max", "category", "code")


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    categories: tuple[str, ...] = ()
    #: (category, code) of a list that is too long for ``categories``.
    codes: DataFrame | None = field(default=None, compare=False, repr=False)


@dataclass(frozen=True)
class Spec:
    attributes: tuple[Attribute, ...]

    @property
    def features(self) -> tuple[Attribute, ...]:
        return tuple(a for a in self.attributes if a.kind != "class")

    @property
    def label(self) -> Attribute:
        return next(a for a in self.attributes if a.kind == "class")

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    @staticmethod
    def from_table(spec: DataFrame) -> Spec:
        """The attributes of a spec table; only short lists of categories come along."""
        short = F.when(F.col("category").isNotNull() & (F.col("code") < LISTED),
                       F.struct("code", "category"))
        heads = spec.groupBy("pos", "name", "kind").agg(
            F.min("min").alias("min"), F.max("max").alias("max"),
            F.count("category").alias("n"), F.collect_list(short).alias("listed")).collect()
        return Spec(tuple(
            Attribute(h["name"], h["kind"], h["min"], h["max"],
                      tuple(c for _, c in sorted(h["listed"])) if h["n"] <= LISTED else (),
                      spec.where(F.col("pos") == h["pos"]).groupBy("category").agg(
                          F.min("code").alias("code")) if h["n"] > LISTED else None)
            for h in sorted(heads, key=lambda h: h["pos"])))

    @staticmethod
    def of_data(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str],
                label: str) -> Spec:
        """The attributes of ``infer_spec``, without a table in between."""
        ranges, lists = _measured(df, numeric, [*nominal, label])
        long = [c for c, found in lists.items() if found is None]
        codes = _numbered(df, long) if long else None
        return Spec((
            *[Attribute(c, "numeric", *ranges[c]) for c in numeric],
            *[Attribute(c, "class" if c == label else "nominal", categories=found or (),
                        codes=None if found is not None else codes.where(
                            F.col("name") == c).select("category", "code"))
              for c, found in lists.items()]))


# --- from a header -------------------------------------------------------------------

# The header's line formats.
ATTRIBUTE_LINE = r"(?i)^\s*@attribute\s+([^\s\[{]+)"
INPUTS_LINE = r"(?i)^\s*@inputs\s+(.+)$"
OUTPUTS_LINE = r"(?i)^\s*@outputs?\s+(\S+)"
RANGE = r"\[\s*([^,\]]+?)\s*,\s*([^,\]]+?)\s*\]"
CATEGORIES = r"\{([^}]*)\}"


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The whole header file as one row, so that line order is known."""
    return spark.read.text(path, wholetext=True)


def _attribute_name(line: Column) -> Column:
    return F.regexp_extract(line, ATTRIBUTE_LINE, 1)


def header_spec(header: DataFrame, column: str = "value") -> DataFrame:
    """Spec rows of header text held as one string per row.

    Attributes keep their order, the class goes last. It is the attribute named by
    ``@outputs``, else the one called ``class``.
    """
    lines = header.select(F.split(F.col(column), r"\r?\n").alias("lines"))
    outputs = F.filter("lines", lambda x: x.rlike(OUTPUTS_LINE))
    inputs = F.filter("lines", lambda x: x.rlike(INPUTS_LINE))
    parts = lines.select(
        F.filter("lines", lambda x: x.rlike(ATTRIBUTE_LINE)).alias("attrs"),
        F.lower(F.coalesce(F.regexp_extract(F.get(outputs, F.lit(0)), OUTPUTS_LINE, 1),
                           F.lit("class"))).alias("class_name"),
        F.size(F.split(F.regexp_extract(F.get(inputs, F.lit(0)), INPUTS_LINE, 1), ",")
               ).alias("n_inputs"),
    )
    is_class = lambda x: F.lower(_attribute_name(x)) == F.col("class_name")
    ordered = F.concat(F.filter("attrs", lambda x: ~is_class(x)), F.filter("attrs", is_class))
    checked = F.when(
        F.col("n_inputs").isNotNull() & (F.col("n_inputs") > 0)
        & (F.col("n_inputs") + 1 != F.size("attrs")),
        F.raise_error(F.concat(F.lit("header lists "), F.col("n_inputs").cast("string"),
                               F.lit(" inputs but declares "),
                               F.size("attrs").cast("string"), F.lit(" attributes"))),
    ).otherwise(ordered)
    attrs = parts.select("class_name", F.posexplode(checked).alias("pos", "line"))
    line = F.col("line")
    name = _attribute_name(line)
    has_list = line.rlike(r"\{")
    attrs = attrs.select(
        "pos", name.alias("name"),
        F.when(F.lower(name) == F.col("class_name"), "class")
        .when(has_list, "nominal").otherwise("numeric").alias("kind"),
        F.when(~has_list, F.regexp_extract(line, RANGE, 1)).alias("low"),
        F.when(~has_list, F.regexp_extract(line, RANGE, 2)).alias("high"),
        F.when(has_list, F.transform(F.split(F.regexp_extract(line, CATEGORIES, 1), ","),
                                     lambda x: F.trim(x))).alias("categories"),
    )
    missing = F.raise_error(F.concat(F.lit("numeric attribute without a [min, max] range: "),
                                     F.col("name")))
    bound = lambda c: F.when(F.col(c) == "", missing).otherwise(
        F.col(c).cast("double"))
    return attrs.select(
        "pos", "name", "kind", bound("low").alias("min"), bound("high").alias("max"),
        F.posexplode_outer("categories").alias("code", "category"),
    ).select("pos", "name", "kind", "min", "max", "category", F.col("code").cast("double"))


def class_number(spec: DataFrame) -> DataFrame:
    """Number of classes: (n_classes)."""
    return spec.agg(F.count_if(F.col("kind") == "class").alias("n_classes"))


def numeric_positions(spec: DataFrame) -> DataFrame:
    """Positions of the numeric attributes and of the class: (pos, name)."""
    return spec.where(F.col("kind").isin("numeric", "class")).select("pos", "name").distinct()


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, name) of the columns whose tokens are all numbers, at least one, from one
    aggregate over one scan; missing tokens do not count."""
    token = lambda c: F.trim(F.col(c).cast("string"))
    found = df.agg(*[f(token(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (
        ("all", F.count), ("odd", lambda t: F.count_if(t.isNotNull() & t.try_cast("double").isNull())))])
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"),
                     ((F.col(f"all_{i}") > 0) & (F.col(f"odd_{i}") == 0)).alias("numeric"))
            for i, c in enumerate(columns)]
    return found.select(F.inline(F.array(*rows))).where("numeric").select("pos", "name")


# --- from the data -------------------------------------------------------------------

def infer_ranges(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """(name, min, max) of numeric columns, from one aggregate over one scan."""
    bounds = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{i}")
                      for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))])
    # Zero and minus zero are equal, so which of them is met first must not show.
    plain = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c))
    rows = [F.struct(F.lit(c).alias("name"), plain(f"lo_{i}").alias("min"),
                     plain(f"hi_{i}").alias("max")) for i, c in enumerate(numeric)]
    return bounds.select(F.inline(F.array(*rows)))


def _measured(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str]) -> tuple[dict, dict]:
    """Ranges of numeric columns and sorted categories of nominal ones, from one aggregate
    over one scan; None stands for a list of more than ``LISTED``.

    A task holds a bounded number of a column's values. Up to three quarters of it nothing
    is let go, so a list is whole where the estimate of distinct values, good to 5 %, is a
    third of that at most and no more than ``LISTED`` came back.
    """
    held = []
    for i, c in enumerate(numeric):
        value = F.col(c).cast("double")
        held += [F.min(value).alias(f"lo_{i}"), F.max(value).alias(f"hi_{i}")]
    for i, c in enumerate(nominal):
        token = F.trim(F.col(c).cast("string"))
        held += [F.call_function("approx_top_k", token, F.lit(LISTED + 2), F.lit(8 * LISTED + 16)
                                 ).alias(f"top_{i}"),
                 F.approx_count_distinct(token).alias(f"n_{i}")]
    row = df.agg(*held).first()
    # Zero and minus zero are equal, so which of them is met first must not show.
    plain = lambda x: 0.0 if x == 0 else x
    ranges = {c: (plain(row[f"lo_{i}"]), plain(row[f"hi_{i}"])) for i, c in enumerate(numeric)}
    lists = {}
    for i, c in enumerate(nominal):
        found = sorted(top["item"] for top in row[f"top_{i}"] if top["item"] is not None)
        whole = len(found) <= LISTED and row[f"n_{i}"] <= 2 * LISTED
        lists[c] = tuple(found) if whole else None
    return ranges, lists


def _local(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """A table of a few rows that are part of the plan."""
    return spark.createDataFrame(pa.table({c: pa.array(v, t) for c, (t, v) in columns.items()}))


def _categories(df: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """Distinct (name, category) of several columns, reduced map-side first."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"),
                               F.trim(F.col(c).cast("string")).alias("category"))
                      for c in nominal])
    return df.select(F.inline(pairs)).where(F.col("category").isNotNull()).distinct()


def infer_codes(df: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """(name, category, code): 0-based codes in alphabetical order per column.

    For columns with any number of categories: short lists come from one aggregate, only
    the others are counted out in a table.
    """
    _, lists = _measured(df, [], nominal)
    return _codes(df, lists)


def _codes(df: DataFrame, lists: dict[str, tuple[str, ...] | None]) -> DataFrame:
    rows = [(c, name, float(code)) for c, found in lists.items()
            for code, name in enumerate(found or ())]
    names, categories, codes = map(list, zip(*rows)) if rows else ([], [], [])
    short = _local(df.sparkSession, {
        "name": (pa.string(), names), "category": (pa.string(), categories),
        "code": (pa.float64(), codes)})
    long = [c for c, found in lists.items() if found is None]
    return short.unionByName(_numbered(df, long)) if long else short


def _numbered(df: DataFrame, nominal: Sequence[str]) -> DataFrame:
    """(name, category, code) of columns with very many categories.

    They are numbered inside ranges of values and shifted by the size of the ranges before.
    A range's borders are categories chosen by their hash, so everything is a function of
    the values alone.
    """
    found = materialize(_categories(df, nominal))
    sizes = {r["name"]: r["n"] for r in found.groupBy("name").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    # about RANGES borders per column, however many categories there are
    every = {name: n // RANGES for name, n in sizes.items() if n >= 8 * RANGES}
    borders: dict[str, list[str]] = {}
    if every:
        rate = F.create_map(*[F.lit(x) for item in every.items() for x in item])[F.col("name")]
        for row in found.where(F.pmod(F.xxhash64("name", "category"), rate) == 0).collect():
            borders.setdefault(row["name"], []).append(row["category"])
    place = F.lit(0)
    for name, values in borders.items():
        below = F.filter(F.array(*map(F.lit, sorted(values))), lambda b: b <= F.col("category"))
        place = F.when(F.col("name") == name, F.size(below)).otherwise(place)
    ranges = found.withColumn("_range", place)
    counts = ranges.groupBy("name", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (Window.partitionBy("name").orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("name", "_range",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("name", "_range").orderBy("category")
    numbered = ranges.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["name", "_range"]).select(
        "name", "category", (F.col("_before") + F.col("_i")).cast("double").alias("code"))


def infer_spec(df: DataFrame, numeric: Sequence[str], nominal: Sequence[str],
               label: str) -> DataFrame:
    """A spec table for data without a header: features in the given order, class last."""
    order = {c: i for i, c in enumerate([*numeric, *nominal, label])}
    position = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    kind = F.when(F.col("name") == label, "class").otherwise("nominal")
    none = F.lit(None).cast("double")
    ranges, lists = _measured(df, numeric, [*nominal, label])
    codes = _codes(df, lists).select(
        position[F.col("name")].alias("pos"), "name", kind.alias("kind"),
        none.alias("min"), none.alias("max"), "category", "code")
    if not numeric:
        return codes
    low, high = zip(*(ranges[c] for c in numeric))
    numbers = _local(df.sparkSession, {
        "name": (pa.string(), list(numeric)), "min": (pa.float64(), list(low)),
        "max": (pa.float64(), list(high))})
    return numbers.select(
        position[F.col("name")].alias("pos"), "name", F.lit("numeric").alias("kind"),
        "min", "max", F.lit(None).cast("string").alias("category"), none.alias("code"),
    ).unionByName(codes)
