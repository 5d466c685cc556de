"""Row encoders: from tokens or typed columns to doubles, driven by a spec.

All of them are row-wise column expressions without a shuffle, so they run inside code
generation and on streaming frames as well. Only the codes of very long category lists
come by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.materialize import materialize
from counterpoise.sources.delimited import delimited_line
from counterpoise.sources.spec import Attribute, Spec


def _token(name: str) -> Column:
    return F.trim(F.col(name).cast("string"))


def _code(attribute: Attribute, token: Column) -> Column:
    """The code of a listed category, else null; long lists are joined by ``_prepared``."""
    if attribute.codes is not None:
        return F.col(f"_code_{attribute.name}")
    entries = [F.lit(x) for code, name in enumerate(attribute.categories)
               for x in (name, float(code))]
    return F.element_at(F.create_map(*entries), token) if entries else F.lit(None).cast("double")


def _prepared(df: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """``df`` with the codes of attributes whose list is a table."""
    for a in attributes:
        if a.codes is not None:
            own = a.codes.select(F.col("category").alias("_category"),
                                 F.col("code").alias(f"_code_{a.name}"))
            df = df.join(own, _token(a.name) == F.col("_category"), "left").drop("_category")
    return df


def _refuse(attribute: Attribute, token: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"cannot encode {attribute.name}: "),
                                  F.coalesce(token, F.lit("missing value")))).cast("double")


def _missing(attribute: Attribute, token: Column) -> Column:
    return F.lit(None).cast("double")


def lenient_code(df: DataFrame, attribute: Attribute, refuse=_refuse) -> Column:
    """Code of a listed category, else the token as a number, else ``refuse``, an error."""
    listed = attribute.categories or attribute.codes is not None
    if isinstance(df.schema[attribute.name].dataType, T.NumericType) and not listed:
        value = F.col(attribute.name).cast("double")
        return F.coalesce(value, refuse(attribute, F.lit(None).cast("string")))
    token = _token(attribute.name)
    number = token.try_cast("double")
    known = F.coalesce(_code(attribute, token), number) if listed else number
    return F.coalesce(known, refuse(attribute, token))


def strict_code(df: DataFrame, attribute: Attribute, refuse=_refuse) -> Column:
    """Numbers as they are; a category must be listed."""
    if attribute.kind == "numeric":
        return lenient_code(df, attribute, refuse)
    token = _token(attribute.name)
    return F.coalesce(_code(attribute, token), refuse(attribute, token))


def minmax_code(df: DataFrame, attribute: Attribute, refuse=_refuse) -> Column:
    """Numbers scaled to the declared range (0 for a constant), categories strict."""
    if attribute.kind != "numeric":
        return strict_code(df, attribute, refuse)
    value = lenient_code(df, attribute, refuse)
    if attribute.high == attribute.low:
        return value * 0.0
    return (value - F.lit(attribute.low)) / F.lit(attribute.high - attribute.low)


ENCODERS = {"lenient": lenient_code, "strict": strict_code, "minmax": minmax_code}


def encode(df: DataFrame, spec: Spec, mode: str = "lenient", keep: Sequence[str] = (),
           label: str = "label") -> DataFrame:
    """Every feature and the class as doubles; the class column is renamed to ``label``."""
    if mode not in ENCODERS:
        raise ValueError(f"mode must be one of {tuple(ENCODERS)}, not {mode!r}")
    code = ENCODERS[mode]
    df = _prepared(df, spec.attributes)
    return df.select(*keep, *[code(df, a).alias(a.name) for a in spec.features],
                     code(df, spec.label).alias(label))


def encode_or_reject(df: DataFrame, spec: Spec, mode: str = "lenient", keep: Sequence[str] = (),
                     label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``encode`` without an error: encoded rows, and (keep, reason) of those that cannot be.

    The reason names the first attribute without a code. Rows are encoded once, and both
    results are read from what that wrote.
    """
    if mode not in ENCODERS:
        raise ValueError(f"mode must be one of {tuple(ENCODERS)}, not {mode!r}")
    code = ENCODERS[mode]
    df = _prepared(df, spec.attributes)
    reason = F.coalesce(*[F.when(code(df, a, _missing).isNull(), F.concat(
        F.lit(f"cannot encode {a.name}: "), F.coalesce(_token(a.name), F.lit("missing value"))))
        for a in spec.attributes])
    coded = materialize(df.select(
        *keep, *[code(df, a, _missing).alias(a.name) for a in spec.features],
        code(df, spec.label, _missing).alias(label), reason.alias("_reason")))
    bad = coded.where(F.col("_reason").isNotNull())
    return (coded.where(F.col("_reason").isNull()).drop("_reason"),
            bad.select(*keep, F.col("_reason").alias("reason")))


def encode_features(df: DataFrame, spec: Spec, keep: Sequence[str] = (),
                    label: str = "label") -> DataFrame:
    """Features encoded leniently, the class as its own trimmed token."""
    df = _prepared(df, spec.features)
    return df.select(*keep, *[lenient_code(df, a).alias(a.name) for a in spec.features],
                     _token(spec.label.name).alias(label))


def encode_line(df: DataFrame, spec: Spec, keep: Sequence[str] = (), delimiter: str = ",",
                name: str = "line") -> DataFrame:
    """The leniently encoded row as one delimited string."""
    encoded = encode(df, spec, keep=keep)
    columns = [a.name for a in spec.features] + ["label"]
    return encoded.select(*keep, delimited_line(columns, delimiter).alias(name))


def encode_strict_line(df: DataFrame, spec: Spec, keep: Sequence[str] = (), delimiter: str = ",",
                       name: str = "line") -> DataFrame:
    """Numeric tokens verbatim, categories as strict codes, as one delimited string."""
    df = _prepared(df, spec.attributes)
    tokens = [F.col(a.name) if a.kind == "numeric" else strict_code(df, a)
              for a in spec.attributes]
    return df.select(*keep, delimited_line(tokens, delimiter).alias(name))


def numeric_projection(df: DataFrame, spec: Spec, minority: str, keep: Sequence[str] = (),
                       label: str = "label") -> DataFrame:
    """Numeric attributes only, and the class as 1.0 for the minority, else 0.0."""
    numeric = [a for a in spec.features if a.kind == "numeric"]
    positive = _token(spec.label.name).eqNullSafe(F.lit(minority))
    return df.select(*keep, *[lenient_code(df, a).alias(a.name) for a in numeric],
                     F.when(positive, 1.0).otherwise(0.0).alias(label))


def attach_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_code`` for nominal columns with any number of categories.

    ``codes`` is (name, category, code) as made by ``infer_codes``. Each column is one
    left join on the category; Spark broadcasts the codes when their size allows and
    splits a hot category otherwise.
    """
    for column in columns:
        own = codes.where(F.col("name") == column).select(
            F.col("category").alias("_category"), F.col("code").alias(f"{column}_code"))
        df = df.join(own, _token(column) == F.col("_category"), "left").drop("_category")
    return df
