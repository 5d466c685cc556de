"""The two jobs from delimited files to delimited files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from counterpoise.functions.keys import with_row_key
from counterpoise.operators.encode import encode_features
from counterpoise.plans.clean import link_clean
from counterpoise.plans.oversample import oversample_keyless
from counterpoise.sources.delimited import read_delimited, read_numeric, write_delimited
from counterpoise.sources.spec import Spec, header_spec, read_header


def load_labelled(spark: SparkSession, header_path: str, data_path: str,
                  delimiter: str = ",") -> tuple[DataFrame, Spec]:
    """Features encoded by the header, the class as ``label``, and the spec."""
    spec = Spec.from_table(header_spec(read_header(spark, header_path)))
    tokens = read_delimited(spark, data_path, spec.names, delimiter)
    return encode_features(tokens, spec), spec


def oversample_files(spark: SparkSession, header_path: str, data_path: str, out_path: str,
                     minority: str, pct: float, *, delimiter: str = ",",
                     mode: str = "errorifexists", **options) -> None:
    """Read a header and a data file, oversample, write features and class."""
    rows, spec = load_labelled(spark, header_path, data_path, delimiter)
    names = [a.name for a in spec.features]
    balanced = oversample_keyless(rows, names, "label", minority, pct, **options)
    write_delimited(balanced.select(*names, "label"), out_path, delimiter, mode)


def clean_files(spark: SparkSession, data_path: str, out_path: str, n_features: int, *,
                delimiter: str = ",", mode: str = "errorifexists", **options) -> None:
    """Read an all-numeric file (label last), remove links, write what is kept."""
    names = [f"f{i}" for i in range(n_features)]
    rows = with_row_key(read_numeric(spark, data_path, [*names, "label"], delimiter), "_key")
    kept = link_clean(rows, "_key", names, "label", **options)
    write_delimited(kept.select(*names, "label"), out_path, delimiter, mode)
