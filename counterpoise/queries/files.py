"""Delimited text out and in again, through the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from counterpoise.materialize import shared_folder
from counterpoise.operators.classes import majority_rows, minority_rows
from counterpoise.queries import views as V
from counterpoise.sources import delimited as D

PART = ["p_partkey", "p_size", "p_retailprice", "p_type"]


def _written(df, delimiter: str = ",") -> str:
    path = f"{shared_folder(df.sparkSession)}/text-{uuid.uuid4().hex}"
    D.write_delimited(df, path, delimiter)
    return path


def q_text_round_trip(spark, folder):
    """The part table as delimited text, read back as tokens; every seventh price is empty."""
    part = V.table(spark, folder, "part").select(
        "p_partkey", "p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")), "p_type")
    return D.read_delimited(spark, _written(part, ";"), PART, ";")


def q_numeric_files(spark, folder):
    """Numeric text files loaded as doubles and split by their label."""
    line = V.table(spark, folder, "lineitem").select(
        *V.LINE_FEATURES, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))
    table = D.read_numeric(spark, _written(line), [*V.LINE_FEATURES, "label"])
    rare = minority_rows(table, "label", 1.0).withColumn("side", F.lit("minority"))
    return rare.unionByName(majority_rows(table, "label", 1.0).withColumn("side", F.lit("majority")))


QUERIES = {
    name: query for name, query in list(globals().items()) if name.startswith("q_")}

ORACLE = {
    "q_text_round_trip": """SELECT p_partkey::VARCHAR AS p_partkey, p_size::VARCHAR AS p_size,
        CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice::VARCHAR END AS p_retailprice, p_type
        FROM part""",
    "q_numeric_files": """SELECT l_quantity::DOUBLE AS l_quantity,
        l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount,
        l_tax::DOUBLE AS l_tax, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS label,
        CASE WHEN l_returnflag = 'R' THEN 'minority' ELSE 'majority' END AS side FROM lineitem""",
}
