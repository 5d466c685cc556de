"""Cutting lineage where one frame feeds several jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: ``spark.checkpoint.dir`` of the session or the one
    its context has; where neither is set, one in the warehouse, unless that is a folder of
    one machine and the session runs on several."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    folder = folder or spark.sparkContext.getCheckpointDir()
    return folder or f"{shared_warehouse(spark)}/_checkpoints"


def shared_warehouse(spark: SparkSession) -> str:
    """The warehouse, which must not be a folder of the driver's machine on a cluster."""
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own = folder.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local[")
    if own and spark.sparkContext.master != "local":
        raise RuntimeError(
            f"set spark.checkpoint.dir to a folder that all executors share; {folder} is local")
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there on."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
