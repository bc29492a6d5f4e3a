"""Writing results and intermediate stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` as parquet and return it read back, so that later steps start from the files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_arms(results: DataFrame, path: str, arms: tuple[str, ...] | None = None) -> DataFrame:
    """One folder per experiment arm, all written by one job; returned read back, so that a filter on
    `exp_group` opens only that arm's folder. Arms that are not asked for are not written."""
    chosen = results if arms is None else results.filter(F.col("exp_group").isin(*arms))
    return write_stage(chosen, path, ("exp_group",))


def stage_folder(spark: SparkSession) -> str | None:
    """The cluster's shared checkpoint folder. Only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trailhead-"))
        folder = context.getCheckpointDir()
    return folder


def _app_folder(spark: SparkSession, folder: str) -> str:
    return f"{folder.rstrip('/')}/trailhead/{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A folder of its own for one stage of this application."""
    folder = stage_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{_app_folder(spark, folder)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Compute a stage that several later steps read once, as columnar files that outlive any executor."""
    return write_stage(df, stage_path(df.sparkSession, name))


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stages of this application, once the results built on them are written."""
    folder = stage_folder(spark)
    if folder is not None:
        delete_folder(spark, _app_folder(spark, folder))
