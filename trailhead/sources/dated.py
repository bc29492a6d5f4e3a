"""Stages kept by date: when rows of one date arrive late, only that date is built again.

A stage is a folder with `data/run=<run>/dt=<date>` and a `manifest`, a table that is only appended to:
per run and rebuilt date, what the source held (row count and digest) and how many rows the result has.
The last entry of a date is the valid one, and it is appended after the data are written. A run that
fails leaves data no entry names; readers see the stage as it was. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import delete_folder

MANIFEST = "run_no long, run string, dt string, source_rows long, digest decimal(38,0), num_rows long"


def date_digests(source: DataFrame) -> DataFrame:
    """dt, source_rows, digest: the sum of the row hashes, whatever the order of rows. Copies of a row count."""
    row_hash = F.xxhash64(*sorted(source.columns)).cast("decimal(20,0)")
    return (
        source.filter("dt IS NOT NULL")
        .groupBy("dt")
        .agg(F.count("*").alias("source_rows"), F.sum(row_hash).cast("decimal(38,0)").alias("digest"))
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The valid entry of each date; no rows if the stage was never written."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    fields = [x for x in entries.columns if x not in ("dt", "run_no")]
    last = entries.groupBy("dt").agg(F.max(F.struct("run_no", *fields)).alias("last"))
    return last.select("last.run_no", "last.run", "dt", *[f"last.{x}" for x in fields if x != "run"])


def changed_dates(source: DataFrame, path: str) -> DataFrame:
    """Dates whose source rows are not those the stage was built from; source_rows is 0 if all are gone."""
    before = manifest(source.sparkSession, path).select(
        "dt", F.col("source_rows").alias("old_rows"), F.col("digest").alias("old_digest")
    )
    unlike = ~(F.col("source_rows").eqNullSafe(F.col("old_rows")) & F.col("digest").eqNullSafe(F.col("old_digest")))
    gone = F.col("source_rows").isNull() & (F.col("old_rows") == 0)
    return (
        date_digests(source)
        .join(before, "dt", "full")
        .filter(unlike & ~F.coalesce(gone, F.lit(False)))
        .select("dt", F.coalesce("source_rows", F.lit(0)).alias("source_rows"), "digest")
    )


def update_dates(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Bring the stage up to date with `source`; returns the dates that were built again, in order.

    `build` makes the result from source rows; its rows must have the column dt and depend on source
    rows of the same dt only. It is given the rows of the changed dates, by literal dates, so that
    partitions of the others are not read. What goes to the driver is one row per changed date. Rows
    without a date are in no partition: they are left out. When something else that `build` reads has
    changed, take a new folder.
    """
    spark = source.sparkSession
    changed = {x.dt: x for x in changed_dates(source, path).collect()}
    if not changed:
        return []
    dates, run = sorted(changed), uuid.uuid4().hex
    number = (manifest(spark, path).agg(F.max("run_no")).head()[0] or 0) + 1
    rows = build(source.filter(F.col("dt").isin(*dates)))
    rows.filter(F.col("dt").isin(*dates)).write.partitionBy("dt").parquet(f"{path}/data/run={run}")
    # An empty result has no files, and its dates no folders.
    written = spark.read.schema(rows.schema).parquet(f"{path}/data/run={run}")
    counts = {x.dt: x["count"] for x in written.groupBy("dt").count().collect()}
    entries = [(number, run, x.dt, x.source_rows, x.digest, counts.get(x.dt, 0)) for x in changed.values()]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return dates


def read_dates(spark: SparkSession, path: str, schema, first: str | None = None, last: str | None = None) -> DataFrame:
    """The valid rows of the stage, of the dates `first` to `last`; only the folders of these dates are opened."""
    valid = manifest(spark, path).filter("num_rows > 0")
    if first is not None:
        valid = valid.filter(F.col("dt") >= first)
    if last is not None:
        valid = valid.filter(F.col("dt") <= last)
    folders = [f"{path}/data/run={x.run}/dt={x.dt}" for x in valid.select("run", "dt").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return found.select(*schema.fieldNames())


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete the folders of entries that a later run replaced, once nobody reads them; returns their number."""
    entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("run", "dt")
    old = entries.join(manifest(spark, path).select("run", "dt"), ["run", "dt"], "left_anti").collect()
    for x in old:
        delete_folder(spark, f"{path}/data/run={x.run}/dt={x.dt}")
    return len(old)
