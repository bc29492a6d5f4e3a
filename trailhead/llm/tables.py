"""Staged tables and size-checked joins shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BITS_PER_BITMAP = 32_768
MOST_BROADCAST_ROWS = 500_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = "1m"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session may make its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trailhead-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read into the shared folder, and read it back.

    The files outlive any executor; later steps restart from them.
    """
    path = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, step: Callable, schema: StructType | str) -> DataFrame:
    """`df.mapInArrow(step, schema)` in batches of about `MOST_BATCH_BYTES`; one row may be longer.

    By default a batch has 10,000 rows, which for whole texts takes hundreds of MB of an executor outside its heap. Spark
    reads the limit when the result is computed, so it stays set in the session; one set by the caller is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES, None) is None:
        conf.set(BATCH_BYTES, MOST_BATCH_BYTES)
    return df.mapInArrow(step, schema)


def row_key() -> Column:
    """Identifies a document by id and text; repeated rows share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name do no harm."""
    return docs.select("doc_id", "text", *more)


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """`text`, all other columns as the struct `rest`, whatever their names, and copies of those in `more`."""
    others = [docs[f"`{x}`"] for x in docs.columns if x != "text"]
    return docs.select(F.struct(*others).alias("rest"), "text", *more)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the documents that were packed."""
    return rows.select(*[(F.col("text") if x == "text" else F.col("rest")[x]).alias(x) for x in columns])


def small(df: DataFrame, rows: int, most_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Mark `df` for broadcasting if its counted `rows` are at most `most_rows`; else leave the join to shuffles."""
    return F.broadcast(df) if rows <= most_rows else df
