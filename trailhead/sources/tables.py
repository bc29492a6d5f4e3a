"""Reading the input tables, and the filters every reader shares."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DateWindow, Settings
from ..schemas import INPUTS, assert_schema


def in_window(df: DataFrame, window: DateWindow) -> DataFrame:
    """Literal bounds on `dt`, so that files or partitions outside the window are never opened."""
    return df.filter(F.col("dt").between(window.first, window.last))


def for_product(df: DataFrame, product: str) -> DataFrame:
    return df.filter(F.col("destination") == product)


def scoped(df: DataFrame, settings: Settings) -> DataFrame:
    return for_product(in_window(df, settings.window), settings.product)


def catalogue_snapshot(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(*INPUTS["catalogue"].fieldNames()).distinct()


def read_table(spark: SparkSession, table: str, location: str) -> DataFrame:
    """One input table, from a folder of parquet files or, without a '/', from the session catalog.

    Files are read with the declared types, so a folder that is partitioned by `dt` keeps it as text.
    """
    if "/" not in location:
        return assert_schema(spark.table(location), table)
    declared = INPUTS[table]
    missing = sorted(set(declared.fieldNames()) - set(spark.read.parquet(location).columns))
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)} in {location}")
    return assert_schema(spark.read.schema(declared).parquet(location), table)


@dataclass(frozen=True)
class Inputs:
    """The tables one run reads."""

    hits: DataFrame
    activity: DataFrame
    visits: DataFrame
    url_events: DataFrame
    profile: DataFrame
    weekly_frequency: DataFrame
    catalogue: DataFrame
    arm_assignments: DataFrame | None = None
    frequency_groups: DataFrame | None = None

    def scoped(self, settings: Settings) -> "Inputs":
        """The same tables, with the dated ones cut to the window and the product."""
        return replace(
            self,
            hits=scoped(self.hits, settings),
            activity=scoped(self.activity, settings),
            visits=scoped(self.visits, settings),
            url_events=scoped(self.url_events, settings),
        )


def read_inputs(spark: SparkSession, locations: dict[str, str]) -> Inputs:
    return Inputs(**{table: read_table(spark, table, place) for table, place in locations.items()})
