"""Mapping tables that change over time: what a key stands for in a week."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DateWindow
from ..functions import classify as fn


def valid_per_week(mapping: DataFrame, key: str, value: str, window: DateWindow) -> DataFrame:
    """One row per key and week (its Monday) of the window, so that rows join it by equality.

    `mapping` has the columns key, value, valid_from and valid_to: dates, both inclusive, NULL if open.
    A week belongs to the period its Monday lies in. Rows without a key and periods that end before
    they begin count for nothing. Two rows for one key and week are an error, even if they agree:
    the query that reads the result fails and names both.
    """
    first, last = fn.week_of(F.lit(window.first)), fn.week_of(F.lit(window.last))
    # Monday on or after the first day: the week of the day six days on.
    begin = F.date_trunc("week", F.date_add("valid_from", 6)).cast("date")
    weeks = (
        mapping.filter(F.col(key).isNotNull())
        .withColumn("begin", F.greatest(first, F.coalesce(begin, first)))
        .withColumn("end", F.least(last, F.coalesce("valid_to", last)))
        .filter(F.col("begin") <= F.col("end"))
        .select(key, value, F.explode(F.sequence("begin", "end", F.expr("interval 7 days"))).alias("week"))
    )
    refused = F.raise_error(
        F.concat(F.lit("overlapping validity: "), F.col(key).cast("string"), F.lit(" in the week of "), F.col("week").cast("string"))
    )
    return (
        weeks.groupBy(key, "week")
        .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_value"))
        .select(key, "week", F.when(F.col("_n") > 1, refused.cast("string")).otherwise(F.col("_value")).alias(value))
    )
