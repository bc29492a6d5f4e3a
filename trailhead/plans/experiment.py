"""Experiment reports. Population and journeys carry `exp_group`, joined in at user level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as c
from .reports import on_home


def visits_by_frequency(journeys: DataFrame) -> DataFrame:
    return (
        journeys.groupBy("frequency_band")
        .agg(F.count_distinct("dt", "visit_id").alias("num_visits"))
        .orderBy("frequency_band")
    )


def arm_platform_users(journeys: DataFrame) -> DataFrame:
    """Users and visit ids per platform and arm. Visit ids are counted without the date here."""
    return journeys.groupBy("platform", "exp_group").agg(
        F.count_distinct("hid").alias("num_users"), F.count_distinct("visit_id").alias("num_visits")
    )


def arm_users(journeys: DataFrame) -> DataFrame:
    return journeys.groupBy("exp_group").agg(F.count_distinct("hid").alias("num_users"))


def population_stats(population: DataFrame, by: list[str]) -> DataFrame:
    """Users, cookies and visits of everyone in the experiment, clicking or not."""
    return population.groupBy(*by).agg(
        F.count_distinct("hid").alias("num_hids"),
        F.count_distinct("cookie_id").alias("num_uv"),
        F.count_distinct("dt", "hid", "visit_id").alias("num_visits"),
    )


def module_stats(journeys: DataFrame, by: list[str], clicks: str) -> DataFrame:
    return journeys.groupBy(*by).agg(
        F.sum("start_flag").alias("num_starts"),
        F.sum("watched_flag").alias("num_watched"),
        F.count("visit_id").alias(clicks),
    )


def _report(population: DataFrame, journeys: DataFrame, by: list[str], clicks: str) -> DataFrame:
    """Both sides are aggregated to one row per group before they meet."""
    users = population_stats(population, by).withColumnRenamed("num_hids", "num_signed_in_users").drop("num_uv")
    return (
        users.join(module_stats(journeys, by, clicks), by)
        .select(*by, "num_signed_in_users", "num_visits", "num_starts", "num_watched", clicks)
        .orderBy(*by)
    )


def arm_module_report(population: DataFrame, journeys: DataFrame, module: str = c.RECOMMENDED_MODULE) -> DataFrame:
    """Home page modules other than `module`, per platform and arm."""
    others = on_home(journeys).filter(F.col("click_container") != module)
    return _report(population, others, ["platform", "exp_group"], "num_clicks_to_module")


def arm_age_report(population: DataFrame, journeys: DataFrame, module: str = c.RECOMMENDED_MODULE) -> DataFrame:
    """`module` alone, per platform, arm and age range, without the youngest."""
    chosen = on_home(journeys).filter(F.col("click_container") == module)
    adults = F.col("age_range") != "under 10"
    return _report(
        population.filter(adults),
        chosen.filter(adults),
        ["platform", "exp_group", "age_range"],
        "num_clicks_to_module",
    )


def arm_product_report(population: DataFrame, journeys: DataFrame) -> DataFrame:
    return _report(population, journeys, ["platform", "exp_group"], "num_clicks")


def impression_visits(
    impressions: DataFrame, journeys: DataFrame, module: str = c.RECOMMENDED_MODULE
) -> DataFrame:
    """Visits that were shown a module, per platform, arm and age range.

    Both sides are made distinct first, so a visit with many impressions and clicks joins once.
    """
    key = ["dt", "visit_id", "platform", "hid"]
    shown = impressions.filter(F.col("container") == module).select(*key).distinct()
    clicked = (
        journeys.filter(F.col("age_range") != "under 10").select(*key, "exp_group", "age_range").distinct()
    )
    by = ["platform", "exp_group", "age_range"]
    return (
        shown.join(clicked, key)
        .groupBy(*by)
        .agg(F.count_distinct("visit_id").alias("num_visits_saw_module"))
        .orderBy(*by)
    )


def arm_population_overview(population: DataFrame) -> DataFrame:
    return (
        population.filter(F.col("exp_group") != "unknown")
        .groupBy("exp_group")
        .agg(
            F.count_distinct("hid").alias("num_signed_in_users"),
            F.count_distinct("dt", "visit_id").alias("num_visits"),
        )
        .orderBy("exp_group")
    )


def arm_module_overview(journeys: DataFrame, module: str = c.RECOMMENDED_MODULE) -> DataFrame:
    chosen = on_home(journeys).filter(F.col("click_container") == module)
    return module_stats(chosen, ["exp_group"], "num_clicks").orderBy("exp_group")


def _module_metrics(journeys: DataFrame, by: list[str], module: str) -> DataFrame:
    chosen = on_home(journeys).filter(F.col("click_container") == module)
    return chosen.groupBy(*by).agg(
        F.sum("start_flag").alias("num_starts"), F.sum("watched_flag").alias("num_watched")
    )


def user_results(population: DataFrame, journeys: DataFrame, module: str = c.RECOMMENDED_MODULE) -> DataFrame:
    """Starts and completes of a module for every user, clicking or not: the input of the statistics.

    A user has one row per frequency band they were in.
    """
    key = ["exp_group", "age_range", "hid"]
    users = population.select(*key, "frequency_band", "frequency_group").distinct()
    return (
        users.join(_module_metrics(journeys, key, module), key, "left")
        .fillna(0, subset=["num_starts", "num_watched"])
        .select(*users.columns, "num_starts", "num_watched")
    )


def engagement_groups(population: DataFrame, journeys: DataFrame, module: str = c.RECOMMENDED_MODULE) -> DataFrame:
    """Users by how many starts they made from a module."""
    users = population.select("hid").distinct()
    per_user = users.join(_module_metrics(journeys, ["hid"], module), "hid", "left").fillna(
        0, subset=["num_starts", "num_watched"]
    )
    return per_user.groupBy(F.col("num_starts").alias("starts_per_user")).agg(
        F.count("hid").alias("num_users"),
        F.sum("num_starts").alias("num_starts"),
        F.sum("num_watched").alias("num_watched"),
    )


def population_dates(population: DataFrame) -> DataFrame:
    return population.select("dt").distinct()
