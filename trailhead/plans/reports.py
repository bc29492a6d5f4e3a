"""Reports over finished journeys. Every report aggregates before it joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import classify as fn
from ..operators.link import ALL_PATHS, DIRECT
from ..operators.skew import lookup_join


def totals(users: str = "hid") -> list[Column]:
    return [
        F.count_distinct(users).alias("num_si_users"),
        F.count("visit_id").alias("num_clicks"),
        F.sum("start_flag").alias("num_starts"),
        F.sum("watched_flag").alias("num_completes"),
    ]


def with_page_type(
    df: DataFrame, placement: str, mapping: DataFrame | None = None, lookup_rows: int = 1_000_000, salts: int = 64
) -> DataFrame:
    """Add `page_type`: from a mapping table of (placement, page_type) if given, else by pattern rules.

    Of several types for one placement the first in order counts. The home page may have most of the rows:
    a mapping of more than `lookup_rows` placements is joined salted.
    """
    if mapping is None:
        return df.withColumn("page_type", fn.page_type(F.col(placement)))
    named = mapping.groupBy(F.col("placement").alias(placement)).agg(F.min("page_type").alias("page_type"))
    joined = lookup_join(df, named, placement, ["hid", "visit_id"], lookup_rows, salts)
    return joined.withColumn("page_type", F.coalesce("page_type", F.lit("other")))


def on_home(journeys: DataFrame) -> DataFrame:
    return journeys.filter(F.col("click_placement") == c.HOME_PLACEMENT)


def funnel(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Users, clicks, starts and completes per page type and container."""
    return (
        with_page_type(journeys, "click_placement", mapping).groupBy("page_type", "click_container").agg(*totals())
    )


def homepage_funnel(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    return funnel(on_home(journeys), mapping)


TOTALS = ("num_si_users", "num_clicks", "num_starts", "num_completes")


def _tagged(skipping: DataFrame, keeping: DataFrame) -> DataFrame:
    tagged = {ALL_PATHS: skipping, DIRECT: keeping}
    first, second = [df.withColumn("variant", F.lit(name)) for name, df in tagged.items()]
    return first.unionByName(second)


def homepage_variants(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The home page funnel of both variants side by side: per page type and container the structs `a`
    (title pages skipped) and `b` (kept). Containers that only one variant has are left out.

    `journeys` has the column `variant`. Both funnels come from one aggregate.
    """
    counted = with_page_type(on_home(journeys), "click_placement", mapping)
    per_variant = counted.groupBy("page_type", "click_container", "variant").agg(*totals())

    def side(name: str, out: str) -> Column:
        return F.max(F.when(F.col("variant") == name, F.struct(*TOTALS))).alias(out)

    # A few rows per container by now. Without a container there is no match, as in a join.
    return (
        per_variant.filter("page_type IS NOT NULL AND click_container IS NOT NULL")
        .groupBy("page_type", "click_container")
        .agg(side(ALL_PATHS, "a"), side(DIRECT, "b"))
        .filter("a IS NOT NULL AND b IS NOT NULL")
    )


def compare_variants(journeys: DataFrame, modules=c.HOME_MODULES) -> DataFrame:
    """Home page modules side by side: all paths (title pages skipped) and the direct path only."""

    def larger(name: str) -> Column:
        a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
        return F.when(a > b, a).otherwise(b).alias(name)

    return homepage_variants(journeys.filter(F.col("click_container").isin(*modules))).select(
        "page_type",
        "click_container",
        larger("num_si_users"),
        larger("num_clicks"),
        F.col("a.num_starts").alias("both_paths_starts"),
        F.col("a.num_completes").alias("both_paths_completes"),
        F.col("b.num_starts").alias("direct_starts"),
        F.col("b.num_completes").alias("direct_completes"),
    )


def compare_paths(skipping: DataFrame, keeping: DataFrame, modules=c.HOME_MODULES) -> DataFrame:
    """`compare_variants` for variants that were built apart."""
    return compare_variants(_tagged(skipping, keeping), modules)


def variant_difference(journeys: DataFrame) -> DataFrame:
    """Per home page module, what went through a title page: all paths minus the direct path."""
    return homepage_variants(journeys).select(
        "page_type", "click_container", *[(F.col(f"a.{x}") - F.col(f"b.{x}")).alias(f"via_title_{x}") for x in TOTALS]
    )


def via_title_difference(skipping: DataFrame, keeping: DataFrame) -> DataFrame:
    """`variant_difference` for variants that were built apart."""
    return variant_difference(_tagged(skipping, keeping))


def playback_journeys(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Journeys that began at the end of playback, with page type and container group."""
    chosen = with_page_type(journeys, "click_placement", mapping).filter(
        (F.col("page_type") == "episode_page") & F.col("click_container").ilike("%next%")
    )
    return chosen.withColumn("container_group", fn.playback_group(F.col("click_container")))


def end_of_playback(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    return (
        playback_journeys(journeys, mapping)
        .groupBy("page_type", F.col("container_group").alias("click_container"))
        .agg(*totals())
    )


def playback_users(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    return (
        playback_journeys(journeys, mapping)
        .select("page_type", F.col("container_group").alias("click_container"), "hid")
        .distinct()
    )


CTA_KEY = ["dt", "hid", "visit_id", "click_container"]


def cta_hits(journeys: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Clicks on a call to action of a title page."""
    return with_page_type(journeys, "click_placement", mapping).filter(
        F.col("page_type").ilike("%TLEO%") & F.col("click_container").ilike("%CTA%")
    )


def cta_with_clicks(
    journeys: DataFrame, clicks: DataFrame, mapping: DataFrame | None = None, compat: bool = False
) -> DataFrame:
    """Call-to-action clicks confirmed by the raw clicks of the same visit and container.

    `copies` is 1. With `compat` it is the number of raw clicks that confirm the row: the reference
    joins them one by one, which counts a click once per raw click. The raw clicks are counted before
    the join, so no pairs are made.
    """
    raw = (
        with_page_type(clicks, "placement", mapping)
        .filter(F.col("page_type").ilike("%TLEO%"))
        .withColumnRenamed("container", "click_container")
        .groupBy(*CTA_KEY)
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = cta_hits(journeys, mapping).join(raw, CTA_KEY)
    return joined if compat else joined.withColumn("copies", F.lit(1).cast("long"))


def cta_funnel(
    journeys: DataFrame, clicks: DataFrame, mapping: DataFrame | None = None, compat: bool = False
) -> DataFrame:
    return (
        cta_with_clicks(journeys, clicks, mapping, compat)
        .groupBy("click_container")
        .agg(
            F.count_distinct("hid").alias("num_si_users"),
            F.sum("copies").alias("num_clicks"),
            F.sum(F.col("start_flag") * F.col("copies")).alias("num_starts"),
            F.sum(F.col("watched_flag") * F.col("copies")).alias("num_completes"),
        )
    )


def cta_users(journeys: DataFrame, clicks: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    return cta_with_clicks(journeys, clicks, mapping).select("hid").distinct()


def module_journeys(journeys: DataFrame, modules=c.HOME_MODULES) -> DataFrame:
    return on_home(journeys).filter(F.col("click_container").isin(*modules))


def homepage_module_users(journeys: DataFrame, mapping: DataFrame | None = None, modules=c.HOME_MODULES) -> DataFrame:
    """Users of the home page modules, one row per user and module."""
    return with_page_type(module_journeys(journeys, modules), "click_placement", mapping).select("page_type", "click_container", "hid").distinct()


def distinct_users(sources: dict[str, DataFrame], approximate: bool = False) -> DataFrame:
    """Signed-in users of each named source."""
    tagged = [df.select(F.lit(name).alias("source"), "hid") for name, df in sources.items()]
    users = F.approx_count_distinct("hid") if approximate else F.count_distinct("hid")
    return _union(tagged).groupBy("source").agg(users.alias("num_si_users"))


def distinct_visits(sources: dict[str, DataFrame]) -> DataFrame:
    """Visits of each named source; a visit id is unique only within a date."""
    tagged = [df.select(F.lit(name).alias("source"), "dt", "visit_id") for name, df in sources.items()]
    return _union(tagged).groupBy("source").agg(F.count_distinct("dt", "visit_id").alias("num_visits"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows per named stage."""
    return (
        _union([df.select(F.lit(name).alias("stage")) for name, df in stages.items()])
        .groupBy("stage")
        .agg(F.count(F.lit(1)).alias("num_rows"))
    )


def home_containers(journeys: DataFrame) -> DataFrame:
    return on_home(journeys).select("click_container").distinct()


def hop_funnel(outcomes: DataFrame) -> DataFrame:
    """Users, clicks, starts and completes per entry page."""
    return outcomes.groupBy("click_placement").agg(*totals())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
