"""Who is followed: visits on a trackable platform, made by signed-in users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DateWindow, Settings
from ..functions import classify as fn
from ..sources.stages import materialise
from ..sources.tables import Inputs
from .mappings import valid_per_week
from .skew import block_of, hot_keys, lookup_join, spread_join

RAW_VISIT = ["dt", "cookie_id", "visit_id"]


def _platforms(activity: DataFrame) -> DataFrame:
    return (
        activity.filter(fn.trackable(F.col("app_type")))
        .select("dt", "visit_id", fn.platform_of(F.col("app_type")).alias("platform"))
        .distinct()
    )


def visit_platforms(
    hits: DataFrame, activity: DataFrame, hot_rows: int = 1_000_000, salts: int = 64
) -> DataFrame:
    """Distinct visits among the hits, with the platform the activity table gives them.

    A (dt, visit id) that very many cookies share is spread over tasks.
    """
    visits = materialise(hits.select("destination", *RAW_VISIT).distinct(), "visits")
    key = ["dt", "visit_id"]
    hot = hot_keys(visits, key, hot_rows)
    joined = spread_join(visits, _platforms(activity), key, hot, key, ["cookie_id", "destination"], salts)
    return joined.select("destination", *RAW_VISIT, "platform")


def user_weeks(
    profile: DataFrame,
    weekly_frequency: DataFrame,
    arms: DataFrame | None = None,
    keep_unsegmented: bool = False,
    groups: dict[str, str] | DataFrame | None = None,
    lookup_rows: int = 1_000_000,
    salts: int = 64,
) -> DataFrame:
    """Age range, frequency band and, if given, the experiment arm per user and week.

    `groups` maps bands to groups: pairs, or a table of frequency_band, week and frequency_group.
    A user with no frequency row for a week is dropped unless `keep_unsegmented`; their `week` is then NULL.
    """
    # Distinct before the joins, so that copies of a user's rows do not multiply.
    users = profile.select("hid", fn.age_band(F.col("age")).alias("age_range")).distinct()
    raw = weekly_frequency.select("hid", F.col("date_of_segmentation").alias("week"), "frequency_band")
    if isinstance(groups, DataFrame):
        raw = _with_group(raw.distinct(), groups, lookup_rows, salts)
    else:
        raw = raw.withColumn("frequency_group", fn.frequency_group(F.col("frequency_band"), groups))
    bands = raw.withColumn("frequency_band", fn.frequency_band(F.col("frequency_band"))).distinct()
    out = users.join(bands, "hid", "left" if keep_unsegmented else "inner")
    if arms is None:
        return out
    assigned = out.join(arms.select("hid", "exp_group").distinct(), "hid", "left")
    return assigned.withColumn("exp_group", F.coalesce("exp_group", F.lit("unknown")))


def _with_group(bands: DataFrame, groups: DataFrame, lookup_rows: int, salts: int) -> DataFrame:
    """The group of each band in its week; few bands have most rows, so a large table is joined salted."""
    key = F.struct("frequency_band", "week")
    named = groups.select(key.alias("_key"), "frequency_group")
    joined = lookup_join(bands.withColumn("_key", key), named, "_key", ["hid"], lookup_rows, salts).drop("_key")
    group = F.when(F.col("frequency_band").isNull(), "new").otherwise(F.coalesce("frequency_group", F.lit("other")))
    return joined.withColumn("frequency_group", group)


def in_weeks(weekly_frequency: DataFrame, window: DateWindow) -> DataFrame:
    """The weeks that overlap the window; the table holds all of history."""
    first, last = fn.week_of(F.lit(window.first)), fn.week_of(F.lit(window.last))
    return weekly_frequency.filter(F.col("date_of_segmentation").between(first, last))


def visit_blocks(hits: DataFrame, url_events: DataFrame, block_size: int) -> DataFrame:
    """The slices of each visit that hold any event, so that later joins can match slice by slice."""
    block = block_of(F.col("event_position"), block_size).alias("block")
    seen = hits.select("destination", *RAW_VISIT, block, F.lit(1).alias("in_hits"))
    linked = url_events.filter(F.col("url").contains("deeplink")).select(
        "destination", *RAW_VISIT, block, F.lit(0).alias("in_hits")
    )
    return (
        seen.unionByName(linked)
        .groupBy("destination", *RAW_VISIT, "block")
        .agg(F.max("in_hits").alias("in_hits"))
    )


def population_blocks(inputs: Inputs, settings: Settings) -> DataFrame:
    """Signed-in population, one row per visit and slice.

    Almost every visit has a single slice. `wide` marks the others: a visit made of millions of
    events appears here once per slice, and everything joined to it is divided the same way.
    """
    inputs = inputs.scoped(settings)
    audiences = inputs.visits.select("destination", *RAW_VISIT, F.col("audience_id").alias("hid")).distinct()
    per_visit = Window.partitionBy("destination", *RAW_VISIT)
    visits = (
        visit_blocks(inputs.hits, inputs.url_events, settings.block_size)
        .join(audiences, ["destination", *RAW_VISIT])
        .withColumns(
            {
                "wide": F.max("block").over(per_visit) > 0,
                "in_hits": F.max("in_hits").over(per_visit),
                "week": fn.week_of(F.col("dt")),
            }
        )
        .filter((F.col("in_hits") == 1) & F.col("hid").isNotNull())
        .drop("in_hits")
    )
    # Written once: the two checks for hot keys and the joins then start from visits, not from hits.
    visits = materialise(visits, "visits")
    with_platform = spread_join(
        visits,
        _platforms(inputs.activity),
        on=["dt", "visit_id"],
        hot=hot_keys(visits, ["dt", "visit_id"], settings.hot_rows),
        hot_on=["dt", "visit_id"],
        spread_by=["cookie_id", "hid", "block"],
        salts=settings.salts,
    )
    groups: dict[str, str] | DataFrame | None = dict(settings.frequency_groups) or None
    if inputs.frequency_groups is not None:
        groups = valid_per_week(inputs.frequency_groups, "frequency_band", "frequency_group", settings.window)
    # All three tables hold every user of the product; only those with a visit are joined to each other.
    present = visits.select("hid").distinct()

    def of_visitors(table: DataFrame) -> DataFrame:
        return table.join(present, "hid", "left_semi")

    arms = inputs.arm_assignments
    users = user_weeks(
        of_visitors(inputs.profile),
        of_visitors(in_weeks(inputs.weekly_frequency, settings.window)),
        None if arms is None else of_visitors(arms),
        settings.keep_unsegmented,
        groups,
        settings.lookup_rows,
        settings.salts,
    )
    if settings.keep_unsegmented:
        users = _every_week(users, with_platform)
    joined = spread_join(
        with_platform,
        users,
        on=["hid", "week"],
        hot=hot_keys(visits, ["hid"], settings.hot_rows),
        hot_on=["hid"],
        spread_by=["dt", "cookie_id", "visit_id", "block"],
        salts=settings.salts,
    )
    # The week stays in until rows are distinct: the join's partitioning on it then serves both.
    return joined.distinct().drop("week")


def _every_week(users: DataFrame, visits: DataFrame) -> DataFrame:
    """Add a 'new' row for each user and visited week that has no frequency row."""
    banded = users.filter(F.col("week").isNotNull())
    attributes = [x for x in users.columns if x not in ("week", "frequency_band", "frequency_group")]
    missing = visits.select("hid", "week").distinct().join(banded, ["hid", "week"], "left_anti")
    added = (
        missing.join(users.select(*attributes).distinct(), "hid")
        .withColumn("frequency_band", F.lit("new"))
        .withColumn("frequency_group", F.lit("new"))
    )
    return banded.unionByName(added)


def signed_in_population(population: DataFrame) -> DataFrame:
    """The population at visit level, as reports count it."""
    return population.drop("block", "wide").distinct()


def dedupe_population(population: DataFrame) -> DataFrame:
    """One row per (dt, user, visit): the attributes of the first cookie and platform in sort order."""
    key = ["dt", "hid", "visit_id"]
    rest = [x for x in population.columns if x not in key]
    return population.groupBy(*key).agg(F.min(F.struct(*rest)).alias("first")).select(*key, "first.*")


def restrict(rows: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    """Rows of the population's visits, with the user id; joined per slice of a visit."""
    users = population.select("destination", *RAW_VISIT, "block", "wide", "hid").distinct()
    placed = rows.withColumn("block", block_of(F.col("event_position"), block_size))
    return placed.join(users, ["destination", *RAW_VISIT, "block"])


def module_impressions(hits: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    """Home page modules shown to web visits."""
    web = population.filter(F.col("platform") == "web").select(
        "destination", *RAW_VISIT, "block", "hid", "platform", "age_range"
    )
    shown = hits.filter(fn.is_home_impression(F.col("placement"), F.col("is_impression"))).select(
        "destination",
        *RAW_VISIT,
        block_of(F.col("event_position"), block_size).alias("block"),
        fn.normalise_container(F.col("container")).alias("container"),
    )
    # Distinct first: the many impressions of a visit are few blocks and containers.
    return (
        shown.distinct()
        .join(web.distinct(), ["destination", *RAW_VISIT, "block"])
        .select("dt", "cookie_id", "hid", "platform", "age_range", "visit_id", "container")
        .distinct()
    )
