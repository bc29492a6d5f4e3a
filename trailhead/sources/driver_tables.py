"""Input tables made from the generic event, customer and part tables (see FIXTURES.md, section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..config import DateWindow, Settings
from ..operators.skew import hot_keys, number_rows
from ..schemas import INPUTS
from .stages import materialise
from .tables import Inputs

WINDOW = DateWindow("20240101", "20240131")
SETTINGS = Settings(window=WINDOW)
OTHER_PRODUCT = "PS_OTHER"
WEEK_SECONDS = 7 * 24 * 3600

STANDARD_ATTRIBUTES = (
    "content-item-poster",
    "start-watching-now",
    "resume",
    "next-episode",
    "search-result-episode~click",
    "page-section-related~select",
)
AUTOPLAY_ATTRIBUTES = ("squeeze-auto-play", "squeeze-play", "end-play", "end-auto-play", "select-play")
CONTAINERS = (
    c.RECOMMENDED_MODULE,
    c.CONTINUE_MODULE,
    "module-if-you-liked-p0000001",
    "tleo-cta",
    "onward-next-episode",
    "onward-next-rec",
    "module-other",
)
JOURNEY_NAMES = (c.HOME_PLACEMENT, "site.tv.tleo.page", "site.tv.episode.page", c.RECOMMENDATIONS_PAGE)
JOURNEY_PAGES = ("home_page", c.TITLE_PAGE, c.EPISODE_PAGE, c.WATCHING_PAGE)


def _quoted(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" for v in values)


def _pick(values, index: str) -> str:
    return f"element_at(array({_quoted(values)}), cast({index} + 1 as int))"


def _id(prefix: str, number: str) -> str:
    return f"concat('{prefix}', lpad(cast({number} as string), 7, '0'))"


EPISODE = _id("p", "k % 8")
PLACEMENT = f"""CASE (k div 7) % 5
    WHEN 1 THEN 'site.tv.tleo.page'
    WHEN 2 THEN concat('site.tv.episode.', {EPISODE}, '.page')
    WHEN 3 THEN CASE WHEN k % 2 = 0 THEN '{c.RECOMMENDATIONS_PAGE}' WHEN k % 13 = 0 THEN NULL
        ELSE '{c.HOME_PLACEMENT}' END
    ELSE '{c.HOME_PLACEMENT}' END"""


# The columns used of each table. Declaring them saves a job that opens files to find out.
COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{folder}/{table}.parquet")


def _weeks(events: DataFrame) -> DataFrame:
    """Events with the week they fall into, in the few narrow columns that all others follow from."""
    return events.selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "cast(get_json_object(props, '$.k') as int) AS k",
        "date_sub(to_date(ts), weekday(to_date(ts))) AS monday",
    )


def _named(weeks: DataFrame) -> DataFrame:
    """Events with the columns all inputs share. A visit is all a user does in a week."""
    return weeks.selectExpr(
        "*",
        "date_format(date_add(monday, cast(user_id % 7 as int)), 'yyyyMMdd') AS dt",
        f"CASE WHEN user_id % 12 = 11 THEN '{OTHER_PRODUCT}' ELSE '{c.PRODUCT}' END AS destination",
        "concat('c', user_id) AS cookie_id",
        "cast(user_id as string) AS hid",
        "concat(user_id, '-', date_format(monday, 'yyyyMMdd')) AS visit_id",
    )


def _numbered(events: DataFrame, settings: Settings) -> DataFrame:
    """User-week events with their position. A user-week too large for one task is numbered in time slices.

    Only narrow columns are shuffled and sorted; names are made of them behind the windows.
    """
    return _named(_positions(_weeks(events), settings))


def _positions(rows: DataFrame, settings: Settings) -> DataFrame:
    keys, order = ["user_id", "monday"], [F.col("ts"), F.col("event_id")]
    # A week of a user has no more rows than the user, and counting by user needs one column.
    hot = None
    if hot_keys(rows, ["user_id"], settings.hot_rows) is not None:
        hot = hot_keys(rows, keys, settings.hot_rows)
    if hot is None:
        flat = rows.withColumn("slice", F.lit(0).cast("long"))
        return number_rows(flat, keys, "slice", None, order, "event_position").drop("slice")
    slices = F.ceil(F.col("hot_n") / F.lit(settings.hot_rows)) * 4
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("monday").cast("timestamp"))
    sliced = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("slice", F.coalesce(F.floor(second * slices / F.lit(WEEK_SECONDS)), F.lit(0)).cast("long"))
        .withColumn("big", F.col("hot_n").isNotNull())
        .drop("hot_n")
    )
    return number_rows(sliced, keys, "slice", "big", order, "event_position").drop("slice", "big")


def _tracked(numbered: DataFrame) -> DataFrame:
    """Numbered events with the columns of a tracking hit and, for sign-ups, the URL that led there."""
    click = f"""CASE WHEN k % 10 < 6 THEN {_pick(STANDARD_ATTRIBUTES, "least(k % 10, 5)")}
        WHEN k % 10 = 6 THEN {_pick(AUTOPLAY_ATTRIBUTES, "(k div 10) % 5")}
        WHEN k % 10 = 7 THEN 'onward-journey-panel~select'
        WHEN k % 10 = 8 THEN 'content-item~select-play'
        ELSE 'navigation~select' END"""
    target = f"""CASE WHEN k = 98 THEN '' WHEN k = 97 THEN NULL WHEN k div 20 = 4 THEN '{c.UNKNOWN}'
        WHEN k div 20 = 3 THEN {_id("b", "(k % 8) div 4")} WHEN k div 20 = 2 THEN {_id("s", "(k % 8) div 2")}
        ELSE {EPISODE} END"""
    return numbered.selectExpr(
        "*",
        f"{_pick(CONTAINERS, 'k % 7')} AS container",
        f"""CASE event_type WHEN 'click' THEN {click} WHEN 'view' THEN '{c.START_ATTRIBUTE}'
            WHEN 'purchase' THEN '{c.COMPLETE_ATTRIBUTE}'
            ELSE CASE WHEN k % 5 = 0 THEN 'onward-journey-panel~complete' ELSE 'module~impression' END END
            AS attribute""",
        f"""CASE WHEN event_type = 'error' AND k % 2 = 0 THEN '{c.HOME_PLACEMENT}' ELSE {PLACEMENT} END
            AS placement""",
        f"CASE WHEN event_type IN ('view', 'purchase') THEN {EPISODE} ELSE {target} END AS result",
        "CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click",
        "CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS is_impression",
        f"""CASE k % 4
            WHEN 0 THEN concat('https://host.example/b0abcdef/playback/', {EPISODE}, '?deeplink=1')
            WHEN 1 THEN 'https://host.example/Playback/live?deeplink=1'
            WHEN 2 THEN concat('https://host.example/title/', {EPISODE}, '?deeplink=1')
            ELSE 'https://host.example/home' END AS url""",
    )


def _hits(tracked: DataFrame) -> DataFrame:
    return tracked.filter("event_type <> 'signup'").select(*INPUTS["hits"].fieldNames())


def _url_events(tracked: DataFrame) -> DataFrame:
    return tracked.filter("event_type = 'signup'").select(*INPUTS["url_events"].fieldNames())


def activity(weeks: DataFrame) -> DataFrame:
    apps = _pick(("tv|Bigscreen-HTML|1", "tv|bigscreen-html|2", "web|responsive", c.MOBILE_APP), "user_id % 4")
    return weeks.selectExpr("destination", "dt", "visit_id", f"CASE WHEN k % 10 <> 0 THEN {apps} END AS app_type")


def visits(weeks: DataFrame) -> DataFrame:
    return weeks.selectExpr(
        "destination", "dt", "cookie_id", "visit_id", "CASE WHEN user_id % 9 <> 8 THEN hid END AS audience_id"
    )


def shared_visits(weeks: DataFrame) -> DataFrame:
    """Visits in which, for every third user, the next user is signed in as well."""
    next_user = weeks.filter("user_id % 3 = 0").selectExpr(
        "destination", "dt", "cookie_id", "visit_id", "cast(user_id + 1 as string) AS audience_id"
    )
    return visits(weeks).unionByName(next_user)


def profile(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "cast(c_custkey as string) AS hid", "cast(CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 60 END as int) AS age"
    )


def weekly_frequency(customer: DataFrame) -> DataFrame:
    # Some customers were only grouped in weeks long past, and count as not grouped.
    return customer.selectExpr(
        "cast(c_custkey as string) AS hid",
        f"{_pick(('A. Daily', 'C. Weekly', 'D. Monthly', None), 'c_custkey % 4')} AS frequency_band",
        "explode(transform(sequence(date'2023-12-25', date'2024-02-05', interval 7 days), "
        "x -> date_sub(x, if(c_custkey % 11 = 10, 364, 0)))) AS date_of_segmentation",
    )


def frequency_groups(weekly: DataFrame) -> DataFrame:
    """Groups of the daily and weekly bands, which change their names in the middle of January."""
    periods = """stack(2, concat('early-', left(frequency_band, 1)), cast(null AS date), date'2024-01-14',
        concat('late-', left(frequency_band, 1)), date'2024-01-15', cast(null AS date))
        AS (frequency_group, valid_from, valid_to)"""
    bands = weekly.filter("frequency_band < 'D'").select("frequency_band").distinct()
    return bands.selectExpr("frequency_band", periods)


def catalogue(part: DataFrame) -> DataFrame:
    series, brand = "p_partkey div 2", "p_partkey div 4"
    # Some parts have no episode id, and match nothing.
    return part.selectExpr(
        "p_brand AS master_brand_name",
        "lower(p_brand) AS master_brand_id",
        f"concat('Brand ', {brand}) AS brand_title",
        f"{_id('b', brand)} AS brand_id",
        f"concat('Series ', {series}) AS series_title",
        f"CASE WHEN p_partkey % 8 <> 6 THEN {_id('s', series)} END AS series_id",
        f"CASE WHEN p_partkey % 8 <> 7 THEN {_id('p', 'p_partkey')} END AS episode_id",
        "p_name AS episode_title",
        "p_type AS genre",
    )


def arm_assignments(customer: DataFrame) -> DataFrame:
    arms = _pick(("control", "variation_1", "variation_2", "unknown"), "(c_custkey div 3) % 4")
    return customer.selectExpr("cast(c_custkey as string) AS hid", f"{arms} AS exp_group")


def staged_events(spark: SparkSession, folder: str, settings: Settings = SETTINGS) -> DataFrame:
    """The tracked events, written once for all plans of a run that read them."""
    tracked = _tracked(_numbered(_read(spark, folder, "events"), settings))
    return materialise(tracked.drop("event_id", "ts", "monday"), "tracked")


def driver_inputs(
    spark: SparkSession,
    folder: str,
    settings: Settings = SETTINGS,
    stage: bool = False,
    shared: bool = False,
    staged: DataFrame | None = None,
) -> Inputs:
    """All inputs of the journey builder. `stage` writes the tracked events once, for plans that read
    hits or URL events more than once; `staged` gives them as already written (`staged_events`); `shared`
    gives visits a second user."""
    events, customer = _read(spark, folder, "events"), _read(spark, folder, "customer")
    if stage and staged is None:
        staged = staged_events(spark, folder, settings)
    if staged is not None:
        tracked = weeks = staged
    else:
        tracked, weeks = _tracked(_numbered(events, settings)), _named(_weeks(events))
    return Inputs(
        hits=_hits(tracked),
        activity=activity(weeks),
        visits=shared_visits(weeks) if shared else visits(weeks),
        url_events=_url_events(tracked),
        profile=profile(customer),
        weekly_frequency=weekly_frequency(customer),
        catalogue=catalogue(_read(spark, folder, "part")),
        arm_assignments=arm_assignments(customer),
    )


def _pages(spark: SparkSession, folder: str, settings: Settings, staged: DataFrame | None) -> DataFrame:
    """Every event as a page view."""
    numbered = _numbered(_read(spark, folder, "events"), settings) if staged is None else staged
    apps = _pick(("tv-bigscreen-html", "tv-bigscreen-html", "web-responsive", c.MOBILE_APP), "user_id % 4")
    return numbered.selectExpr(
        "destination",
        f"{apps} AS app_type",
        "dt",
        "visit_id",
        "hid",
        "cast(event_position as int) AS page_count",
        "k % 4 AS page",
        f"{EPISODE} AS content_id",
        "event_type",
    )


def page_rows(
    spark: SparkSession, folder: str, settings: Settings = SETTINGS, staged: DataFrame | None = None
) -> DataFrame:
    """One row per page of a visit; `staged` as in `driver_inputs`."""
    return _pages(spark, folder, settings, staged).selectExpr(
        "destination",
        "app_type",
        "dt",
        "visit_id",
        "hid",
        "page_count",
        f"{_pick(JOURNEY_NAMES, 'page')} AS page_name",
        f"{_pick(JOURNEY_PAGES, 'page')} AS page",
        "content_id",
    )


def content_outcomes(
    spark: SparkSession, folder: str, settings: Settings = SETTINGS, staged: DataFrame | None = None
) -> DataFrame:
    """Whether the content of each episode page was started and completed; `staged` as in `driver_inputs`."""
    return (
        _pages(spark, folder, settings, staged)
        .filter("page = 2")
        .selectExpr(
            "dt",
            "visit_id",
            "content_id",
            "page_count",
            f"""CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '{c.START_ATTRIBUTE}'
                ELSE 'no-start-flag' END AS start_flag""",
            f"CASE WHEN event_type = 'purchase' THEN '{c.COMPLETE_ATTRIBUTE}' ELSE 'no-watched-flag' END AS watched_flag",
        )
    )
