"""The events of the population's visits: four kinds of click to content, starts and completes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as c
from ..functions import classify as fn
from .population import RAW_VISIT, restrict
from .skew import block_of, lookup_join

CLICK_KINDS = ("standard", "autoplay", "web_autoplay", "deeplink")
PLACE = ["dt", "cookie_id", "hid", "visit_id", "block", "wide"]
EVENT = [*PLACE, "event_position", "container", "attribute", "placement", "content_id"]


def _conditions() -> dict[str, Column]:
    attribute, click, impression = F.col("attribute"), F.col("is_click"), F.col("is_impression")
    return {
        "standard": fn.is_standard_click(attribute, click),
        "autoplay": fn.is_autoplay_click(attribute, click),
        "web_autoplay": fn.is_web_autoplay(attribute, click, impression),
        "start": fn.is_start(attribute, impression),
        "complete": fn.is_complete(attribute, impression),
    }


def hit_events(hits: DataFrame, population: DataFrame, block_size: int, kinds: tuple[str, ...]) -> DataFrame:
    """Hits of the wanted kinds in the population's visits, one distinct row per event and kind.

    The hits are read once for all kinds. A hit that is of two kinds gives two rows. Copies of a hit are
    removed before the join, so any number of them costs one row per map task.
    """
    wanted = {kind: cond for kind, cond in _conditions().items() if kind in kinds}
    kind_list = F.array_compact(F.array(*[F.when(cond, F.lit(kind)) for kind, cond in wanted.items()]))
    container = F.when(
        F.col("kind").isin(*CLICK_KINDS), fn.normalise_container(F.col("container"))
    ).otherwise(F.col("container"))
    relevant = hits.filter(fn.any_of(wanted.values())).withColumn("kind", F.explode(kind_list))
    distinct = relevant.select(
        "destination",
        "kind",
        *RAW_VISIT,
        "event_position",
        container.alias("container"),
        "attribute",
        "placement",
        F.col("result").alias("content_id"),
    ).distinct()
    return restrict(distinct, population, block_size).select("kind", *EVENT)


def standard_clicks(hits: DataFrame, population: DataFrame, block_size: int, exclude_titles: bool) -> DataFrame:
    if exclude_titles:
        hits = hits.filter(fn.is_off_title_page(F.col("placement")))
    return hit_events(hits, population, block_size, ("standard",))


def autoplay_clicks(hits: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    clicks = hit_events(hits, population, block_size, ("autoplay",))
    return clicks.withColumn("current_ep_id", fn.episode_from_placement(F.col("placement")))


def web_autoplay(hits: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    clicks = hit_events(hits, population, block_size, ("web_autoplay",))
    return clicks.withColumn("current_ep_id", fn.episode_from_placement(F.col("placement")))


def first_deeplink(url_events: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    """The earliest deep link of each visit (ties: smallest user id, then URL).

    Both steps are minima that combine before the shuffle, so a visit with very many links costs one row.
    """
    earliest = (
        url_events.filter(F.col("url").contains("deeplink"))
        .groupBy("destination", *RAW_VISIT)
        .agg(F.min(F.struct("event_position", "url")).alias("link"))
    )
    users = population.select("destination", *RAW_VISIT, "wide", "hid").distinct()
    first = (
        earliest.join(users, ["destination", *RAW_VISIT])
        .groupBy("destination", *RAW_VISIT)
        .agg(F.min(F.struct("link.event_position", "hid", "link.url", "wide")).alias("link"))
    )
    return first.select(*RAW_VISIT, "link.*").select(
        F.lit("deeplink").alias("kind"),
        "dt",
        "cookie_id",
        "hid",
        "visit_id",
        block_of(F.col("event_position"), block_size).alias("block"),
        "wide",
        "event_position",
        *[F.lit(c.DEEPLINK).alias(x) for x in ("container", "attribute", "placement")],
        fn.content_from_url(F.col("url")).alias("content_id"),
        "url",
    )


def visit_events(hits: DataFrame, url_events: DataFrame, population: DataFrame, block_size: int) -> DataFrame:
    """Everything linking needs: clicks of all four kinds, starts and completes."""
    tracked = hit_events(hits, population, block_size, tuple(_conditions()))
    return tracked.unionByName(first_deeplink(url_events, population, block_size).drop("url"))


def all_clicks(events: DataFrame, exclude_titles: bool) -> DataFrame:
    """Clicks of all kinds, kept apart (no dedupe between kinds).

    Title pages are a middle step between an entry page and content: with `exclude_titles`, standard
    clicks on them are left out, so that the entry page gets the credit.
    """
    clicks = events.filter(F.col("kind").isin(*CLICK_KINDS))
    if exclude_titles:
        clicks = clicks.filter((F.col("kind") != "standard") | fn.is_off_title_page(F.col("placement")))
    return clicks


def series_lookup(catalogue: DataFrame) -> DataFrame:
    """Series and brand of each episode."""
    return catalogue.filter(F.col("episode_id").isNotNull()).select(
        F.col("episode_id").alias("content_id"),
        F.coalesce("series_id", F.lit(c.UNKNOWN)).alias("series_id"),
        F.coalesce("brand_id", F.lit(c.UNKNOWN)).alias("brand_id"),
    )


def play_starts(
    events: DataFrame, catalogue: DataFrame, lookup_rows: int, salts: int, hot_rows: int = 1_000_000
) -> DataFrame:
    """Start events with the series and brand of what was started, 'unknown' if not in the catalogue."""
    starts = events.filter(F.col("kind") == "start")
    known = lookup_join(
        starts, series_lookup(catalogue), "content_id", [*RAW_VISIT, "event_position"], lookup_rows, salts, hot_rows
    )
    return known.fillna(c.UNKNOWN, subset=["series_id", "brand_id"])


def play_completes(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind") == "complete")


def clicks_and_starts(clicks: DataFrame, starts: DataFrame) -> DataFrame:
    """One timeline per visit; clicks have no series or brand."""
    return starts.unionByName(clicks, allowMissingColumns=True)
