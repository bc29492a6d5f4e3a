"""From raw tables to one row per click, with the start and complete it led to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import clicks as ck
from ..operators import link as ln
from ..operators.population import population_blocks
from ..sources.stages import materialise
from ..sources.tables import Inputs


@dataclass(frozen=True)
class Prepared:
    """The two stages both journey variants share, and whether any visit has more than one block (or, if links
    cross users, too many users for one task)."""

    population: DataFrame
    events: DataFrame
    catalogue: DataFrame
    has_wide: bool


def prepare(inputs: Inputs, settings: Settings) -> Prepared:
    """Read the hits twice in all: once for the population, once for its events.

    Both results are written once, since each is read several times by what follows.
    """
    population = materialise(population_blocks(inputs, settings), "population")
    scoped = inputs.scoped(settings)
    events = materialise(
        ck.visit_events(scoped.hits, scoped.url_events, population, settings.block_size), "events"
    )
    has_wide = bool(population.filter("wide").head(1))
    if settings.link_across_users and not has_wide:
        crowds = population.groupBy(*ln.SHARED_VISIT).agg(F.count(F.lit(1)).alias("users"))
        has_wide = bool(crowds.filter(F.col("users") > ln.MOST_USERS_AT_HAND).head(1))
    return Prepared(population, events, inputs.catalogue, has_wide)


def timeline(prepared: Prepared, settings: Settings, exclude_titles: bool) -> DataFrame:
    """Numbered clicks and starts. With wide visits, later steps read each stage several times: it is written."""
    starts = ck.play_starts(prepared.events, prepared.catalogue, settings.lookup_rows, settings.salts, settings.hot_rows)
    both = ck.clicks_and_starts(ck.all_clicks(prepared.events, exclude_titles), starts)
    numbered = ln.timeline_ordinals(both, prepared.has_wide, settings.link_across_users)
    return materialise(numbered, "timeline") if prepared.has_wide else numbered


def linked_starts(prepared: Prepared, settings: Settings, exclude_titles: bool) -> DataFrame:
    linked = ln.link_clicks_to_starts(
        timeline(prepared, settings, exclude_titles),
        prepared.has_wide,
        settings.drop_backward_only,
        settings.link_across_users,
    )
    return materialise(linked, "starts") if prepared.has_wide else linked


def linked_completes(prepared: Prepared, settings: Settings, exclude_titles: bool) -> DataFrame:
    linked = ln.link_starts_to_completes(
        linked_starts(prepared, settings, exclude_titles),
        ck.play_completes(prepared.events),
        settings.block_size,
        prepared.has_wide,
        settings.drop_backward_only,
        settings.link_across_users,
    )
    return materialise(linked, "completes") if prepared.has_wide else linked


def build_journeys(prepared: Prepared, settings: Settings, exclude_titles: bool) -> DataFrame:
    """One row per click. With `exclude_titles` a click on a title page is skipped over, so the entry
    page before it gets the credit; without, the title page does."""
    return ln.enrich(
        linked_completes(prepared, settings, exclude_titles),
        prepared.population,
        settings.block_size,
        prepared.has_wide,
    )


def build_both(prepared: Prepared, settings: Settings) -> DataFrame:
    """The journeys of both variants in one pass, told apart by the column `variant`.

    Events are shuffled once per link for both: clicks and starts are doubled behind the exchange that
    numbers them, completes behind the one that brings them to the starts.
    """
    if settings.link_across_users:
        pair = {ln.ALL_PATHS: True, ln.DIRECT: False}
        found = [
            build_journeys(prepared, settings, skip).withColumn("variant", F.lit(name)) for name, skip in pair.items()
        ]
        return found[0].unionByName(found[1])

    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name) if prepared.has_wide else df

    starts = ck.play_starts(prepared.events, prepared.catalogue, settings.lookup_rows, settings.salts, settings.hot_rows)
    clicks = ck.all_clicks(prepared.events, exclude_titles=False)
    timelines = kept(ln.both_timelines(ck.clicks_and_starts(clicks, starts), prepared.has_wide), "timeline")
    linked = kept(
        ln.link_clicks_to_starts(
            timelines, prepared.has_wide, settings.drop_backward_only, apart=("variant",)
        ),
        "starts",
    )
    watched = kept(
        ln.link_starts_to_completes(
            linked,
            ck.play_completes(prepared.events),
            settings.block_size,
            prepared.has_wide,
            settings.drop_backward_only,
            variants=(ln.ALL_PATHS, ln.DIRECT),
        ),
        "completes",
    )
    return ln.enrich(watched, prepared.population, settings.block_size, prepared.has_wide)


def variants(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The journeys of `build_both` with title pages skipped, and those with title pages kept."""
    skipping, keeping = [both.filter(F.col("variant") == x).drop("variant") for x in (ln.ALL_PATHS, ln.DIRECT)]
    return skipping, keeping
