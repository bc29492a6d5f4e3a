"""The registered queries: each reads the driver tables in a folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailhead import config as c
from trailhead.operators import clicks as ck
from trailhead.operators import population as pop
from trailhead.operators import sequence as sq
from trailhead.plans import attribution as at
from trailhead.plans import experiment as ex
from trailhead.plans import reach, reports, sketches
from trailhead.sources import dated
from trailhead.sources import driver_tables as dt
from trailhead.sources.stages import export_arms, materialise, stage_path, write_stage
from trailhead.sources.tables import catalogue_snapshot, scoped

Query = Callable[[SparkSession, str], DataFrame]

SETTINGS = dt.SETTINGS
SIZE = SETTINGS.block_size
CLICK = ["dt", "cookie_id", "hid", "visit_id", "event_position", "container", "attribute", "placement", "content_id"]

FAMILIES = {
    "rec_direct": sq.RECOMMENDATIONS_DIRECT,
    "rec_via": sq.RECOMMENDATIONS_VIA_TITLE,
    "watch_direct": sq.WATCHING_DIRECT,
    "watch_via": sq.WATCHING_VIA_TITLE,
}

SOURCES = ["recommendations_page", "watching_page", "title_page_cta", "end_of_playback", "homepage_modules"]
EVERYONE = "signed_in"

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


class _Run:
    """One query's view of the inputs. Stages are made when first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._prepared = self._events = None

    @property
    def raw(self):
        """Scoped inputs for a query that reads the hits only a few times."""
        return dt.driver_inputs(self.spark, self.folder, SETTINGS).scoped(SETTINGS)

    @property
    def staged(self):
        return self.inputs.scoped(SETTINGS)

    @property
    def inputs(self):
        """All inputs, from tracked events that are written once per query."""
        if self._events is None:
            self._events = dt.staged_events(self.spark, self.folder, SETTINGS)
        return dt.driver_inputs(self.spark, self.folder, SETTINGS, staged=self._events)

    @property
    def prepared(self) -> at.Prepared:
        if self._prepared is None:
            self._prepared = at.prepare(self.inputs, SETTINGS)
        return self._prepared

    @property
    def skipping(self) -> DataFrame:
        """Journeys with title pages skipped."""
        return at.build_journeys(self.prepared, SETTINGS, exclude_titles=True)

    @property
    def keeping(self) -> DataFrame:
        """Journeys with title pages kept."""
        return at.build_journeys(self.prepared, SETTINGS, exclude_titles=False)

    @property
    def both(self) -> DataFrame:
        """Journeys of both variants from one pass, with the column variant."""
        return at.build_both(self.prepared, SETTINGS)

    @property
    def written(self) -> tuple[DataFrame, DataFrame]:
        """Journeys with title pages skipped and kept, built in one pass and written once, in a folder each."""
        path = stage_path(self.spark, "journeys")
        return at.variants(write_stage(self.both, path, ("variant",)))

    @property
    def people(self) -> DataFrame:
        return pop.signed_in_population(self.prepared.population)

    @property
    def clicks(self) -> DataFrame:
        return ck.all_clicks(self.prepared.events, exclude_titles=False)

    @property
    def impressions(self) -> DataFrame:
        population = self.prepared.population
        return pop.module_impressions(self.staged.hits, population, SIZE)

    @property
    def all_pages(self) -> DataFrame:
        return dt.page_rows(self.spark, self.folder, SETTINGS, self._events)

    def hops(self, patterns, mode: str = "exact") -> DataFrame:
        return sq.page_hops(scoped(self.all_pages, SETTINGS), patterns, SIZE, mode)

    def outcomes(self, hops: DataFrame, label: str) -> DataFrame:
        return sq.hop_outcomes(hops, dt.content_outcomes(self.spark, self.folder, SETTINGS, self._events), label)

    @property
    def sources(self) -> list[DataFrame]:
        """Rows of source and hid. One hop search serves both pages, one written stage two sources."""
        page = F.when(F.col("family").startswith("rec"), "recommendations_page").otherwise("watching_page")
        skipping, keeping = self.written
        # After the journeys, so that pages come from the events numbered for them.
        found = self.hops(FAMILIES).select(page.alias("source"), "hid")
        return [
            found,
            reach.tagged("title_page_cta", reports.cta_with_clicks(keeping, self.clicks)),
            reach.tagged("end_of_playback", reports.playback_journeys(keeping)),
            reach.tagged("homepage_modules", reports.module_journeys(skipping)),
        ]


# Sources, population and events


@_query
def visit_platforms(spark, folder):
    raw = _Run(spark, folder).raw
    return pop.visit_platforms(raw.hits, raw.activity, SETTINGS.hot_rows, SETTINGS.salts)


@_query
def signed_in_population(spark, folder):
    return pop.signed_in_population(pop.population_blocks(_Run(spark, folder).raw, SETTINGS))


@_query
def population_dates(spark, folder):
    return ex.population_dates(pop.population_blocks(_Run(spark, folder).raw, SETTINGS))


@_query
def timed_frequency_groups(spark, folder):
    """Visits per group, from a table in which groups change over time."""
    inputs = dt.driver_inputs(spark, folder, SETTINGS)
    timed = replace(inputs, frequency_groups=dt.frequency_groups(inputs.weekly_frequency))
    people = pop.population_blocks(timed, SETTINGS)
    return people.groupBy("frequency_band", "frequency_group").agg(
        F.count_distinct("visit_id").alias("num_visits"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt")
    )


@_query
def module_impressions(spark, folder):
    staged = _Run(spark, folder).staged
    return pop.module_impressions(staged.hits, pop.population_blocks(staged, SETTINGS), SIZE)


@_query
def catalogue_snapshot_rows(spark, folder):
    return catalogue_snapshot(dt.driver_inputs(spark, folder, SETTINGS).catalogue)


@_query
def standard_clicks(spark, folder):
    staged = _Run(spark, folder).staged
    people = pop.population_blocks(staged, SETTINGS)
    return ck.standard_clicks(staged.hits, people, SIZE, exclude_titles=False).select(*CLICK)


@_query
def standard_clicks_no_title(spark, folder):
    staged = _Run(spark, folder).staged
    people = pop.population_blocks(staged, SETTINGS)
    return ck.standard_clicks(staged.hits, people, SIZE, exclude_titles=True).select(*CLICK)


@_query
def clicks_by_date(spark, folder):
    """Standard clicks kept by date. Half of one date's hits arrive late, and only that date is built again."""
    staged = _Run(spark, folder).staged
    people = materialise(pop.population_blocks(staged, SETTINGS), "population")
    path = stage_path(spark, "clicks-by-date")

    def build(hits: DataFrame) -> DataFrame:
        return ck.standard_clicks(hits, people, SIZE, exclude_titles=False).select(*CLICK)

    hits = staged.hits
    newest = hits.agg(F.max("dt")).head()[0]
    on_time = hits.filter((F.col("dt") != newest) | (F.col("event_position") % 2 == 0))
    dated.update_dates(on_time, path, build)
    dated.update_dates(hits, path, build)
    return dated.read_dates(spark, path, build(hits).schema)


@_query
def autoplay_clicks(spark, folder):
    staged = _Run(spark, folder).staged
    people = pop.population_blocks(staged, SETTINGS)
    return ck.autoplay_clicks(staged.hits, people, SIZE).select(*CLICK, "current_ep_id")


@_query
def web_autoplay(spark, folder):
    staged = _Run(spark, folder).staged
    people = pop.population_blocks(staged, SETTINGS)
    return ck.web_autoplay(staged.hits, people, SIZE).select(*CLICK, "current_ep_id")


@_query
def first_deeplink(spark, folder):
    staged = _Run(spark, folder).staged
    links = ck.first_deeplink(staged.url_events, pop.population_blocks(staged, SETTINGS), SIZE)
    return links.select("dt", "cookie_id", "hid", "visit_id", "event_position", "content_id")


@_query
def all_clicks(spark, folder):
    return _Run(spark, folder).clicks.select("kind", *CLICK)


@_query
def play_starts(spark, folder):
    prepared = _Run(spark, folder).prepared
    starts = ck.play_starts(prepared.events, prepared.catalogue, SETTINGS.lookup_rows, SETTINGS.salts, SETTINGS.hot_rows)
    return starts.select(*CLICK, "series_id", "brand_id")


@_query
def play_completes(spark, folder):
    return ck.play_completes(_Run(spark, folder).prepared.events).select(*CLICK)


# Linking


@_query
def timeline_ordinals(spark, folder):
    numbered = at.timeline(_Run(spark, folder).prepared, SETTINGS, exclude_titles=True)
    return numbered.select(*CLICK, "series_id", "brand_id", "ordinal")


@_query
def clicks_linked_starts(spark, folder):
    return at.linked_starts(_Run(spark, folder).prepared, SETTINGS, exclude_titles=True).drop("wide")


@_query
def starts_linked_completes(spark, folder):
    return at.linked_completes(_Run(spark, folder).prepared, SETTINGS, exclude_titles=True).drop("wide")


@_query
def final_no_title(spark, folder):
    return _Run(spark, folder).skipping.drop("exp_group")


@_query
def final_with_title(spark, folder):
    return _Run(spark, folder).keeping.drop("exp_group")


# Visits with several users, linked across them


def _shared(spark, folder):
    settings = replace(SETTINGS, link_across_users=True)
    return at.prepare(dt.driver_inputs(spark, folder, settings, stage=True, shared=True), settings), settings


@_query
def shared_clicks_linked_starts(spark, folder):
    prepared, settings = _shared(spark, folder)
    return at.linked_starts(prepared, settings, exclude_titles=True).drop("wide")


@_query
def shared_starts_linked_completes(spark, folder):
    prepared, settings = _shared(spark, folder)
    return at.linked_completes(prepared, settings, exclude_titles=True).drop("wide")


@_query
def shared_funnel(spark, folder):
    prepared, settings = _shared(spark, folder)
    return reports.funnel(at.build_journeys(prepared, settings, exclude_titles=False))


# Funnels


@_query
def funnel(spark, folder):
    return reports.funnel(_Run(spark, folder).skipping)


@_query
def homepage_funnel(spark, folder):
    return reports.homepage_funnel(_Run(spark, folder).skipping)


@_query
def homepage_funnel_direct(spark, folder):
    return reports.homepage_funnel(_Run(spark, folder).keeping)


@_query
def home_containers(spark, folder):
    return reports.home_containers(_Run(spark, folder).skipping)


@_query
def path_comparison(spark, folder):
    return reports.compare_variants(_Run(spark, folder).both)


@_query
def via_title_difference(spark, folder):
    return reports.variant_difference(_Run(spark, folder).both)


@_query
def end_of_playback(spark, folder):
    return reports.end_of_playback(_Run(spark, folder).keeping)


@_query
def cta_funnel(spark, folder):
    run = _Run(spark, folder)
    return reports.cta_funnel(run.keeping, run.clicks)


@_query
def cta_funnel_compat(spark, folder):
    run = _Run(spark, folder)
    return reports.cta_funnel(run.keeping, run.clicks, compat=True)


@_query
def distinct_users(spark, folder):
    run = _Run(spark, folder)
    skipping, keeping = run.written
    return reports.distinct_users(
        {
            "title_pages_skipped": skipping,
            "title_pages_kept": keeping,
            "population": run.people,
            "module_impressions": run.impressions,
        }
    )


@_query
def sketched_module_users(spark, folder):
    """Users per container from daily sketches, which are stored and merged."""
    daily = materialise(sketches.daily_sketches(_Run(spark, folder).keeping, ["click_container"]), "sketches")
    return sketches.merged_users(daily, ["click_container"], SETTINGS.window)


@_query
def distinct_visits(spark, folder):
    skipping, keeping = _Run(spark, folder).written
    return reports.distinct_visits({"title_pages_skipped": skipping, "title_pages_kept": keeping})


@_query
def stage_counts(spark, folder):
    run = _Run(spark, folder)
    events = run.prepared.events
    return reports.stage_counts(
        {
            "population": run.people,
            "clicks": ck.all_clicks(events, exclude_titles=True),
            "starts": events.filter(F.col("kind") == "start"),
            "completes": ck.play_completes(events),
            "journeys": run.skipping,
        }
    )


# Experiment


@_query
def visits_by_frequency(spark, folder):
    return ex.visits_by_frequency(_Run(spark, folder).skipping)


@_query
def arm_platform_users(spark, folder):
    return ex.arm_platform_users(_Run(spark, folder).skipping)


@_query
def arm_users(spark, folder):
    return ex.arm_users(_Run(spark, folder).skipping)


@_query
def arm_population_stats(spark, folder):
    people = pop.population_blocks(_Run(spark, folder).raw, SETTINGS)
    return ex.population_stats(people, ["platform", "exp_group"])


@_query
def arm_module_report(spark, folder):
    run = _Run(spark, folder)
    return ex.arm_module_report(run.people, run.skipping)


@_query
def arm_age_report(spark, folder):
    run = _Run(spark, folder)
    return ex.arm_age_report(run.people, run.skipping)


@_query
def arm_product_report(spark, folder):
    run = _Run(spark, folder)
    return ex.arm_product_report(run.people, run.skipping)


@_query
def impression_visits(spark, folder):
    run = _Run(spark, folder)
    return ex.impression_visits(run.impressions, run.skipping)


@_query
def arm_population_overview(spark, folder):
    return ex.arm_population_overview(pop.population_blocks(_Run(spark, folder).raw, SETTINGS))


@_query
def arm_module_overview(spark, folder):
    return ex.arm_module_overview(_Run(spark, folder).skipping)


@_query
def user_results(spark, folder):
    run = _Run(spark, folder)
    return ex.user_results(run.people, run.skipping)


@_query
def engagement_groups(spark, folder):
    run = _Run(spark, folder)
    return ex.engagement_groups(run.people, run.skipping)


@_query
def arm_exports(spark, folder):
    """User results of two arms, written to a folder per arm and read back."""
    run = _Run(spark, folder)
    results = ex.user_results(run.people, run.skipping)
    return export_arms(results, stage_path(spark, "arms"), ("control", "variation_1"))


# Page sequences


@_query
def occurrence_histogram(spark, folder):
    pages = _Run(spark, folder).all_pages
    return sq.run_histogram(pages, "page_name", (c.RECOMMENDATIONS_PAGE,), SIZE, containing="recommendations.page")


@_query
def occurrence_histogram_pairs(spark, folder):
    return sq.run_histogram(_Run(spark, folder).all_pages, "page", (c.WATCHING_PAGE, c.EPISODE_PAGE), SIZE)


@_query
def short_visits(spark, folder):
    return sq.short_visits(_Run(spark, folder).all_pages, "recommendations.page")


@_query
def sample_short_visits(spark, folder):
    """The first ten of them: a sample to look at."""
    return sq.short_visits(_Run(spark, folder).all_pages, "recommendations.page", limit=10)


@_query
def journeys_from_title_pages(spark, folder):
    names = (c.WATCHING_PAGE, c.TITLE_PAGE, c.EPISODE_PAGE)
    return sq.pages_from(_Run(spark, folder).all_pages, "page", names, SIZE)


@_query
def hops_direct(spark, folder):
    return _Run(spark, folder).hops(sq.RECOMMENDATIONS_DIRECT)


@_query
def hops_via_title(spark, folder):
    return _Run(spark, folder).hops(sq.RECOMMENDATIONS_VIA_TITLE)


@_query
def hops_watching_direct(spark, folder):
    return _Run(spark, folder).hops(sq.WATCHING_DIRECT)


@_query
def hops_watching_via_title(spark, folder):
    return _Run(spark, folder).hops(sq.WATCHING_VIA_TITLE)


@_query
def hops_direct_compat(spark, folder):
    return _Run(spark, folder).hops(sq.RECOMMENDATIONS_DIRECT, "compat")


@_query
def hops_via_title_compat(spark, folder):
    return _Run(spark, folder).hops(sq.RECOMMENDATIONS_VIA_TITLE, "compat")


@_query
def hops_watching_direct_compat(spark, folder):
    return _Run(spark, folder).hops(sq.WATCHING_DIRECT, "compat")


@_query
def hops_watching_via_title_compat(spark, folder):
    return _Run(spark, folder).hops(sq.WATCHING_VIA_TITLE, "compat")


@_query
def hop_counts(spark, folder):
    """Visits per round of the search, for all four patterns."""
    hops = _Run(spark, folder).hops(FAMILIES)
    return hops.groupBy("family", "hop").agg(F.count("visit_id").alias("num_visits"))


@_query
def hop_outcomes(spark, folder):
    run = _Run(spark, folder)
    return run.outcomes(run.hops(sq.RECOMMENDATIONS_DIRECT), "rec_page")


@_query
def hop_outcomes_watching(spark, folder):
    run = _Run(spark, folder)
    return run.outcomes(run.hops(sq.WATCHING_DIRECT), c.WATCHING_PAGE)


def _hop_funnel(name: str, label: str, *families: str) -> None:
    patterns = {x: FAMILIES[x] for x in families}

    def of_mode(mode):
        def query(spark, folder):
            run = _Run(spark, folder)
            return reports.hop_funnel(run.outcomes(run.hops(patterns, mode), label))

        return query

    _REGISTRY[name] = of_mode("exact")
    _REGISTRY[f"{name}_compat"] = of_mode("compat")


_hop_funnel("hop_funnel", "rec_page", "rec_direct")
_hop_funnel("hop_funnel_via_title", "rec_page", "rec_via")
_hop_funnel("hop_funnel_all", "rec_page", "rec_via", "rec_direct")
_hop_funnel("hop_funnel_watching", c.WATCHING_PAGE, "watch_direct")
_hop_funnel("hop_funnel_watching_via_title", c.WATCHING_PAGE, "watch_via")
_hop_funnel("hop_funnel_watching_all", c.WATCHING_PAGE, "watch_via", "watch_direct")


# Reach


@_query
def cta_users(spark, folder):
    run = _Run(spark, folder)
    return reports.cta_users(run.keeping, run.clicks)


@_query
def playback_users(spark, folder):
    return reports.playback_users(_Run(spark, folder).keeping)


@_query
def homepage_module_users(spark, folder):
    return reports.homepage_module_users(_Run(spark, folder).skipping)


@_query
def reach_union(spark, folder):
    return reach.reach_union(reach.user_masks(_Run(spark, folder).sources, SOURCES), SOURCES)


@_query
def dist_users(spark, folder):
    """The user list of all sources."""
    return reach.dist_users(reach.user_masks(_Run(spark, folder).sources, SOURCES))


@_query
def reach_overlap(spark, folder):
    """Users per combination of sources."""
    return reach.reach_overlap(reach.user_masks(_Run(spark, folder).sources, SOURCES), SOURCES)


@_query
def reach_share(spark, folder):
    run = _Run(spark, folder)
    names = [*SOURCES, EVERYONE]
    masks = reach.user_masks([*run.sources, reach.tagged(EVERYONE, run.people)], names)
    return reach.reach_share(masks, names, EVERYONE)


@_query
def reach_measures(spark, folder):
    """Users of each entry point, home page modules apart, who clicked, started and completed."""
    run = _Run(spark, folder)
    skipping, keeping = run.written
    flags = ["hid", "start_flag", "watched_flag"]
    hops = run.outcomes(run.hops({x: p for x, p in FAMILIES.items() if x.startswith("rec")}), "rec_page").select(
        F.lit("recommendations_page").alias("source"), *flags
    )
    watching = run.outcomes(run.hops({x: p for x, p in FAMILIES.items() if x.startswith("watch")}), c.WATCHING_PAGE)
    modules = reports.module_journeys(skipping).select(F.concat(F.lit("homepage:"), "click_container").alias("source"), *flags)
    playback = reports.playback_journeys(keeping).select(F.lit("end_of_playback").alias("source"), *flags)
    cta = reports.cta_with_clicks(keeping, run.clicks).select(F.lit("title_page_cta").alias("source"), *flags)
    rows = hops.unionByName(watching.select(F.lit("watching_page").alias("source"), *flags))
    return reach.reach_measures(rows.unionByName(modules).unionByName(playback).unionByName(cta))


def queries() -> dict[str, Query]:
    out = dict(_REGISTRY)
    out["catalogue_snapshot"] = out.pop("catalogue_snapshot_rows")
    return out
