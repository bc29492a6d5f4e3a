"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from dataclasses import replace
from functools import cached_property

import pytest

import __spark_entry__ as entry
from catalog import oracle as registered_sql
from catalog import queries as registered
from catalog.compare import connect, differences
from trailhead.sources import driver_tables as dt

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"
NORMAL = dt.SETTINGS
# Limits so low that most keys count as hot, visits have many blocks and no lookup may be broadcast.
SKEWED = replace(NORMAL, block_size=3, hot_rows=4, lookup_rows=3, salts=3)


class SharedRun(registered._Run):
    """Stages made once per settings instead of once per query, to keep the tests short."""

    stages = {}

    @property
    def prepared(self):
        settings = registered.SETTINGS
        if settings not in self.stages:
            inputs = dt.driver_inputs(self.spark, self.folder, settings, stage=True)
            self.stages[settings] = registered.at.prepare(inputs, settings)
        return self.stages[settings]

    @cached_property
    def skipping(self):
        return super().skipping

    @cached_property
    def keeping(self):
        return super().keeping


@pytest.fixture(scope="module")
def oracle():
    return connect(FOLDER)


@pytest.fixture(autouse=True)
def shared(monkeypatch):
    monkeypatch.setattr(registered, "_Run", SharedRun)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(registered_sql.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_matches_sql(spark, oracle, name):
    assert differences(spark, FOLDER, oracle, entry.queries()[name], entry.oracle_sql()[name]) is None


@pytest.mark.parametrize(
    "name",
    [
        "visit_platforms",
        "clicks_by_date",
        "signed_in_population",
        "all_clicks",
        "play_starts",
        "timeline_ordinals",
        "clicks_linked_starts",
        "starts_linked_completes",
        "final_no_title",
        "funnel",
        "path_comparison",
        "via_title_difference",
        "distinct_users",
        "module_impressions",
        "shared_starts_linked_completes",
    ],
)
def test_query_matches_sql_when_everything_is_skewed(spark, oracle, monkeypatch, name):
    monkeypatch.setattr(registered, "SETTINGS", SKEWED)
    monkeypatch.setattr(registered, "SIZE", SKEWED.block_size)
    assert differences(spark, FOLDER, oracle, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "page_type", "click_container", "num_si_users", "num_clicks", "num_starts", "num_completes",
    ]
    assert df.count() > 0
