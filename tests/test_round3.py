"""Steps that were computed more than once: linking across users, the hop search, numbering of events."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalog import queries as registered
from trailhead.operators import link as ln
from trailhead.operators import sequence as sq
from trailhead.plans import attribution as at
from trailhead.sources import driver_tables as dt

from .test_link import event, frame
from .test_sequence import journeys


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shared_links(df, has_wide=False):
    numbered = ln.timeline_ordinals(df.filter("kind <> 'complete'"), has_wide, across_users=True)
    starts = ln.link_clicks_to_starts(numbered, has_wide, across_users=True)
    completes = df.filter("kind = 'complete'")
    return starts, ln.link_starts_to_completes(starts, completes, 10_000, has_wide, across_users=True)


def test_links_across_users_take_one_exchange_of_the_timeline(spark):
    df = frame(spark, [event("v", 1, "standard", "p1"), event("v", 2, "start", "p1", hid="g")], 10_000)
    numbered = df.filter("kind <> 'complete'").withColumn("block", F.lit(0).cast("long")).localCheckpoint()
    starts = ln.link_clicks_to_starts(ln.timeline_ordinals(numbered, False, across_users=True), False, across_users=True)
    assert plan(starts).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(starts)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_across_users_are_the_same_at_hand_and_spread(spark, seed):
    rng = random.Random(seed)
    kinds = ("standard", "standard", "start", "complete")
    events = [
        event(rng.choice("vw"), rng.randint(1, 30), rng.choice(kinds), rng.choice(("p1", "p2", "unknown", None)),
              series=rng.choice(("s1", None)), brand="b1", hid=rng.choice("abc"))
        for _ in range(150)
    ]
    df = frame(spark, events, 10_000).localCheckpoint()
    for hand, spread in zip(shared_links(df), shared_links(df, has_wide=True)):
        assert hand.count() > 0
        assert sorted(map(str, hand.select(sorted(hand.columns)).collect())) == sorted(
            map(str, spread.select(sorted(hand.columns)).collect())
        )


def test_hop_search_is_made_once(spark):
    pages = sq.page_rows(journeys(spark, {"v": "hrehreh"}))
    found = sq.page_hops(pages, sq.RECOMMENDATIONS_DIRECT, 3)
    assert "lead(" not in plan(found)
    assert [(r.entry_page_num, r.content_page_num) for r in found.orderBy("hop").collect()] == [(2, 3), (5, 6)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, path = random.Random(5), str(tmp_path_factory.mktemp("tables"))
    begin = datetime(2024, 1, 1)
    rows = [
        (n, begin + timedelta(minutes=rng.randint(0, 40_000)), rng.randint(0, 9),
         rng.choice(("click", "view", "purchase", "signup", "error")), f'{{"k": {rng.randint(0, 99)}}}')
        for n in range(400)
    ]
    spark.createDataFrame(rows, dt.COLUMNS["events"]).write.parquet(f"{path}/events.parquet")
    spark.range(30).selectExpr("id AS c_custkey").write.parquet(f"{path}/customer.parquet")
    parts = spark.range(10).selectExpr("id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type")
    parts.write.parquet(f"{path}/part.parquet")
    return path


@pytest.mark.parametrize("name", ["distinct_users", "reach_share", "reach_measures"])
def test_events_are_numbered_once_per_query(spark, folder, monkeypatch, name):
    calls, numbered = [], dt._numbered
    monkeypatch.setattr(dt, "_numbered", lambda *given: calls.append(1) or numbered(*given))
    registered.queries()[name](spark, folder)
    assert len(calls) == 1


def test_only_narrow_columns_are_shuffled_to_number_events(spark, folder):
    shuffled = plan(dt._numbered(dt._read(spark, folder, "events"), dt.SETTINGS)).split("Exchange")[1]
    assert "visit_id" not in shuffled and "cookie_id" not in shuffled


def test_a_crowded_visit_is_spread(spark, folder, monkeypatch):
    settings = replace(dt.SETTINGS, link_across_users=True)
    inputs = dt.driver_inputs(spark, folder, settings, stage=True, shared=True)
    few = at.prepare(inputs, settings)
    monkeypatch.setattr(ln, "MOST_USERS_AT_HAND", 1)
    many = at.prepare(inputs, settings)
    assert (few.has_wide, many.has_wide) == (False, True)
    rows = [sorted(map(str, at.build_journeys(x, settings, exclude_titles=False).collect())) for x in (few, many)]
    assert rows[0] and rows[0] == rows[1]
