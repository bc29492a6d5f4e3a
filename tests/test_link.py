import random

import pytest
from pyspark.sql import functions as F

from trailhead.config import COMPLETE_ATTRIBUTE, START_ATTRIBUTE
from trailhead.operators import link as ln
from trailhead.operators.clicks import lookup_join
from trailhead.operators.skew import block_of, hot_keys
from trailhead.sources.stages import materialise

from . import brute

SCHEMA = (
    "dt string, cookie_id string, hid string, visit_id string, event_position long, kind string, "
    "container string, attribute string, placement string, content_id string, series_id string, brand_id string"
)


def event(visit, position, kind, content_id, series=None, brand=None, container="box", placement="page", hid="h"):
    attribute = {"start": START_ATTRIBUTE, "complete": COMPLETE_ATTRIBUTE}.get(kind, "resume")
    return dict(
        visit=visit, position=position, kind=kind, attribute=attribute, container=container, placement=placement,
        content_id=content_id, series=series, brand=brand, hid=hid,
    )


def frame(spark, events, block_size):
    rows = [
        ("20240101", "c", e["hid"], e["visit"], e["position"], e["kind"], e["container"], e["attribute"], e["placement"],
         e["content_id"], e["series"], e["brand"])
        for e in events
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", block_of(F.col("event_position"), block_size))
    wide = df.groupBy("visit_id").agg((F.max("block") > 0).alias("wide"))
    return df.join(wide, "visit_id")


def run(spark, events, block_size=10_000, drop_backward_only=True, across_users=False):
    """All columns that matter of clicks linked to starts linked to completes."""
    df = frame(spark, events, block_size)
    has_wide = bool(df.filter("wide").head(1))
    numbered = ln.timeline_ordinals(df.filter("kind <> 'complete'"), has_wide)
    starts = ln.link_clicks_to_starts(numbered, has_wide, drop_backward_only, across_users)
    if has_wide:
        starts = materialise(starts, "starts")
    completes = df.filter("kind = 'complete'")
    both = ln.link_starts_to_completes(starts, completes, block_size, has_wide, drop_backward_only, across_users)
    return sorted(
        (
            (r.visit_id, r.click_event_position, r.click_container, r.click_id, r.content_start_event_position,
             r.content_id, r.content_watched_event_position)
            for r in both.collect()
        ),
        key=str,
    )


def expected(events):
    timeline = [e for e in events if e["kind"] != "complete"]
    brute.ordinals(timeline)
    linked = brute.link(
        [e for e in timeline if e["kind"] != "start"],
        [e for e in timeline if e["kind"] == "start"],
        brute.click_start_match, "position", "position", lambda e: -e["ordinal"], lambda e: e["ordinal"],
    )
    lefts = [
        dict(visit=c["visit"], click=c, start=s, start_position=s["position"] if s else None,
             content_id=s["content_id"] if s else None)
        for c, s in linked
    ]
    watched = brute.link(
        lefts,
        [e for e in events if e["kind"] == "complete"],
        lambda left, right: left["content_id"] is not None and left["content_id"] == right["content_id"],
        "start_position", "position", lambda left: 0, lambda e: e["position"],
    )
    return sorted(
        (
            (left["visit"], left["click"]["position"], left["click"]["container"], left["click"]["content_id"],
             left["start_position"], left["content_id"], right["position"] if right else None)
            for left, right in watched
        ),
        key=str,
    )


def pairs(rows):
    return [(r[1], r[4]) for r in rows]


def start(position, content_id, series="unknown", brand="unknown"):
    return event("v", position, "start", content_id, series, brand)


def click(position, content_id):
    return event("v", position, "standard", content_id)


CASES = {
    "episode": ([click(1, "e1"), start(2, "e1")], [(1, 2)]),
    "series": ([click(1, "s1"), start(2, "e1", "s1", "b1")], [(1, 2)]),
    "brand": ([click(1, "b1"), start(2, "e1", "s1", "b1")], [(1, 2)]),
    "unknown and adjacent": ([click(1, "unknown"), start(2, "e9")], [(1, 2)]),
    "unknown, not adjacent": ([click(1, "unknown"), click(2, "e2"), start(3, "e9")], [(1, None), (2, None)]),
    "missing id": ([click(1, None), start(2, "e1")], [(1, None)]),
    "empty id": ([click(1, ""), start(2, "e1")], [(1, None)]),
    "two starts": ([click(1, "e1"), start(2, "e1"), start(5, "e1")], [(1, 2)]),
    "two clicks": ([click(1, "e1"), click(3, "e1"), start(4, "e1")], [(1, None), (3, 4)]),
    "no second try": (
        [click(1, "e1"), click(2, "e1"), start(3, "e1"), start(6, "e1")],
        [(1, None), (2, 3)],
    ),
    "only earlier starts": ([start(1, "e1"), click(2, "e1")], []),
    "start before and after": ([start(1, "e1"), click(2, "e1"), start(3, "e1")], [(2, 3)]),
    "start claimed through another key": (
        [click(1, "b1"), click(2, "e1"), start(3, "e1", "s1", "b1")],
        [(1, None), (2, 3)],
    ),
}


@pytest.mark.parametrize("block_size", [10_000, 2])
def test_cases(spark, block_size):
    events = [dict(e, visit=name) for name, (rows, _) in CASES.items() for e in rows]
    found = run(spark, events, block_size)
    for name, (_, wanted) in CASES.items():
        assert pairs(r for r in found if r[0] == name) == wanted, name


def test_backward_only_can_be_kept(spark):
    assert pairs(run(spark, [start(1, "e1"), click(2, "e1")], drop_backward_only=False)) == [(2, None)]


def test_completes(spark):
    complete = lambda p, i: event("v", p, "complete", i)
    two = run(spark, [click(1, "e1"), start(2, "e1"), complete(5, "e1"), complete(9, "e1")])
    assert [(r[1], r[4], r[6]) for r in two] == [(1, 2, 5)]
    assert run(spark, [complete(1, "e1"), click(2, "e1"), start(3, "e1")]) == []
    other = run(spark, [click(1, "e1"), start(2, "e1"), complete(5, "e2")])
    assert [(r[4], r[6]) for r in other] == [(2, None)]


def random_events(seed, visits, longest, ids, spacing):
    rng = random.Random(seed)
    events = []
    for v in range(visits):
        position = 0
        for _ in range(rng.randint(1, longest)):
            position += rng.choice(spacing)
            kind = rng.choice(["standard", "standard", "start", "start", "complete"])
            n = rng.randrange(ids)
            if kind == "standard":
                target = rng.choice([f"e{n}", f"e{n}", f"s{n // 2}", f"b{n // 4}", "unknown", None, ""])
                events.append(event(f"v{v}", position, kind, target, container=rng.choice(["x", "y", None])))
            else:
                series = (f"s{n // 2}", f"b{n // 4}") if n % 5 else ("unknown", "unknown")
                events.append(event(f"v{v}", position, kind, f"e{n}", *series, container=rng.choice(["x", "y"])))
    # Starts and completes are distinct rows, as the reader makes them.
    seen, out = set(), []
    for e in events:
        row = tuple(sorted((k, str(x)) for k, x in e.items()))
        if e["kind"] == "standard" or row not in seen:
            seen.add(row)
            out.append(e)
    return out


@pytest.mark.parametrize("block_size", [10_000, 7, 3])
@pytest.mark.parametrize("spacing", [[1], [0, 1, 1, 4]])
def test_random_visits_against_all_pairs(spark, block_size, spacing):
    events = random_events(block_size * 31 + len(spacing), visits=60, longest=40, ids=6, spacing=spacing)
    assert run(spark, events, block_size) == expected(events)


def test_one_very_long_visit(spark):
    events = random_events(5, visits=1, longest=1, ids=5, spacing=[1])
    rng = random.Random(9)
    for position in range(2, 1500):
        kind = rng.choice(["standard", "start", "complete"])
        n = rng.randrange(12)
        target = rng.choice([f"e{n}", f"s{n // 2}", "unknown"]) if kind == "standard" else f"e{n}"
        events.append(event("v0", position, kind, target, f"s{n // 2}", f"b{n // 4}"))
    assert run(spark, events, 50) == expected(events)


def test_invariants(spark):
    events = random_events(77, visits=80, longest=30, ids=5, spacing=[1])
    rows = run(spark, events)
    starts = [(r[0], r[4]) for r in rows if r[4] is not None]
    completes = [(r[0], r[6]) for r in rows if r[6] is not None]
    assert len(rows) == len({(r[0], r[1]) for r in rows})
    assert len(starts) == len(set(starts)) and len(completes) == len(set(completes))
    assert len(completes) <= len(starts) <= len(rows)
    assert rows == run(spark, events)


def test_link_plan_has_one_exchange_per_link(spark):
    df = frame(spark, [click(1, "e1"), start(2, "e1")], 10_000)
    linked = ln.link_clicks_to_starts(ln.timeline_ordinals(df, has_wide=False), has_wide=False)
    plan = linked._jdf.queryExecution().executedPlan().toString()
    by_visit = [x for x in plan.splitlines() if "Exchange" in x and "block" in x]
    assert len(by_visit) == 1, plan


def variant_rows(spark, events, block_size):
    """Both variants in one pass, and each of them by itself."""
    df = materialise(frame(spark, events, block_size), "events")
    has_wide = bool(df.filter("wide").head(1))
    completes, rest = df.filter("kind = 'complete'"), df.filter("kind <> 'complete'")
    names = (ln.ALL_PATHS, ln.DIRECT)
    starts = ln.link_clicks_to_starts(ln.both_timelines(rest, has_wide), has_wide, apart=("variant",))
    both = ln.link_starts_to_completes(materialise(starts, "both"), completes, block_size, has_wide, variants=names)
    off_title = F.coalesce((F.col("kind") != "standard") | ~F.col("placement").ilike("%tleo%"), F.lit(False))
    apart = []
    for name, rows in zip(names, (rest.filter(off_title), rest)):
        linked = materialise(ln.link_clicks_to_starts(ln.timeline_ordinals(rows, has_wide), has_wide), "one")
        one = ln.link_starts_to_completes(linked, completes, block_size, has_wide)
        apart.append(one.withColumn("variant", F.lit(name)).select(*both.columns))
    return [sorted(map(tuple, x.collect()), key=str) for x in (both, apart[0].unionByName(apart[1]))]


@pytest.mark.parametrize("block_size", [10_000, 7, 3])
@pytest.mark.parametrize("spacing", [[1], [0, 1, 1, 4]])
def test_both_variants_in_one_pass(spark, block_size, spacing):
    events = random_events(block_size + len(spacing), visits=40, longest=40, ids=5, spacing=spacing)
    rng = random.Random(block_size)
    for e in events:
        e["placement"] = rng.choice(["iplayer.tleo.page", "page", "page", None])
    together, apart = variant_rows(spark, events, block_size)
    assert together == apart and {r[-1] for r in together} != set()
    assert len({str(r) for r in together}) > 100


def test_both_variants_take_one_exchange_per_link(spark):
    df = frame(spark, [click(1, "e1"), start(2, "e1"), event("v", 5, "complete", "e1")], 10_000)
    rest, completes = df.filter("kind <> 'complete'"), df.filter("kind = 'complete'")
    starts = ln.link_clicks_to_starts(ln.both_timelines(rest, False), False, apart=("variant",))
    both = ln.link_starts_to_completes(starts, completes, 10_000, False, variants=(ln.ALL_PATHS, ln.DIRECT))
    plan = both._jdf.queryExecution().executedPlan().toString()
    by_visit = [x for x in plan.splitlines() if "Exchange" in x and "block" in x]
    assert len(by_visit) == 2, plan


def test_lookup_join_paths_agree(spark):
    rows = [(f"e{i % 4 if i % 3 else 0}" if i % 7 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "content_id string, n int")
    lookup = spark.createDataFrame(
        [("e0", "s0"), ("e0", "s0"), ("e1", "s1"), ("e2", "s1"), (None, "s9")], "content_id string, series string"
    )
    found = {
        name: lookup_join(df, lookup, "content_id", ["n"], salts=4, **limits)
        for name, limits in {
            "broadcast": dict(max_rows=10),
            "many rows": dict(max_rows=2),
            "many bytes": dict(max_rows=10, max_bytes=5),
            "hot": dict(max_rows=2, hot_rows=100),
        }.items()
    }
    assert "Broadcast" in found["broadcast"]._jdf.queryExecution().toString()
    assert "Broadcast" not in found["many bytes"]._jdf.queryExecution().logical().toString()
    sides = [sorted(map(tuple, x.collect()), key=str) for x in found.values()]
    assert all(x == sides[0] for x in sides) and len(sides[0]) == 400


def test_only_hot_lookup_rows_are_repeated(spark):
    df = spark.range(1_000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    lookup = spark.range(1_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(df, lookup, "k", ["id"], max_rows=2, salts=8, hot_rows=100)
    assert joined.filter("v = 2 * k").count() == 1_000
    hot = hot_keys(df.select("k"), ["k"], 100)
    assert [tuple(x) for x in hot.collect()] == [(0, 600)]


def expected_across_users(events):
    """All pairs: a user's clicks against the starts and completes of every user of the visit."""
    timeline = [dict(e) for e in events if e["kind"] != "complete"]
    for e in timeline:
        e["visit"] = (e["visit"], e["hid"])
    brute.ordinals(timeline)
    for e in timeline:
        e["visit"] = e["visit"][0]
    order = ("attribute", "container", "placement", "content_id", "series", "brand")
    out = []
    for hid in {e["hid"] for e in events}:
        linked = brute.link(
            [e for e in timeline if e["kind"] != "start" and e["hid"] == hid],
            [e for e in timeline if e["kind"] == "start"],
            brute.click_start_match, "position", "position", lambda e: -e["ordinal"],
            lambda e: brute._key(*[e[x] for x in order]),
        )
        lefts = [
            dict(visit=c["visit"], click=c, start=s, start_position=s["position"] if s else None,
                 content_id=s["content_id"] if s else None)
            for c, s in linked
        ]
        watched = brute.link(
            lefts, [e for e in events if e["kind"] == "complete"],
            lambda left, right: left["content_id"] is not None and left["content_id"] == right["content_id"],
            "start_position", "position", lambda left: 0, lambda e: e["position"],
        )
        out += [
            (left["visit"], left["click"]["position"], left["click"]["container"], left["click"]["content_id"],
             left["start_position"], left["content_id"], right["position"] if right else None)
            for left, right in watched
        ]
    return sorted(out, key=str)


def test_click_and_start_of_two_users(spark):
    events = [click(1, "e1"), dict(start(2, "e1"), hid="other"), dict(event("v", 4, "complete", "e1"), hid="third")]
    assert [r[1:] for r in run(spark, events)] == [(1, "box", "e1", None, None, None)]
    assert [r[1:] for r in run(spark, events, across_users=True)] == [(1, "box", "e1", 2, "e1", 4)]


def test_adjacent_in_the_timeline_of_another_user(spark):
    # The deep link is one user's only, so the other's start has the place after the click's.
    shared = [event("v", 1, "standard", "unknown"), event("v", 2, "standard", "e7"), start(3, "e1")]
    events = [dict(e, hid=h) for h in ("a", "b") for e in shared if (h, e["position"]) != ("b", 2)]
    assert [r[4] for r in run(spark, events)] == [3, None, None]
    assert [r[4] for r in run(spark, events, across_users=True)] == [3, 3, None]


@pytest.mark.parametrize("block_size", [10_000, 7, 3])
@pytest.mark.parametrize("spacing", [[1], [0, 1, 1, 4]])
def test_random_shared_visits_against_all_pairs(spark, block_size, spacing):
    rng = random.Random(block_size)
    events = random_events(block_size * 17 + len(spacing), visits=40, longest=30, ids=5, spacing=spacing)
    users = [dict(e, hid=h) for e in events for h in ("a", "b", "c") if rng.random() < 0.7]
    found = run(spark, users, block_size, across_users=True)
    assert found == expected_across_users(users)
    assert found != run(spark, users, block_size)
