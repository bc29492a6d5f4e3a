from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from trailhead import config as c
from trailhead.config import DateWindow, Settings
from trailhead.functions import classify as fn
from trailhead.operators import clicks as ck
from trailhead.operators import link as ln
from trailhead.operators import population as pop
from trailhead.operators import skew
from trailhead.plans import experiment as ex
from trailhead.plans import reach, reports
from trailhead.schemas import INPUTS, assert_schema
from trailhead.sources import stages
from trailhead.sources.tables import Inputs, in_window, read_table, scoped

SETTINGS = Settings(window=DateWindow("20240101", "20240107"))


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_classifiers(spark):
    assert evaluate(spark, [10, 11, 15, 16, 24, 25, 34, 35, None], fn.age_band, "int") == [
        "under 10", "11-15", "11-15", "16-24", "16-24", "25-34", "25-34", "35+", "unknown",
    ]
    assert evaluate(spark, ["x-BigScreen-HTML", "a responsive b", "app", None], fn.platform_of) == [
        "bigscreen", "web", "unknown", "unknown",
    ]
    assert evaluate(spark, ["A. Daily", "C. Weekly", "Z", None], fn.frequency_group) == [
        "heavy", "medium", "other", "new",
    ]
    assert evaluate(spark, ["C. Weekly", None], fn.frequency_band) == ["C. Weekly", "new"]
    assert evaluate(spark, ["MODULE-IF-YOU-LIKED-b1", "x", None], fn.normalise_container) == [c.LIKED_MODULE, "x", None]
    assert evaluate(spark, ["site.tv.b0123456.page", "site.tv.page", None], fn.episode_from_placement) == [
        "b0123456", "none", "none",
    ]
    assert evaluate(spark, ["module-REC-x", "onward", None], fn.playback_group) == ["rec", "next-episode", "next-episode"]
    assert evaluate(spark, ["20240107", "20240101"], lambda x: fn.week_of(x).cast("string")) == ["2024-01-01"] * 2
    assert evaluate(spark, ["a.TLEO.page", "x.episode.y", c.HOME_PLACEMENT, "q", None], fn.page_type) == [
        "tleo_page", "episode_page", "homepage", "other", "other",
    ]


def test_content_from_url(spark):
    urls = [
        "https://h/b0abcdef/playback/p1zzzzzz?deeplink",
        "https://h/playback/live?deeplink",
        "https://h/title/p1zzzzzz?deeplink",
        "https://h/p1aaaaaa/PLAYBACK",
        None,
    ]
    assert evaluate(spark, urls, fn.content_from_url) == ["p1zzzzzz", "", "unknown", "p1aaaaaa", "unknown"]


@pytest.mark.parametrize(
    "attribute, click, impression, kinds",
    [
        ("content-item~x", 1, 0, {"standard"}),
        ("start-watching", 1, 0, {"standard"}),
        ("resume", 1, 0, {"standard"}),
        ("resume", 0, 1, set()),
        ("resumed", 1, 0, set()),
        ("content-item~select-play", 1, 0, {"standard", "autoplay"}),
        ("x~squeeze-auto-play", 1, 0, {"autoplay"}),
        ("onward-journey-panel~complete", 0, 1, {"web_autoplay"}),
        ("onward-journey-panel~complete", 1, 0, set()),
        ("onward-journey-panel~select", 1, 0, {"web_autoplay"}),
        (c.START_ATTRIBUTE, 0, 1, {"start"}),
        (c.COMPLETE_ATTRIBUTE, 0, 1, {"complete"}),
        (None, 1, 1, set()),
    ],
)
def test_event_kinds(spark, attribute, click, impression, kinds):
    df = spark.createDataFrame(
        [(attribute, click, impression)], "attribute string, is_click int, is_impression int"
    )
    found = df.select(*[F.coalesce(cond, F.lit(False)).alias(k) for k, cond in ck._conditions().items()]).first()
    assert {k for k, v in found.asDict().items() if v} == kinds


HIT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INPUTS["hits"].fields)


def hit(visit, position, attribute, placement="home", result="p0000001", click=1, cookie="c", dt="20240102"):
    return (c.PRODUCT, dt, cookie, visit, position, "box", attribute, placement, result, click, 1 - click)


def make_inputs(spark, hits, activity=None, visits=None, urls=(), profile=None, frequency=None):
    names = {x: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INPUTS[x].fields) for x in INPUTS}
    import datetime

    monday = datetime.date(2024, 1, 1)
    create = lambda rows, table: spark.createDataFrame(rows, names[table])
    seen = sorted({(h[1], h[2], h[3]) for h in hits})
    return Inputs(
        hits=create(hits, "hits"),
        activity=create(activity or [(c.PRODUCT, d, v, "bigscreen-html") for d, _, v in seen], "activity"),
        visits=create(visits or [(c.PRODUCT, d, k, v, "u1") for d, k, v in seen], "visits"),
        url_events=create(list(urls), "url_events"),
        profile=create(profile or [("u1", 30), ("u2", 9)], "profile"),
        weekly_frequency=create(frequency or [("u1", "A. Daily", monday), ("u2", None, monday)], "weekly_frequency"),
        catalogue=create([("m", "m", "b", "b1", "s", "s1", "p0000001", "e", "g")], "catalogue"),
    )


def test_population_rules(spark):
    hits = [hit("v1", 1, "x"), hit("v2", 1, "x"), hit("v3", 1, "x"), hit("v4", 1, "x"), hit("v5", 1, "x")]
    inputs = make_inputs(
        spark,
        hits + [(h := hit("v6", 1, "x"))[:1] + ("20240201",) + h[2:]],
        activity=[
            (c.PRODUCT, "20240102", "v1", "x bigscreen-html"),
            (c.PRODUCT, "20240102", "v2", "mobile-app"),
            (c.PRODUCT, "20240102", "v3", "Responsive"),
            (c.PRODUCT, "20240102", "v4", "responsive"),
            (c.PRODUCT, "20240102", "v5", None),
        ],
        visits=[
            (c.PRODUCT, "20240102", "c", "v1", "u1"),
            (c.PRODUCT, "20240102", "c", "v2", "u1"),
            (c.PRODUCT, "20240102", "c", "v3", None),
            (c.PRODUCT, "20240102", "c", "v4", "u2"),
            (c.PRODUCT, "20240102", "c", "v5", "u1"),
        ],
    )
    people = pop.signed_in_population(pop.population_blocks(inputs, SETTINGS))
    rows = {r.visit_id: (r.platform, r.hid, r.frequency_band, r.frequency_group, r.age_range) for r in people.collect()}
    assert rows == {
        "v1": ("bigscreen", "u1", "A. Daily", "heavy", "25-34"),
        "v4": ("web", "u2", "new", "new", "under 10"),
    }


def test_keep_unsegmented(spark):
    import datetime

    inputs = make_inputs(
        spark, [hit("v1", 1, "x")], frequency=[("u2", "A. Daily", datetime.date(2024, 1, 1))]
    )
    assert pop.population_blocks(inputs, SETTINGS).count() == 0
    kept = pop.population_blocks(inputs, replace(SETTINGS, keep_unsegmented=True)).collect()
    assert [(r.hid, r.frequency_band, r.frequency_group) for r in kept] == [("u1", "new", "new")]
    grouped = replace(SETTINGS, frequency_groups=(("A. Daily", "often"),))
    people = pop.population_blocks(make_inputs(spark, [hit("v1", 1, "x")]), grouped)
    assert [r.frequency_group for r in people.collect()] == ["often"]


def test_title_pages_and_null_placements(spark):
    hits = [
        hit("v1", 1, "resume", "home"),
        hit("v1", 2, "resume", "x.TLEO.page"),
        hit("v1", 3, "resume", None),
        hit("v1", 4, "end-play", "x.tleo.page"),
    ]
    inputs = make_inputs(spark, hits)
    people = pop.population_blocks(inputs, SETTINGS)
    kept = ck.standard_clicks(inputs.hits, people, 10_000, exclude_titles=False)
    skipped = ck.standard_clicks(inputs.hits, people, 10_000, exclude_titles=True)
    assert sorted(r.event_position for r in kept.collect()) == [1, 2, 3]
    assert [r.event_position for r in skipped.collect()] == [1]
    events = ck.visit_events(inputs.hits, inputs.url_events, people, 10_000)
    assert sorted(r.event_position for r in ck.all_clicks(events, True).collect()) == [1, 4]
    assert ck.all_clicks(events, True).exceptAll(ck.all_clicks(events, False)).count() == 0


def test_first_deeplink_of_a_visit(spark):
    url = lambda p, u: (c.PRODUCT, "20240102", "c", "v1", p, u)
    inputs = make_inputs(
        spark,
        [hit("v1", 1, "x")],
        urls=[
            url(5, "h/playback/p0000001?deeplink"),
            url(3, "h/b0123456/playback/p0000002?deeplink"),
            url(1, "h/no"),
        ],
    )
    people = pop.population_blocks(inputs, SETTINGS)
    rows = ck.first_deeplink(inputs.url_events, people, 10_000).collect()
    assert [(r.event_position, r.content_id, r.container) for r in rows] == [(3, "p0000002", "deeplink")]


def test_enrich_fans_out_unless_deduped(spark):
    linked = spark.createDataFrame(
        [("20240102", "c", "u1", "v1", False, 1, "box", "home", None, None, None, "no", "no", None)],
        "dt string, cookie_id string, hid string, visit_id string, wide boolean, click_event_position long, "
        "click_container string, click_placement string, content_placement string, content_id string, "
        "content_start_event_position long, content_attribute string, watched_flag string, "
        "content_watched_event_position long",
    )
    people = spark.createDataFrame(
        [
            (c.PRODUCT, "20240102", k, "v1", 0, False, p, "u1", "b", "g", "35+")
            for k, p in (("c", "web"), ("d", "bigscreen"))
        ],
        "destination string, dt string, cookie_id string, visit_id string, block long, wide boolean, "
        "platform string, hid string, frequency_band string, frequency_group string, age_range string",
    )
    for has_wide in (False, True):
        assert ln.enrich(linked, people, 10, has_wide).count() == 2
    assert ln.enrich(linked, pop.dedupe_population(people), 10, False).count() == 1


def test_spread_join_equals_join(spark):
    left = spark.range(500).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("n"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (5, "d")], "k long, v string")
    hot = skew.hot_keys(left, ["k"], 50)
    assert {r.k for r in hot.collect()} == {0}
    spread = skew.spread_join(left, right, ["k"], hot, ["k"], ["n"], 8)
    assert sorted(map(tuple, spread.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert skew.hot_keys(left, ["k"], 10_000) is None


def test_number_rows_in_blocks(spark):
    df = spark.range(300).select(
        (F.col("id") % 3).alias("k"),
        F.col("id").alias("n"),
        F.when(F.col("id") % 3 == 0, F.call_function("div", "id", F.lit(20))).otherwise(0).alias("block"),
        (F.col("id") % 3 == 0).alias("wide"),
    )
    numbered = skew.number_rows(df, ["k"], "block", "wide", [F.col("n")], "rn").collect()
    assert all(r.rn == r.n // 3 + 1 for r in numbered) and len(numbered) == 300


def test_schema_check_and_readers(spark, tmp_path):
    visits = spark.createDataFrame([("p", "20240101", "c", "v", "u", 1)], "destination string, dt string, "
                                   "cookie_id string, visit_id string, audience_id string, extra int")
    assert assert_schema(visits, "visits").columns == INPUTS["visits"].fieldNames()
    with pytest.raises(ValueError, match="event_position"):
        assert_schema(visits, "hits")
    stages.write_stage(visits, f"{tmp_path}/visits", ("dt",))
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").schema(
        visits.schema
    ).parquet(f"{tmp_path}/visits")
    assert assert_schema(back, "visits").count() == 1
    plain = f"{tmp_path}/plain"
    visits.write.parquet(plain)
    assert read_table(spark, "visits", plain).count() == 1
    assert in_window(visits, DateWindow("20240102", "20240103")).count() == 0
    assert scoped(visits, SETTINGS).count() == 0


def test_date_window_prunes_partitions(spark, tmp_path):
    path = f"{tmp_path}/dated"
    spark.createDataFrame([("20240101", 1), ("20240301", 2)], "dt string, n int").write.partitionBy("dt").parquet(path)
    df = spark.read.schema("n int, dt string").parquet(path)
    plan = in_window(df, SETTINGS.window)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def final(spark, rows):
    """(hid, visit, container, placement, start, complete) rows in the shape reports read."""
    schema = (
        "dt string, hid string, visit_id string, click_container string, click_placement string, start_flag int, "
        "watched_flag int, platform string, age_range string, exp_group string, frequency_band string"
    )
    return spark.createDataFrame([("20240101", *r, "web", "35+", "control", "A") for r in rows], schema)


def test_compare_paths_takes_the_larger(spark):
    a = final(spark, [("u1", "v1", c.LIKED_MODULE, c.HOME_PLACEMENT, 1, 1), ("u2", "v2", c.LIKED_MODULE, c.HOME_PLACEMENT, 1, 0)])
    b = final(spark, [("u1", "v1", c.LIKED_MODULE, c.HOME_PLACEMENT, 1, 0)])
    row = reports.compare_paths(a, b).first()
    assert (row.num_si_users, row.num_clicks, row.both_paths_starts, row.direct_starts) == (2, 2, 2, 1)
    assert reports.via_title_difference(a, b).first().via_title_num_starts == 1


def test_cta_counts_raw_clicks_only_in_compat(spark):
    journeys = final(spark, [("u1", "v1", "main-CTA", "x.tleo.page", 1, 0), ("u2", "v2", "main-CTA", "x.tleo.page", 1, 0)])
    clicks = spark.createDataFrame(
        [("20240101", "u1", "v1", "main-CTA", "x.tleo.page")] * 3,
        "dt string, hid string, visit_id string, container string, placement string",
    )
    assert tuple(reports.cta_funnel(journeys, clicks).first()) == ("main-CTA", 1, 1, 1, 0)
    assert tuple(reports.cta_funnel(journeys, clicks, compat=True).first()) == ("main-CTA", 1, 3, 3, 0)
    assert [r.hid for r in reports.cta_users(journeys, clicks).collect()] == ["u1"]


def test_page_type_mapping_table(spark):
    journeys = final(spark, [("u1", "v1", "m", "p1", 1, 0), ("u2", "v2", "m", "p2", 0, 0)])
    mapping = spark.createDataFrame([("p1", "special")], "placement string, page_type string")
    found = {r.page_type: r.num_clicks for r in reports.funnel(journeys, mapping).collect()}
    assert found == {"special": 1, "other": 1}


def test_reach(spark):
    rows = [("a", "1"), ("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("b", None)]
    users, names = spark.createDataFrame(rows, "source string, hid string"), ["a", "b", "c", "all users"]
    people = spark.createDataFrame([(str(n),) for n in range(2, 7)] + [(None,)], "hid string")
    masks = reach.user_masks([users, reach.tagged("all users", people)], names)
    share = {r.source: (r.num_users, float(r.pct_of_signed_in)) for r in reach.reach_share(masks, names, "all users").collect()}
    assert share == {"a": (2, 40.0), "b": (2, 40.0), "all": (3, 60.0)}
    masks = reach.user_masks([users], names[:3])
    assert reach.dist_users(masks).count() == 4
    assert sorted(map(str, reach.reach_union(masks, names[:3]).collect())) == sorted(
        f"Row(source={s!r}, hid={h!r})" for s, h in set(rows)
    )
    overlap = {tuple(r) for r in reach.reach_overlap(masks, names[:3]).collect()}
    assert overlap == {("a", 1, 1), ("a+b", 2, 1), ("b", 1, 1)}


def test_distinct_users_exact_and_approximate(spark):
    users = lambda *ids: spark.createDataFrame([(x,) for x in ids], "hid string")
    sources = {"a": users("u1", "u1", "u2"), "b": users("u2", "u3")}
    exact = {r.source: r.num_si_users for r in reports.distinct_users(sources).collect()}
    assert exact == {"a": 2, "b": 2}
    assert exact == {r.source: r.num_si_users for r in reports.distinct_users(sources, approximate=True).collect()}


def test_reach_measures(spark):
    rows = [("a", "1", 0, 0), ("a", "1", 1, 0), ("a", "2", 1, 1), ("a", None, 1, 1), ("b", "2", 0, 0)]
    found = reach.reach_measures(spark.createDataFrame(rows, "source string, hid string, start_flag int, watched_flag int"))
    assert {(r.source, r.measure): r.num_users for r in found.collect()} == {
        ("a", "clicked"): 2, ("a", "started"): 2, ("a", "completed"): 1,
        ("b", "clicked"): 1, ("b", "started"): 0, ("b", "completed"): 0,
    }



def test_user_results_and_export(spark, tmp_path):
    journeys = final(spark, [("u1", "v1", c.RECOMMENDED_MODULE, c.HOME_PLACEMENT, 1, 1)])
    people = spark.createDataFrame(
        [("u1", "control", "35+", "A", "heavy"), ("u2", "variation_1", "35+", "B", "heavy")],
        "hid string, exp_group string, age_range string, frequency_band string, frequency_group string",
    )
    results = ex.user_results(people, journeys)
    assert {r.hid: (r.num_starts, r.num_watched) for r in results.collect()} == {"u1": (1, 1), "u2": (0, 0)}
    exported = stages.export_arms(results, f"{tmp_path}/arms", ("control",))
    assert sorted(exported.columns) == sorted(results.columns) and exported.count() == 1
    assert spark.read.parquet(f"{tmp_path}/arms").select("hid", "exp_group").collect() == [("u1", "control")]


def test_stage_folder_is_the_sessions(spark):
    folder = stages.stage_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    df = spark.range(5)
    assert stages.materialise(df, "numbers").count() == 5


def test_input_partitioned_by_date_is_read_and_pruned(spark, tmp_path):
    """Partition folders such as dt=20240101 would be taken for numbers; the declared type is text."""
    from trailhead.schemas import INPUTS
    from trailhead.sources.tables import in_window, read_table

    row = {f.name: None for f in INPUTS["visits"].fields}
    rows = [tuple({**row, "dt": f"2024010{day}"}.values()) for day in (1, 2, 3)]
    path = str(tmp_path / "visits")
    spark.createDataFrame(rows, INPUTS["visits"]).write.partitionBy("dt").parquet(path)
    visits = in_window(read_table(spark, "visits", path), DateWindow("20240102", "20240102"))
    assert [x.dt for x in visits.collect()] == ["20240102"]
    plan = visits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    spark.range(1).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="visits: no column"):
        read_table(spark, "visits", str(tmp_path / "other"))
