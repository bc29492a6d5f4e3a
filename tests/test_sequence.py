import random

import pytest

from catalog import oracle as registered_sql
from catalog import queries as registered
from catalog.compare import connect, differences
from trailhead import config as c
from trailhead.operators import sequence as sq

NAMES = {"h": c.HOME_PLACEMENT, "r": c.RECOMMENDATIONS_PAGE, "t": "site.tv.tleo.page", "e": "site.tv.episode.page"}
PAGES = {"h": "home_page", "w": c.WATCHING_PAGE, "t": c.TITLE_PAGE, "e": c.EPISODE_PAGE}
SCHEMA = (
    "destination string, app_type string, dt string, visit_id string, hid string, page_name_sequence string, "
    "page_sequence string, content_id_sequence string"
)


def journeys(spark, visits, app="tv"):
    rows = []
    for visit, letters in visits.items():
        ids = "|".join(f"p{n:07d}" for n in range(1, len(letters) + 1))
        names = "|".join(NAMES.get(x, "other") for x in letters)
        pages = "|".join(PAGES.get(x, "other") for x in letters)
        rows.append((c.PRODUCT, app, "20240101", visit, "h", names, pages, ids))
    return spark.createDataFrame(rows, SCHEMA)


def hops(spark, letters, pattern, mode="exact"):
    found = sq.extract_hops(journeys(spark, {"v": letters}), pattern, mode).orderBy("hop").collect()
    return [
        (r.entry_page_num, r.content_page_num, int(r.content_id[1:]) if r.content_id else r.content_id) for r in found
    ]


@pytest.mark.parametrize(
    "letters, pattern, exact, compat",
    [
        ("hwehwehweh", sq.WATCHING_DIRECT, [(2, 3, 3), (5, 6, 6), (8, 9, 9)], [(2, 3, 3), (4, 6, 5), (6, 9, 7)]),
        ("hwe", sq.WATCHING_DIRECT, [(2, 3, 3)], [(2, 3, 1)]),
        ("hwtehwteh", sq.WATCHING_VIA_TITLE, [(2, 4, 4), (6, 8, 8)], [(2, 4, 4), (4, 8, 7)]),
        ("hrehrehreh", sq.RECOMMENDATIONS_DIRECT, [(2, 3, 3), (5, 6, 6), (8, 9, 9)],
         [(2, 3, 3), (5, 7, 6), (8, 11, 9)]),
        ("hrtehrtehhh", sq.RECOMMENDATIONS_VIA_TITLE, [(2, 4, 4), (6, 8, 8)], [(2, 4, 4), (6, 10, 9)]),
        ("hrhreh", sq.RECOMMENDATIONS_DIRECT, [], []),
        ("hrerhreh", sq.RECOMMENDATIONS_DIRECT, [(2, 3, 3)], [(2, 3, 3)]),
        ("r", sq.RECOMMENDATIONS_DIRECT, [], []),
        ("hh", sq.WATCHING_DIRECT, [], []),
        ("we" * 7 + "h", sq.WATCHING_DIRECT, [(2 * k + 1, 2 * k + 2, 2 * k + 2) for k in range(7)],
         [(k + 1, 2 * k + 2, k + 2) for k in range(5)]),
    ],
)
def test_hops(spark, letters, pattern, exact, compat):
    assert hops(spark, letters, pattern) == exact
    assert hops(spark, letters, pattern, "compat") == compat


def walk(letters, pattern):
    """Hops found by walking through the pages one at a time."""
    code = {v: k for k, v in {**NAMES, **PAGES}.items()}
    entry, then = code[pattern.entry[0]], "".join("t" if "tleo" in x else "e" for x in pattern.then)
    out = []
    for n, letter in enumerate(letters, 1):
        if letter != entry:
            continue
        if letters[n : n + len(then)] == then:
            out.append((n, n + len(then)))
        elif pattern.guard:
            break
    return out


@pytest.mark.parametrize(
    "pattern, entry",
    [
        (sq.RECOMMENDATIONS_DIRECT, "r"),
        (sq.RECOMMENDATIONS_VIA_TITLE, "r"),
        (sq.WATCHING_DIRECT, "w"),
        (sq.WATCHING_VIA_TITLE, "w"),
    ],
)
def test_random_sequences_and_modes(spark, pattern, entry):
    rng = random.Random(3)
    pair = entry + "".join("t" if "tleo" in x else "e" for x in pattern.then)
    visits = {
        f"v{i}": "".join(rng.choice([entry, "h", "t", "e", pair, pair]) for _ in range(rng.randint(1, 14)))
        for i in range(300)
    }
    df = journeys(spark, visits)
    exact = {(r.visit_id, r.hop): r for r in sq.extract_hops(df, pattern).collect()}
    wanted = {(v, k): x for v, letters in visits.items() for k, x in enumerate(walk(letters, pattern), 1)}
    assert {k: (r.entry_page_num, r.content_page_num) for k, r in exact.items()} == wanted
    assert all(r.content_id == f"p{r.content_page_num:07d}" for r in exact.values())
    compat = {(r.visit_id, r.hop): r for r in sq.extract_hops(df, pattern, "compat").collect()}
    assert set(compat) == {x for x in exact if x[1] <= pattern.rounds}
    for key, r in exact.items():
        if key[1] == 1 and r.content_page_num < len(visits[key[0]]):
            assert tuple(compat[key])[5:] == tuple(r)[5:]


def test_several_names_mobile_and_mode(spark):
    both = sq.HopPattern("page_sequence", ("home_page", c.WATCHING_PAGE), (c.EPISODE_PAGE,), False, 5)
    assert hops(spark, "hewe", both) == [(1, 2, 2), (3, 4, 4)]
    mobile = journeys(spark, {"v": "hwe"}, app=c.MOBILE_APP)
    assert sq.extract_hops(mobile, sq.WATCHING_DIRECT).count() == 0
    with pytest.raises(ValueError):
        sq.extract_hops(mobile, sq.WATCHING_DIRECT, mode="other")


@pytest.mark.parametrize("n", [7, 50])
@pytest.mark.parametrize("pattern, one", [(sq.RECOMMENDATIONS_DIRECT, "re"), (sq.WATCHING_VIA_TITLE, "wte")])
def test_exact_reports_all_hops_and_compat_its_rounds(spark, n, pattern, one):
    many = journeys(spark, {"v": one * n})
    assert sq.extract_hops(many, pattern).count() == n
    assert sq.extract_hops(many, pattern, "compat").count() == pattern.rounds


PAGE_ROWS = "app_type string, dt string, visit_id string, hid string, page_count int, page_name string, page string, content_id string"
ALL_FOUR = {
    "rec_direct": sq.RECOMMENDATIONS_DIRECT,
    "rec_via": sq.RECOMMENDATIONS_VIA_TITLE,
    "watch_direct": sq.WATCHING_DIRECT,
    "watch_via": sq.WATCHING_VIA_TITLE,
}


@pytest.mark.parametrize("block_size", [1, 3, 10_000])
def test_page_rows_give_the_hops_of_whole_sequences(spark, block_size):
    rng = random.Random(4)
    visits = {
        f"v{i}": "".join(rng.choice(["h", "t", "e", "we", "wte", "re", "rte", "re"]) for _ in range(rng.randint(1, 12)))
        for i in range(200)
    } | {"long": "re" * 40, "missed": "re" * 5 + "rh" + "re" * 30, "titles": "rte" * 30}
    rows = [
        ("tv", "20240101", v, None if v == "long" else "h", n, NAMES.get(x, "other"), PAGES.get(x, "other"), f"p{n:07d}")
        for v, letters in visits.items()
        for n, x in enumerate(letters, 1)
    ]
    found = sq.page_hops(spark.createDataFrame(rows, PAGE_ROWS), ALL_FOUR, block_size).collect()
    wanted = {
        (name, v, k, *x) for name, p in ALL_FOUR.items() for v, letters in visits.items() for k, x in enumerate(walk(letters, p), 1)
    }
    assert len(found) == len(wanted)
    assert {(r.family, r.visit_id, r.hop, r.entry_page_num, r.content_page_num) for r in found} == wanted
    assert all(r.content_id == f"p{r.content_page_num:07d}" for r in found)


def test_a_visit_of_thousands_of_pages_stays_one(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, 1, "view", f'{{"k": {rng.choice([1, 2, 2, 3, 6])}}}') for i in range(3_000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    events.selectExpr("*", "timestamp_ntz'2024-01-09 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts").write.parquet(
        f"{tmp_path}/events.parquet"
    )
    ks = [int(r[3][6:-1]) for r in rows]
    for family, query in (("rec_direct", "hops_direct"), ("watch_direct", "hops_watching_direct"), ("watch_via", "hops_watching_via_title")):
        pattern = ALL_FOUR[family]
        letters = "".join(f"hte{'r' if pattern.guard else 'w'}"[k % 4] for k in ks)
        found = registered.queries()[query](spark, str(tmp_path)).collect()
        assert sorted((r.hop, r.entry_page_num, r.content_page_num) for r in found) == [
            (n, *x) for n, x in enumerate(walk(letters, pattern), 1)
        ]
        assert all(int(r.content_id[1:]) == ks[r.content_page_num - 1] % 8 for r in found)
        assert pattern.guard or max(r.content_page_num for r in found) > 2_000
    counted = registered.queries()["occurrence_histogram"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in counted] == [(sum(k % 4 == 3 for k in ks), 1)]
    duck = connect(str(tmp_path))
    for query in (
        "hops_direct", "hops_watching_via_title", "hops_direct_compat", "hops_watching_direct_compat", "occurrence_histogram",
        "occurrence_histogram_pairs", "journeys_from_title_pages", "hop_funnel_watching_all_compat",
    ):
        assert differences(spark, str(tmp_path), duck, registered.queries()[query], registered_sql.oracle_sql()[query]) is None


def test_hops_need_no_shuffle(spark):
    plan = sq.extract_hops(journeys(spark, {"v": "hwe"}), sq.WATCHING_DIRECT)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_outcomes(spark):
    df = journeys(spark, {"a": "hweh", "b": "hweh"})
    facts = spark.createDataFrame(
        [
            ("20240101", "a", "p0000003", 3, c.START_ATTRIBUTE, c.COMPLETE_ATTRIBUTE),
            ("20240101", "b", "p0000003", 2, c.START_ATTRIBUTE, "no"),
        ],
        "dt string, visit_id string, content_id string, page_count int, start_flag string, watched_flag string",
    )
    twice = sq.extract_hops(df, {"a": sq.WATCHING_DIRECT, "b": sq.WATCHING_DIRECT})
    assert twice.count() == 4 and twice.filter("family = 'a'").count() == 2
    rows = sq.hop_outcomes(twice, facts, "watching_page").collect()
    assert sorted((r.visit_id, r.start_flag, r.watched_flag) for r in rows) == [("a", 1, 1), ("b", 0, 0)]


@pytest.mark.parametrize("block_size", [3, 5, 10_000])
def test_compat_of_page_rows_equals_that_of_strings(spark, block_size):
    rng = random.Random(9)
    visits = {
        f"v{i}": "".join(rng.choice(["h", "t", "e", "we", "wte", "re", "rte", "re"]) for _ in range(rng.randint(1, 12)))
        for i in range(300)
    } | {"long": "re" * 40, "titles": "rte" * 30, "watched": "we" * 40, "last": "hwe", "one": "r"}
    strings = journeys(spark, visits)
    wanted = sq.extract_hops(strings, ALL_FOUR, "compat").collect()
    found = sq.page_hops(sq.page_rows(strings), ALL_FOUR, block_size, "compat")
    columns = ["app_type", "dt", "visit_id", "hid", "family", "hop", "entry_page_num", "content_page_num", "content_id"]
    assert found.columns == columns
    assert sorted(tuple(x[c] for c in columns) for x in found.collect()) == sorted(tuple(x[c] for c in columns) for x in wanted)
    with pytest.raises(ValueError):
        sq.page_hops(sq.page_rows(strings), ALL_FOUR, block_size, "other")


def greedy(letters, run):
    """Runs taken one after the other from the left."""
    times, at = 0, 0
    while at <= len(letters) - len(run):
        hit = letters[at : at + len(run)] == run
        times, at = times + hit, at + (len(run) if hit else 1)
    return times


@pytest.mark.parametrize("block_size", [6, 7, 10_000])
@pytest.mark.parametrize("run", ["w", "we", "ww", "wew", "wwe", "wewwe", "wwww", "weweww"])
def test_runs_are_counted_without_overlap(spark, run, block_size):
    rng = random.Random(len(run))
    visits = {f"v{i}": "".join(rng.choice("wwe") for _ in range(rng.randint(1, 40))) for i in range(120)}
    visits |= {"none": "hhh", "all": "w" * 61, "gap": "w" * 5 + "h" * 9 + "w" * 5}
    pages = sq.page_rows(journeys(spark, visits))
    names = tuple(PAGES[x] for x in run)
    found = {x.visit_id: x.times for x in sq.count_runs(pages, "page", names, block_size).collect()}
    wanted = {v: greedy(letters, run) for v, letters in visits.items()}
    assert found == {v: n for v, n in wanted.items() if n}
    shown = {x.visit_id: x.times for x in sq.count_runs(pages, "page", names, block_size, containing="HING_p").collect()}
    assert shown == {v: n for v, n in wanted.items() if "w" in visits[v]}


def test_a_block_must_hold_a_run(spark):
    pages = sq.page_rows(journeys(spark, {"v": "ww"}))
    with pytest.raises(ValueError):
        sq.count_runs(pages, "page", (c.WATCHING_PAGE,) * 3, 2)


@pytest.mark.parametrize("block_size", [1, 4, 10_000])
def test_pages_from_the_first_run_on(spark, block_size):
    visits = {"a": "hwteh" * 3, "b": "hwt", "c": "hhhhwtehwte", "d": "wte"}
    pages = sq.page_rows(journeys(spark, visits))
    found = sq.pages_from(pages, "page", tuple(PAGES[x] for x in "wte"), block_size).collect()
    wanted = {(v, n, PAGES[x]) for v, letters in visits.items() if "wte" in letters
              for n, x in enumerate(letters[letters.index("wte"):], 1)}
    assert len(found) == len(wanted) and {(x.visit_id, x.step, x.page) for x in found} == wanted
    some = sq.pages_from(pages, "page", tuple(PAGES[x] for x in "wte"), block_size, limit=1).collect()
    assert {x.visit_id for x in some} == {"a"} and len(some) == 14


def test_visits_of_one_hundred_thousand_pages(spark):
    n = 100_000
    letter = "substring('wweh', cast(id % 4 as int) + 1, 1)"
    pages = spark.range(n).selectExpr(
        "'tv' AS app_type", "'20240101' AS dt", "'v' AS visit_id", "cast(null as string) AS hid", "cast(id + 1 as int) AS page_count",
        f"{letter} AS page", f"{letter} AS page_name", "concat('p', lpad(id + 1, 7, '0')) AS content_id",
    )
    pattern = sq.HopPattern("page_sequence", ("w",), ("e",), False, 5)
    expected = [(k + 1, 4 * k + 2 - k, 4 * k + 3 if k == 0 else 4 * k + 2 + 1 - k) for k in range(5)]
    for size in (1_000, 10_000):
        assert [tuple(x) for x in sq.count_runs(pages, "page", ("w", "w"), size).select("times").collect()] == [(n // 4,)]
        assert sq.count_runs(pages, "page", ("w", "e"), size).first().times == n // 4
        assert sq.pages_from(pages, "page", ("w", "e"), size).count() == n - 1
        found = sq.page_hops(pages, pattern, size, "compat").orderBy("hop").collect()
        assert [(x.hop, x.entry_page_num, int(x.content_id[1:])) for x in found] == expected
    assert sq.short_visits(pages, "w").count() == 0


def test_short_visits(spark):
    df = sq.page_rows(journeys(spark, {"a": "hrr", "b": "hrhrh", "c": "hh", "d": "r"}))
    assert sorted(x.page_name_sequence.count("|") for x in sq.short_visits(df, "recommendations.page").collect()) == [0, 2]
    assert sq.short_visits(df, "recommendations.page", limit=0).count() == 0
    first = sq.short_visits(df, "RECOMMENDATIONS.page", limit=1).collect()
    assert [x.page_name_sequence for x in first] == ["|".join(NAMES[x] for x in "hrr")]
    counted = sq.run_histogram(df, "page_name", (c.RECOMMENDATIONS_PAGE,), 10, "recommendations.page")
    assert sorted(tuple(r) for r in counted.collect()) == [(1, 1), (2, 2)]
