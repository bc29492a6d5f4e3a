"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns with awkward names."""

import pytest
from pyspark.sql import functions as F

from trailhead.llm import decontamination, jaccard, language, lines, mixing, quality, repeats, secrets, sharding, urls

SCHEMA = (
    "doc_id long, text string, lang string, source string, size long, hash string, key int, doc string, node long, "
    "`a.b` int, _s string, rest int"
)
LONG = "word another third " * 40_000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (None, "some words here " * 30, "en", None),
    (3, "some words here " * 30, None, "s"),
    (3, "some words here " * 30, None, "s"),
    (4, LONG, "fr", "s"),
    (5, "\n \t\n", "en", "t"),
    (None, None, None, None),
    (6, "1234 !!", "en", "t"),
]
BENCHMARK = [(1, "some words here some words here some words"), (2, None), (3, ""), (1, "some words here some words here some words")]

OPERATORS = {
    "sharding": lambda d, b: sharding.assign_shards(d, sharding.ShardSettings(shards=3)),
    "language": lambda d, b: language.identify(d, F.lit(True)),
    "jaccard": lambda d, b: jaccard.classes(d),
    "repeats": lambda d, b: repeats.remove_repeats(d),
    "lines": lambda d, b: lines.drop_common_lines(d),
    "quality": lambda d, b: quality.judged(d),
    "secrets": lambda d, b: secrets.find_secrets(d),
    "mixing": lambda d, b: mixing.mix(d),
}
KEEPERS = {
    "quality": lambda d, b: quality.kept_documents(d, quality.QualitySettings(max_repeat_percent=100)),
    "jaccard": lambda d, b: jaccard.one_per_class(d),
    "decontamination": decontamination.clean_documents,
    "mixing": lambda d, b: mixing.mixed_documents(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame([(*x, 1, "h", 2, "d", 3, 4, "s", 5) for x in ROWS], SCHEMA)
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    return frame, benchmark


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_gets_a_result(odd, name):
    found = OPERATORS[name](*odd).collect()
    ids = sorted((x.doc_id is None, x.doc_id or 0) for x in found)
    assert ids == sorted((x[0] is None, x[0] or 0) for x in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(odd, name):
    frame, benchmark = odd
    assert OPERATORS[name](frame.limit(0), benchmark).collect() == []


@pytest.mark.parametrize("name", sorted(KEEPERS))
def test_all_columns_are_kept(odd, name):
    frame, benchmark = odd
    kept = KEEPERS[name](frame, benchmark)
    assert kept.columns == frame.columns and kept.count() > 0
    assert KEEPERS[name](frame.limit(0), benchmark).collect() == []


def test_defined_results(odd):
    frame, benchmark = odd
    classes = {(x.doc_id, x.n_shingles): x.component_id for x in jaccard.classes(frame).collect()}
    assert classes[(1, 0)] == 1 and classes[(None, 0)] is None and classes[(2, 0)] == 2
    assert {x for (i, n), x in classes.items() if n and i in (None, 3)} == {3}
    preds = {x.doc_id: x.lang_pred for x in language.identify(frame, F.lit(True)).collect() if x.doc_id}
    assert preds[1] == preds[2] == preds[5] == preds[6] == "und"
    removed = {x.doc_id: (x.n_bytes, x.n_removed) for x in repeats.remove_repeats(frame).collect() if x.doc_id}
    assert removed[1] == (0, 0) and removed[3] == (480, 480) and removed[4] == (len(LONG), len(LONG))
    counts = {x.doc_id: (x.n_lines, x.n_dropped) for x in lines.drop_common_lines(frame).collect() if x.doc_id}
    assert counts[1] == (1, 0) and counts[2] == (1, 0) and counts[5] == (3, 0)
    taken = {x.doc_id: (x.size, x.taken) for x in mixing.mix(frame).collect() if x.doc_id}
    assert taken[1] == (0, 0) and taken[4][0] == 120_000
    leaks = decontamination.find_leaks(frame, benchmark).collect()
    assert sorted((x.doc_id or 0, x.item_id) for x in leaks) == [(0, 1), (3, 1), (3, 1)]
    assert decontamination.find_leaks(frame, benchmark.limit(0)).collect() == []


def test_urls(spark):
    pages = spark.createDataFrame(
        [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "HTTP://A.B/C" + "/d" * 50_000, None)],
        "page_id long, url string, verdict string",
    )
    rules = urls.rule_table(spark, [urls.Rule("block", "b", "/C")])
    found = sorted((x.page_id or 0, x.host, x.rule or "", x.verdict) for x in urls.judge_urls(pages, rules).collect())
    assert found == [(0, "", "", "allow"), (1, "", "", "allow"), (1, "", "", "allow"), (2, "a.b", "b/C", "block")]
    assert urls.judge_urls(pages.limit(0), rules).collect() == []
    assert {x.verdict for x in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
