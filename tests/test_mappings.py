from datetime import date

import pytest

from trailhead.config import DateWindow
from trailhead.operators import population as pop
from trailhead.operators.mappings import valid_per_week

WINDOW = DateWindow("20240103", "20240125")
COLUMNS = "frequency_band string, frequency_group string, valid_from date, valid_to date"


def per_week(spark, rows):
    found = valid_per_week(spark.createDataFrame(rows, COLUMNS), "frequency_band", "frequency_group", WINDOW)
    return sorted((r.frequency_band, r.week.isoformat(), r.frequency_group) for r in found.collect())


def test_weeks_of_each_period(spark):
    rows = [
        ("a", "old", None, date(2024, 1, 9)),
        ("a", "new", date(2024, 1, 10), None),
        ("b", "one week", date(2024, 1, 8), date(2024, 1, 8)),
        ("b", "no Monday", date(2024, 1, 16), date(2024, 1, 21)),
        ("c", "turned round", date(2024, 1, 20), date(2024, 1, 2)),
        (None, "no key", None, None),
        ("d", "past", date(2020, 1, 1), date(2021, 1, 1)),
    ]
    assert per_week(spark, rows) == [
        ("a", "2024-01-01", "old"), ("a", "2024-01-08", "old"), ("a", "2024-01-15", "new"), ("a", "2024-01-22", "new"),
        ("b", "2024-01-08", "one week"),
    ]
    assert per_week(spark, []) == []


def test_overlap_is_refused(spark):
    rows = [("a", "x", None, date(2024, 1, 8)), ("a", "y", date(2024, 1, 8), None)]
    with pytest.raises(Exception, match="overlapping validity: a in the week of 2024-01-08"):
        per_week(spark, rows)


@pytest.mark.parametrize("lookup_rows", [100, 1])
def test_groups_of_users_by_week(spark, lookup_rows):
    weeks = [date(2024, 1, 8), date(2024, 1, 15)]
    bands = [("u1", "A"), ("u1", "A"), ("u2", "B"), ("u3", None)]
    frequency = spark.createDataFrame(
        [(*b, w) for b in bands for w in weeks], "hid string, frequency_band string, date_of_segmentation date"
    )
    profile = spark.createDataFrame([(f"u{i}", 20) for i in (1, 2, 3)], "hid string, age int")
    table = spark.createDataFrame([("A", "x", None, date(2024, 1, 14)), ("A", "y", date(2024, 1, 15), None)], COLUMNS)
    groups = valid_per_week(table, "frequency_band", "frequency_group", WINDOW)
    users = pop.user_weeks(profile, frequency, groups=groups, lookup_rows=lookup_rows, salts=3)
    found = sorted((r.hid, r.week.day, r.frequency_band, r.frequency_group) for r in users.collect())
    assert found == [
        ("u1", 8, "A", "x"), ("u1", 15, "A", "y"), ("u2", 8, "B", "other"), ("u2", 15, "B", "other"),
        ("u3", 8, "new", "new"), ("u3", 15, "new", "new"),
    ]
