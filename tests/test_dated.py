"""Stages kept by date equal a full run, and touch only what changed."""

from pathlib import Path

from pyspark.sql import functions as F

from trailhead.sources import dated

ROWS = [("20240101", "a", 1), ("20240101", "a", 1), ("20240102", "b", 2), ("20240103", "c", 3), (None, "d", 4)]
SCHEMA = "dt string, name string, n int"


def sums(rows):
    return rows.filter("n >= 0").groupBy("dt", "name").agg(F.sum("n").alias("total"))


def state(spark, path, **window):
    schema = sums(spark.createDataFrame([], SCHEMA)).schema
    return sorted(map(tuple, dated.read_dates(spark, path, schema, **window).collect()))


def folders(path):
    return {str(x.relative_to(path)) for x in Path(path, "data").glob("run=*/dt=*")}


def test_late_rows_rebuild_one_date(spark, tmp_path):
    path, seen = str(tmp_path / "stage"), []

    def build(rows):
        seen.append({x.dt for x in rows.select("dt").distinct().collect()})
        return sums(rows)

    assert state(spark, path) == []
    first = spark.createDataFrame(ROWS, SCHEMA)
    assert dated.update_dates(first, path, build) == ["20240101", "20240102", "20240103"]
    assert state(spark, path) == [("20240101", "a", 2), ("20240102", "b", 2), ("20240103", "c", 3)]
    before = folders(path)

    # The same rows in another order change nothing.
    assert dated.update_dates(spark.createDataFrame(ROWS[::-1], SCHEMA), path, build) == []
    assert len(seen) == 1 and folders(path) == before

    # A further copy of a row and a row out of bounds both count as changes of the source.
    late = spark.createDataFrame([*ROWS, ("20240102", "b", 2), ("20240103", "x", -1)], SCHEMA)
    assert dated.update_dates(late, path, build) == ["20240102", "20240103"]
    assert seen[-1] == {"20240102", "20240103"}
    assert state(spark, path) == [("20240101", "a", 2), ("20240102", "b", 4), ("20240103", "c", 3)]
    assert state(spark, path, first="20240102", last="20240102") == [("20240102", "b", 4)]
    assert len(folders(path) - before) == 2

    assert dated.drop_superseded(spark, path) == 2
    assert len(folders(path)) == 3 and len(state(spark, path)) == 3


def test_dates_that_vanish_or_yield_nothing(spark, tmp_path):
    path = str(tmp_path / "stage")
    dated.update_dates(spark.createDataFrame(ROWS, SCHEMA), path, sums)
    rest = spark.createDataFrame([("20240101", "a", -5), *ROWS[3:]], SCHEMA)
    assert dated.update_dates(rest, path, sums) == ["20240101", "20240102"]
    assert state(spark, path) == [("20240103", "c", 3)]
    assert dated.update_dates(rest, path, sums) == []
    assert dated.update_dates(spark.createDataFrame([], SCHEMA), path, sums) == ["20240101", "20240103"]
    assert state(spark, path) == []


def test_a_failed_run_leaves_the_stage_as_it_was(spark, tmp_path):
    path = str(tmp_path / "stage")
    dated.update_dates(spark.createDataFrame(ROWS, SCHEMA), path, sums)
    good = state(spark, path)
    changed = spark.createDataFrame([*ROWS, ("20240101", "z", 9)], SCHEMA)
    broken = lambda rows: sums(rows).withColumn("total", F.raise_error(F.lit("broken")).cast("long"))
    try:
        dated.update_dates(changed, path, broken)
    except Exception as error:
        assert "broken" in str(error)
    else:
        raise AssertionError("the error was swallowed")
    assert state(spark, path) == good
    assert dated.update_dates(changed, path, sums) == ["20240101"]
    assert ("20240101", "z", 9) in state(spark, path)
