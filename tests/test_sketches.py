from pyspark.sql import functions as F

from trailhead.config import DateWindow
from trailhead.plans.sketches import daily_sketches, merged_users


def test_merged_days_stay_within_the_error(spark):
    # 60,000 users on three days that overlap by half; few of them in the second group.
    rows = spark.range(80_000).select(
        F.explode(F.array(*[F.lit(x) for x in ("20240101", "20240102", "20240103")])).alias("dt"), "id"
    )
    day = F.substring("dt", 8, 1).cast("long")
    seen = rows.filter((F.col("id") >= (day - 1) * 20_000) & (F.col("id") < (day + 1) * 20_000))
    seen = seen.select("dt", F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id").cast("string")).alias("hid"),
                       F.when(F.col("id") % 50 == 1, "few").otherwise("many").alias("module"))
    sketches = daily_sketches(seen, ["module"])
    assert sketches.count() == 6
    for window in (None, DateWindow("20240102", "20240103")):
        rows_in = seen if window is None else seen.filter(F.col("dt") >= "20240102")
        exact = dict(rows_in.groupBy("module").agg(F.count_distinct("hid")).collect())
        found = dict(merged_users(sketches, ["module"], window).collect())
        assert set(found) == set(exact) == {"few", "many"}
        # Three standard errors.
        assert all(abs(found[x] - exact[x]) <= 3 * 1.04 / 2**7 * exact[x] for x in exact)
    assert merged_users(daily_sketches(seen.limit(0), ["module"]), ["module"]).count() == 0
