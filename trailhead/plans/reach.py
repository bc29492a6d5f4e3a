"""How many distinct users the sources reach, alone and together.

Every user is one row with a bit for each source that reached them. Reach, union and every overlap follow from the number
of users per combination of bits, a table whose size does not depend on the number of users.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("clicked", "started", "completed")


def tagged(source: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(source).alias("source"), "hid")


def user_masks(tagged_users: list[DataFrame], names: list[str]) -> DataFrame:
    """hid, mask: bit n is set if source number n reached the user. Inputs have the columns source and hid."""
    bit = F.coalesce(*[F.when(F.col("source") == name, F.lit(1 << n).cast("long")) for n, name in enumerate(names)])
    rows = reduce(DataFrame.unionByName, [x.select("source", "hid") for x in tagged_users])
    return rows.groupBy("hid").agg(F.bit_or(bit).alias("mask")).filter("mask IS NOT NULL")


def _names_in(mask: str, names: list[str]) -> Column:
    """Those of the sources whose bit is set, in their order."""
    return F.array_compact(
        F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << n)) != 0, F.lit(name)) for n, name in enumerate(names)])
    )


def reach_union(masks: DataFrame, names: list[str]) -> DataFrame:
    """One row per user and source. Distinct `hid` is the reach of all sources together."""
    return masks.select(F.explode(_names_in("mask", names)).alias("source"), "hid")


def dist_users(masks: DataFrame) -> DataFrame:
    """The de-duplicated users of all sources."""
    return masks.select("hid")


def _combinations(masks: DataFrame) -> DataFrame:
    return masks.filter("hid IS NOT NULL").groupBy("mask").agg(F.count("*").alias("users"))


def reach_overlap(masks: DataFrame, names: list[str]) -> DataFrame:
    """Users per exact combination of sources: `sources` (joined by +), num_sources, num_users."""
    found = _names_in("mask", names)
    return _combinations(masks).filter("mask <> 0").select(
        F.array_join(found, "+").alias("sources"), F.size(found).alias("num_sources"), F.col("users").alias("num_users")
    )


def reach_share(masks: DataFrame, names: list[str], everyone: str) -> DataFrame:
    """Users per source and for all sources ('all'), with their percentage of the signed-in users.

    `everyone` is the name of the source that stands for all signed-in users; it is the last of `names`. It
    may lack users of the other sources.
    """
    others = [x for x in names if x != everyone]
    found = _names_in("mask", others)
    total = F.col("mask").bitwiseAND(F.lit(1 << names.index(everyone))) != 0
    label = F.concat(F.when(F.size(found) > 0, F.concat(found, F.array(F.lit("all")))).otherwise(F.array()),
                     F.when(total, F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    sources = _combinations(masks).select(F.explode(label).alias("source"), "users").groupBy("source").agg(F.sum("users").alias("num_users"))
    # A few rows, one per source, brought together to divide by the total.
    listed = sources.groupBy().agg(
        F.max(F.when(F.col("source").isNull(), F.col("num_users"))).alias("total"),
        F.collect_list(F.struct("source", "num_users")).alias("counts"),
    )
    return listed.select("total", F.inline("counts")).filter("source IS NOT NULL").select(
        "source", "num_users", F.round(F.col("num_users") * 100.0 / F.col("total"), 4).alias("pct_of_signed_in")
    )


def reach_measures(outcomes: DataFrame) -> DataFrame:
    """Users per source who clicked, who started and who completed something: source, measure, num_users.

    From rows of source, hid, start_flag and watched_flag, one per click. A user is one row with the largest flags.
    """
    users = outcomes.filter("hid IS NOT NULL").groupBy("source", "hid").agg(
        F.max("start_flag").alias("started"), F.max("watched_flag").alias("completed")
    )
    counted = users.groupBy("source").agg(
        F.count("*").alias("clicked"), F.sum("started").alias("started"), F.sum("completed").alias("completed")
    )
    return counted.unpivot("source", list(MEASURES), "measure", "num_users")
