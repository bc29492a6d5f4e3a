"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import materialise

SALT = "_salt"
MOST_HOT = 100_000


def block_of(position: Column, size: int) -> Column:
    """Slice of a visit an event position falls into; a missing position counts as the first."""
    return F.greatest(F.lit(0), F.coalesce(F.call_function("div", position, F.lit(size)), F.lit(0))).cast("long")


def hot_keys(df: DataFrame, keys: list[str], more_than: int) -> DataFrame | None:
    """Keys with more than `more_than` rows and their row count `hot_n`; None if there are none.

    A key with less than one in MOST_HOT of all rows is never hot, so that there are at most MOST_HOT of
    them in a table of any size and the result may be broadcast. It is written once, because both sides
    of a join look keys up in it. A table of no more than `more_than` rows needs no look at its keys.
    """
    rows = df.count()
    if rows <= more_than:
        return None
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n"))
    hot = counts.filter(F.col("hot_n") > max(more_than, rows // MOST_HOT))
    return materialise(hot, "hot") if hot.head(1) else None


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: DataFrame | None,
    hot_on: list[str],
    spread_by: list[str],
    salts: int,
) -> DataFrame:
    """Inner join on `on` in which each key listed in `hot` is shared out over `salts` tasks.

    Rows of a hot key on the left get a salt from `spread_by`; on the right they are repeated once
    per salt. Other keys are joined as usual, so the cost of repeating is limited to hot keys.
    """
    if hot is None:
        return left.join(right, on, "inner")
    marked = F.broadcast(hot.select(*hot_on, F.lit(True).alias("_hot")))
    left_salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(0).cast("int")
    right_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.join(marked, hot_on, "left").withColumn(SALT, left_salt).drop("_hot")
    salted_right = right.join(marked, hot_on, "left").withColumn(SALT, F.explode(right_salts)).drop("_hot")
    return salted_left.join(salted_right, [*on, SALT], "inner").drop(SALT)


def fits_broadcast(table: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether a table has at most `max_rows` rows and `max_bytes` bytes of values, written as text."""
    sizes = [F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) for x in table.columns]
    found = table.agg(F.count(F.lit(1)).alias("n"), F.sum(sum(sizes, F.lit(0)).cast("long")).alias("bytes")).head()
    return found.n <= max_rows and (found.bytes or 0) <= max_bytes


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str,
    spread_by: list[str],
    max_rows: int,
    salts: int,
    hot_rows: int = 1_000_000,
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """Left join to the distinct rows of a lookup table, on a column that a few values may dominate.

    The lookup is broadcast if an aggregate shows that it has at most `max_rows` rows and `max_bytes`
    bytes. A larger one is shuffled: rows with a value that occurs more than `hot_rows` times are spread
    over `salts` tasks and only that value's lookup rows are repeated. Rows with a missing value are
    spread likewise.
    """
    distinct = lookup.distinct()
    if fits_broadcast(distinct, max_rows, max_bytes):
        return df.join(F.broadcast(distinct), on, "left")
    hot = hot_keys(df.select(on), [on], hot_rows)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    if hot is None:
        salted = df.withColumn(SALT, F.when(F.col(on).isNull(), spread).otherwise(0).cast("int"))
        copies = distinct.withColumn(SALT, F.lit(0))
    else:
        marked = F.broadcast(hot.select(on, F.lit(True).alias("_hot")))  # at most MOST_HOT rows
        is_spread = F.col("_hot") | F.col(on).isNull()
        salted = df.join(marked, on, "left").withColumn(SALT, F.when(is_spread, spread).otherwise(0).cast("int"))
        each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        copies = distinct.join(marked, on, "left").withColumn(SALT, F.explode(each)).drop("_hot")
    return salted.join(copies, [on, SALT], "left").select(*df.columns, *[x for x in lookup.columns if x != on])


def number_rows(
    df: DataFrame, keys: list[str], block: str, wide: str | None, order: list[Column], out: str
) -> DataFrame:
    """`row_number` over `keys`, computed one block at a time (see `count_rows`)."""
    if wide is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys, block).orderBy(*order)).cast("long"))
    return count_rows(df, keys, block, wide, order, {out: F.lit(1)})


def count_rows(
    df: DataFrame, keys: list[str], block: str, wide: str | None, order: list[Column], steps: dict[str, Column]
) -> DataFrame:
    """Running sums over `keys`, computed one block at a time: one new column for each entry of `steps`.

    `block` must rise with `order`. `wide` names a boolean column that is true for groups with more
    than one block; for those, a row holding the sums of all earlier blocks is put in front of each
    block, so a running sum gives the number within the whole group. With `wide=None` every group
    is known to be a single block.
    """
    scan = Window.partitionBy(*keys, block)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({name: step.cast("long") for name, step in steps.items()})
    if wide is None:
        running = scan.orderBy(*order).rowsBetween(*so_far)
        return rows.withColumns({name: F.sum(name).over(running) for name in steps})
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.filter(F.col(wide))
        .groupBy(*keys, wide, block)
        .agg(*[F.sum(name).alias(name) for name in steps], F.lit(True).alias("_ahead"))
        .withColumns({name: F.sum(name).over(earlier) for name in steps})
        .filter(F.col(next(iter(steps))).isNotNull())
    )
    rows = rows.withColumn("_ahead", F.lit(False))
    running = scan.orderBy(F.col("_ahead").desc(), *order).rowsBetween(*so_far)
    return (
        rows.unionByName(offsets, allowMissingColumns=True)
        .repartition(*keys, block)
        .withColumns({name: F.sum(name).over(running) for name in steps})
        .filter(~F.col("_ahead"))
        .drop("_ahead")
    )
