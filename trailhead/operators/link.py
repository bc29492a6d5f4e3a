"""Mutual-nearest linking: which start did a click lead to, and which complete did a start lead to.

A left event (click) and a right event (start) of one visit are candidates if they share a match key
and the right one is not earlier. A pair is kept if each is the other's nearest candidate; it is one
pass, so a left event that loses its right event is not matched again.

Candidates are never listed as pairs. Left and right events are put in one stream, and for each match
key one ordered scan finds the nearest event on the other side: n log n in the size of a visit. The
stream is cut into the blocks of the population, so a visit of any size is spread over many tasks; for
the few visits with more than one block, rows at the edges of each block carry the nearest event of the
blocks before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import classify as fn
from .skew import block_of, count_rows, number_rows

# The most selective column first: sorts compare it first.
USER_VISIT = ["visit_id", "hid", "cookie_id", "dt"]
GROUP = [*USER_VISIT, "wide", "block"]
# A visit with all its users: one person signs out and another in.
SHARED_VISIT = ["visit_id", "cookie_id", "dt"]
# A visit with more users than this is linked block by block and spread over tasks, with the same results.
MOST_USERS_AT_HAND = 100

# The two journey variants: title pages skipped, so that all paths count, and title pages kept.
ALL_PATHS, DIRECT = "all_paths", "direct"

# Places of a row within its block: carried in from earlier blocks, ordinary, carried in from later ones.
BEFORE, INSIDE, AFTER = 0, 1, 2


def _timeline_order() -> list[Column]:
    return [
        F.col("event_position"),
        F.col("kind") == "start",
        F.col("attribute"),
        F.col("container"),
        F.col("placement"),
        F.col("content_id"),
    ]


def timeline_ordinals(timeline: DataFrame, has_wide: bool = True, across_users: bool = False) -> DataFrame:
    """Number the clicks and starts of each visit by position; at one position clicks come first."""
    order = _timeline_order()
    if has_wide:
        return number_rows(timeline, USER_VISIT, "block", "wide", order, "ordinal")
    # Partitioned on the visit alone, so that every later window on a visit reuses this exchange.
    at_hand = timeline.repartition(*SHARED_VISIT) if across_users else timeline.repartition(*USER_VISIT, "block")
    return number_rows(at_hand, USER_VISIT, "block", None, order, "ordinal")


def both_timelines(timeline: DataFrame, has_wide: bool = True) -> DataFrame:
    """The numbered timelines of both journey variants, told apart by the column `variant`.

    `timeline` holds clicks with title pages kept. What the variant without title pages leaves out is
    not counted in its ordinals, so both numbers are running counts over one order: rows are doubled
    only behind the exchange. The result is distributed as that of `timeline_ordinals`.
    """
    counted = (F.col("kind") != "standard") | fn.is_off_title_page(F.col("placement"))
    timeline = timeline.withColumn("counted", F.coalesce(counted, F.lit(False)))
    steps = {"ordinal": F.lit(1), "skipping": F.col("counted").cast("int")}
    if has_wide:
        numbered = count_rows(timeline, USER_VISIT, "block", "wide", _timeline_order(), steps)
    else:
        at_hand = timeline.repartition(*USER_VISIT, "block")
        numbered = count_rows(at_hand, USER_VISIT, "block", None, _timeline_order(), steps)
    skipping = F.struct(F.lit(ALL_PATHS).alias("variant"), F.col("skipping").alias("ordinal"))
    keeping = F.struct(F.lit(DIRECT).alias("variant"), F.col("ordinal"))
    found = F.array_compact(F.array(keeping, F.when(F.col("counted"), skipping)))
    rest = [x for x in timeline.columns if x != "counted"]
    return numbered.withColumn("found", F.explode(found)).select(*rest, "found.*")


# One scan per match key: by position, left events before right ones at the same position.
SCAN_ORDER = "ORDER BY edge, position, is_right, tie"
RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _scan(rows: DataFrame, group: list[str]) -> DataFrame:
    """Nearest events on the other side.

    `before`        for a right event, the last left event up to it
    `right_before`  whether any right event came earlier
    `after`         for a left event, the next right event
    `pair`          for a right event, how it compares as a partner of `before`
    """
    left_here = f"edge = {BEFORE} AND tie IS NOT NULL OR edge = {INSIDE} AND NOT is_right"
    right_here = f"edge = {BEFORE} AND seen_right OR edge = {INSIDE} AND is_right"
    scan = f"PARTITION BY {', '.join(group)}, key {SCAN_ORDER}"
    scanned = rows.selectExpr(
        "*",
        f"last(CASE WHEN {left_here} THEN struct(position, tie) END, true) OVER ({scan} {RUNNING}) AS before",
        f"max({right_here}) OVER ({scan} {RUNNING}) AS right_before",
        f"lead(CASE WHEN is_right AND edge <> {BEFORE} THEN struct(position, tie, right) END) IGNORE NULLS "
        f"OVER ({scan}) AS after",
    )
    return scanned.filter(F.col("edge") != BEFORE).selectExpr(
        *[x for x in rows.columns if x != "pair"],
        "right_before",
        "after",
        f"CASE WHEN edge = {AFTER} THEN pair WHEN is_right AND before IS NOT NULL THEN "
        "struct(position - before.position AS distance, -before.tie AS later_left, tie AS right) END AS pair",
    )


def _without_block(group: list[str]) -> list[str]:
    return [x for x in group if x != "block"]


def _carried_from_earlier(wide: DataFrame, group: list[str]) -> DataFrame:
    """For each block and key: the last left event of earlier blocks, and whether they had a right one."""
    across = (
        Window.partitionBy(*_without_block(group), "key")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    last_left = F.max(F.when(~F.col("is_right"), F.struct("position", "tie")))
    return (
        wide.groupBy(*group, "key")
        .agg(last_left.alias("last_left"), F.max("is_right").alias("has_right"))
        .withColumns(
            {
                "carried": F.last("last_left", ignorenulls=True).over(across),
                "seen_right": F.coalesce(F.max("has_right").over(across), F.lit(False)),
            }
        )
        .filter(F.col("carried").isNotNull() | F.col("seen_right"))
        .select(
            *group, "key", F.lit(BEFORE).alias("edge"), F.lit(False).alias("is_right"), "seen_right", "carried.*"
        )
    )


def _carried_from_later(scanned: DataFrame, group: list[str]) -> DataFrame:
    """For each block and key: the first right event of later blocks, with the best pair of its slot."""
    across = (
        Window.partitionBy(*_without_block(group), "key")
        .orderBy(F.col("block").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    slot = Window.partitionBy(*group, "is_right", "position")
    first_right = F.min(F.when(F.col("is_right"), F.struct("position", "tie", "right", "pair")))
    return (
        scanned.withColumn("pair", F.min("pair").over(slot))
        .groupBy(*group, "key")
        .agg(first_right.alias("first_right"))
        .withColumn("carried", F.last("first_right", ignorenulls=True).over(across))
        .filter(F.col("carried").isNotNull())
        .select(*group, "key", F.lit(AFTER).alias("edge"), F.lit(True).alias("is_right"), "carried.*")
    )


def link_nearest(
    rows: DataFrame, has_wide: bool = True, drop_backward_only: bool = True, apart: tuple[str, ...] = ()
) -> DataFrame:
    """Left rows with their linked right row.

    `rows`: the columns of GROUP, position, key, is_right, tie, and the structs left and right, one of
    them NULL; a right event has one row per match key. Among events at one position, `tie` orders them
    in time: at equal distance the later left and the earlier right event are nearest. With
    `has_wide=False` every visit is known to be one block, and `rows` must be partitioned by visit and block.
    Rows that differ in the columns `apart` are of different timelines and never linked.
    Result: visit columns, wide, `apart`, position, left, and of the linked event right_position and right.

    * A left event whose candidates are all earlier is dropped (unless `drop_backward_only` is False).
    * Of several left events at one position that have candidates, one is kept.
    * Every other left event is kept, linked or not.
    """
    group = [*GROUP, *apart]
    rows = rows.selectExpr(
        "*",
        f"{INSIDE} AS edge",
        "false AS seen_right",
        "CAST(NULL AS struct<distance:bigint,later_left:bigint,right:bigint>) AS pair",
    )
    if has_wide:
        wide = rows.filter(F.col("wide"))
        earlier = _carried_from_earlier(wide, group)
        scanned = _scan(wide.unionByName(earlier, allowMissingColumns=True).repartition(*USER_VISIT, "block"), group)
        later = _carried_from_later(scanned, group)
        rows = (
            rows.unionByName(earlier, allowMissingColumns=True)
            .unionByName(later, allowMissingColumns=True)
            .repartition(*USER_VISIT, "block")
        )
    within = ", ".join(group)
    # A slot is all that happens at one position. Left events look their partner's slot up.
    resolved = (
        _scan(rows, group)
        .selectExpr("*", "CASE WHEN is_right THEN position ELSE after.position END AS slot")
        .selectExpr("*", f"min(pair) OVER (PARTITION BY {within}, slot) AS best")
        .filter((F.col("edge") == INSIDE) & ~F.col("is_right"))
        .selectExpr(
            "*",
            "CASE WHEN after IS NOT NULL THEN "
            "struct(after.position - position AS distance, -tie AS later_left, after.tie AS right) END AS own",
        )
        .selectExpr(
            "*", f"row_number() OVER (PARTITION BY {within}, position, own IS NULL ORDER BY own) AS place"
        )
    )
    kept = resolved.filter("own IS NULL OR place = 1")
    if drop_backward_only:
        kept = kept.filter("own IS NOT NULL OR NOT coalesce(right_before, false)")
    linked = "CASE WHEN own IS NOT NULL AND own <=> best THEN"
    return kept.selectExpr(
        *_without_block(group),
        "position",
        "left",
        f"{linked} after.position END AS right_position",
        f"{linked} after.right END AS right",
    )


def click_keys(ordinal: Column) -> Column:
    """Match key of a click: its target id, or its place in the timeline if the target is unknown."""
    return F.when(F.col("content_id") == c.UNKNOWN, F.concat(F.lit("row:"), ordinal)).otherwise(
        F.concat(F.lit("id:"), F.col("content_id"))
    )


def start_keys(ordinals: Column) -> Column:
    """Match keys of a start: its episode, series and brand ids, and the place just before each of its own."""
    ids = F.filter(
        F.array(F.col("content_id"), F.col("series_id"), F.col("brand_id")),
        lambda x: x.isNotNull() & (x != c.UNKNOWN),
    )
    named = F.when(F.col("content_id").isNotNull(), F.transform(ids, lambda x: F.concat(F.lit("id:"), x)))
    adjacent = F.transform(ordinals, lambda x: F.concat(F.lit("row:"), x - 1))
    return F.array_distinct(F.concat(F.coalesce(named, F.array().cast("array<string>")), adjacent))


def seen_by_all(events: DataFrame, lefts: DataFrame) -> DataFrame:
    """Events without a user, each repeated for every user who has a row in `lefts` in the same visit.

    A block's events meet the users by visit and block, so a long visit stays spread out.
    """
    users = lefts.select(*SHARED_VISIT, "hid").distinct()
    blocks = events.select(*SHARED_VISIT, "block").distinct()
    return events.join(users.join(blocks, SHARED_VISIT), [*SHARED_VISIT, "block"])


def seen_at_hand(rows: DataFrame, is_left: Column) -> DataFrame:
    """Rows of both sides; those that are not left are repeated for every user with a left row in the same visit.

    For visits of one block and few users: a visit's rows are at hand in one task, and its users in one array.
    """
    user = F.struct("hid")
    users = F.collect_set(F.when(is_left, user)).over(Window.partitionBy(*SHARED_VISIT))
    seen_by = F.when(is_left, F.array(user)).otherwise(F.col("_users"))
    rest = [x for x in rows.columns if x != "hid"]
    return rows.withColumn("_users", users).withColumn("_user", F.explode(seen_by)).select(*rest, "_user.hid")


START = ["attribute", "container", "placement", "content_id", "series_id", "brand_id"]


def _starts_at_hand(timeline: DataFrame) -> DataFrame:
    """`starts_of_all` for visits of one block and few users: windows over the exchange of the timeline."""
    is_start = F.col("kind") == "start"
    place = [*SHARED_VISIT, "block", "wide", "event_position", "kind"]
    same = Window.partitionBy(*place, *START)
    merged = (
        timeline.withColumn("copy", F.row_number().over(same.orderBy("hid", "ordinal")))
        .withColumn("ordinals", F.collect_set("ordinal").over(same))
        .withColumn("rank", F.dense_rank().over(Window.partitionBy(*place).orderBy(*START)).cast("long"))
    )
    seen = seen_at_hand(merged.filter(~is_start | (F.col("copy") == 1)), ~is_start)
    ordinals = F.when(is_start, F.col("ordinals")).otherwise(F.array("ordinal"))
    ordinal = F.when(is_start, F.col("rank")).otherwise(F.col("ordinal"))
    return seen.withColumn("ordinals", ordinals).withColumn("ordinal", ordinal).drop("copy", "rank")


def starts_of_all(timeline: DataFrame, has_wide: bool = True) -> DataFrame:
    """A numbered timeline in which every user of a visit has the starts of all its users.

    A start has its place in the timeline of each user it was recorded for: `ordinals` lists them, so
    a click of one user can be adjacent to a start in the timeline of another. `ordinal` of a start
    orders the starts at one position, by attribute, container, placement, content, series and brand.
    """
    if not has_wide:
        return _starts_at_hand(timeline)
    is_start = F.col("kind") == "start"
    clicks = timeline.filter(~is_start).withColumn("ordinals", F.array("ordinal"))
    event = START
    place = [*SHARED_VISIT, "block", "wide", "event_position"]
    starts = (
        timeline.filter(is_start)
        .groupBy(*place, *event)
        .agg(F.collect_set("ordinal").alias("ordinals"))
        .withColumn("ordinal", F.row_number().over(Window.partitionBy(*place).orderBy(*event)).cast("long"))
        .withColumn("kind", F.lit("start"))
    )
    return clicks.unionByName(seen_by_all(starts, clicks), allowMissingColumns=True)


def link_clicks_to_starts(
    timeline: DataFrame,
    has_wide: bool = True,
    drop_backward_only: bool = True,
    across_users: bool = False,
    apart: tuple[str, ...] = (),
) -> DataFrame:
    """Clicks of a numbered timeline, each with the start it led to.

    With `across_users` the start may be any user's of the visit, as in the reference, whose join leaves
    the user out. Ordinals and the choice of the nearest remain each user's own. `apart` names columns
    that keep timelines apart (`both_timelines`).
    """
    if across_users:
        if apart:
            raise ValueError("links across users are made for one variant at a time")
        timeline = starts_of_all(timeline, has_wide)
    is_right = F.col("kind") == "start"
    event = F.struct("attribute", "container", "placement", "content_id")
    ordinal = F.col("ordinal")
    ordinals = F.col("ordinals") if across_users else F.array(ordinal)
    rows = timeline.select(
        *GROUP,
        *apart,
        F.col("event_position").alias("position"),
        F.explode(F.when(is_right, start_keys(ordinals)).otherwise(F.array(click_keys(ordinal)))).alias("key"),
        is_right.alias("is_right"),
        ordinal.alias("tie"),
        F.when(~is_right, event).alias("left"),
        F.when(is_right, event).alias("right"),
    )
    linked = link_nearest(rows, has_wide, drop_backward_only, apart)
    return linked.select(
        *USER_VISIT,
        "wide",
        *apart,
        F.col("position").alias("click_event_position"),
        F.col("left.attribute").alias("click_attribute"),
        F.col("left.container").alias("click_container"),
        F.col("left.placement").alias("click_placement"),
        F.col("left.content_id").alias("click_id"),
        fn.fill_flag(F.col("right.attribute"), "no-start-flag").alias("content_attribute"),
        F.col("right.placement").alias("content_placement"),
        F.col("right.content_id").alias("content_id"),
        F.col("right_position").alias("content_start_event_position"),
    )


def link_starts_to_completes(
    clicks: DataFrame,
    completes: DataFrame,
    block_size: int,
    has_wide: bool = True,
    drop_backward_only: bool = True,
    across_users: bool = False,
    variants: tuple[str, ...] = (),
) -> DataFrame:
    """Linked clicks, each with the complete of the content it started.

    Clicks without a start have no content id, so they match nothing and pass through. With
    `across_users` the complete may be any user's of the visit. With `variants` the clicks are of several
    variants (column `variant`), and each of them sees all completes.
    """
    apart = ("variant",) if variants else ()
    if across_users:
        once = [*SHARED_VISIT, "block", "wide", "event_position", "attribute", "content_id"]
        completes = completes.select(*once).distinct()
        if has_wide:
            completes = seen_by_all(completes, clicks)
        else:
            completes = completes.withColumn("hid", F.lit(None).cast("string"))
    carried = [x for x in clicks.columns if x not in (*USER_VISIT, "wide", *apart)]
    started = F.coalesce("content_start_event_position", "click_event_position")
    block = block_of(started, block_size) if has_wide else F.lit(0).cast("long")
    left = clicks.select(
        *USER_VISIT,
        "wide",
        block.alias("block"),
        *apart,
        started.alias("position"),
        F.col("content_id").alias("key"),
        F.lit(False).alias("is_right"),
        F.col("click_event_position").alias("tie"),
        F.struct(*carried).alias("left"),
    )
    right = completes.filter(F.col("content_id").isNotNull()).select(
        *GROUP,
        F.col("event_position").alias("position"),
        F.col("content_id").alias("key"),
        F.lit(True).alias("is_right"),
        F.col("event_position").alias("tie"),
        F.struct("attribute").alias("right"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    if not has_wide and across_users:
        both = seen_at_hand(both.repartition(*SHARED_VISIT), ~F.col("is_right"))
    elif not has_wide:
        both = both.repartition(*USER_VISIT, "block")
    if variants:
        # Completes are doubled behind the exchange.
        each = F.when(F.col("is_right"), F.array(*[F.lit(x) for x in variants])).otherwise(F.array("variant"))
        both = both.withColumn("variant", F.explode(each))
    linked = link_nearest(both, has_wide, drop_backward_only, apart)
    return linked.select(
        *USER_VISIT,
        "wide",
        *apart,
        *[F.col(f"left.{x}").alias(x) for x in carried],
        fn.fill_flag(F.col("right.attribute"), "no-watched-flag").alias("watched_flag"),
        F.col("right_position").alias("content_watched_event_position"),
    )


FINAL = [
    "dt",
    "cookie_id",
    "hid",
    "frequency_band",
    "frequency_group",
    "visit_id",
    "click_event_position",
    "click_container",
    "click_placement",
    "content_placement",
    "content_id",
    "content_start_event_position",
    "content_watched_event_position",
    "start_flag",
    "watched_flag",
    "platform",
    "age_range",
]


def enrich(linked: DataFrame, population: DataFrame, block_size: int, has_wide: bool = True) -> DataFrame:
    """Attach user attributes on (dt, user, visit) and turn the flags into 0/1.

    The key leaves out the cookie, as in the reference: a visit with two population rows gives two
    rows per click. `dedupe_population` prevents that. A column `variant` is kept.
    """
    key = ["dt", "hid", "visit_id"]
    attributes = [
        x
        for x in ("frequency_band", "frequency_group", "platform", "age_range", "exp_group")
        if x in population.columns
    ]
    users = population.select(*key, *attributes, F.col("cookie_id").alias("_cookie"), "destination").distinct()
    block = block_of(F.col("click_event_position"), block_size)
    rows = linked.drop("wide").withColumn("block", block if has_wide else F.lit(0).cast("long"))
    if has_wide:
        blocks = linked.select(*key, block.alias("block")).distinct()
        users = users.join(blocks, key)
    else:
        users = users.withColumn("block", F.lit(0).cast("long"))
    joined = rows.join(users, [*key, "block"], "left")
    flags = {
        "start_flag": fn.flag_to_int(F.col("content_attribute"), c.START_ATTRIBUTE),
        "watched_flag": fn.flag_to_int(F.col("watched_flag"), c.COMPLETE_ATTRIBUTE),
    }
    return joined.withColumns(flags).select(
        *FINAL, *[x for x in ("exp_group", "variant") if x in joined.columns]
    )
