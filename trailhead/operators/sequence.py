"""Hops "entry page, (title page,) content" in the page sequence of a visit, and runs of pages in it.

Most functions take one row per page, so a visit may have any number of pages: it is searched in blocks that overlap by
the length of what is looked for, and what a block has to know of earlier ones is added up per visit. `page_rows` makes such
rows from visits with '|'-delimited strings. `extract_hops` takes those strings as they are and works inside the row on
arrays, with no shuffle; it reports the same hops and is meant for visits that fit into a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import classify as fn
from ..sources.stages import materialise
from .skew import block_of

DELIMITER = "|"
VISIT = ("app_type", "dt", "visit_id", "hid")


@dataclass(frozen=True)
class HopPattern:
    """What to look for.

    sequence   column with the page tokens
    entry      names of the entry page
    then       for each following page, a name (exact) or a piece of it (with `guard`)
    guard      True: every visit to the entry page counts, and the first one not followed by `then`
               ends the search; False: only full matches count
    rounds     hops that chopping the strings reports per visit (`compat` only; `exact` reports all)
    """

    sequence: str
    entry: tuple[str, ...]
    then: tuple[str, ...]
    guard: bool
    rounds: int

    @property
    def page(self) -> str:
        """The column with the token of one page, in page rows."""
        return self.sequence.removesuffix("_sequence")

    @property
    def distance(self) -> int:
        """Pages from the entry page to the content page."""
        return len(self.then)

    @property
    def consumed(self) -> int:
        """Pages the pattern itself covers."""
        return 1 if self.guard else 1 + len(self.then)


RECOMMENDATIONS_DIRECT = HopPattern("page_name_sequence", (c.RECOMMENDATIONS_PAGE,), ("episode",), True, 5)
RECOMMENDATIONS_VIA_TITLE = HopPattern(
    "page_name_sequence", (c.RECOMMENDATIONS_PAGE,), ("tleo", "episode"), True, 2
)
WATCHING_DIRECT = HopPattern("page_sequence", (c.WATCHING_PAGE,), (c.EPISODE_PAGE,), False, 5)
WATCHING_VIA_TITLE = HopPattern("page_sequence", (c.WATCHING_PAGE,), (c.TITLE_PAGE, c.EPISODE_PAGE), False, 2)


def tokens(sequence: Column) -> Column:
    return F.split(sequence, r"\|", -1)


def _at(array: Column, index: Column) -> Column:
    """The element at a 1-based index; NULL outside the array."""
    return F.when(index >= 1, F.get(array, (index - 1).cast("int")))


def _followed(pages: Column, at: Column, pattern: HopPattern) -> Column:
    """Whether the pages after position `at` are those of the pattern."""
    result = F.lit(True)
    for step, name in enumerate(pattern.then, start=1):
        page = _at(pages, at + step)
        result = result & (page.ilike(f"%{name}%") if pattern.guard else page == name)
    return F.coalesce(result, F.lit(False))


def _entries(pages: Column, pattern: HopPattern) -> Column:
    """1-based positions of the entry page."""
    return F.array_compact(F.transform(pages, lambda page, i: F.when(page.isin(*pattern.entry), i + 1)))


def _matches(pages: Column, entries: Column, pattern: HopPattern) -> Column:
    """The entry positions that start a hop."""
    if pattern.guard:
        first_miss = F.array_position(F.transform(entries, lambda i: _followed(pages, i, pattern)), False)
        good = F.when(first_miss == 0, F.size(entries)).otherwise(first_miss - 1)
        return F.slice(entries, F.lit(1), good.cast("int"))
    return F.filter(entries, lambda i: _followed(pages, i, pattern))


def eligible(journeys: DataFrame) -> DataFrame:
    """Everything but the mobile app, which is not tracked well enough."""
    return journeys.filter(F.col("app_type") != c.MOBILE_APP)


def extract_hops(
    journeys: DataFrame,
    patterns: HopPattern | dict[str, HopPattern],
    mode: str = "exact",
) -> DataFrame:
    """One row per hop: hop number, entry page, content page and content id.

    Several named patterns are searched in the same pass; the name is then in the column `family`.
    `exact` reports true page numbers and the id at the content page. `compat` reports what chopping the
    strings hop by hop yields, where from the second hop on pages and ids may be off, and where a hop to
    the last page reports the previous id, and only the first `rounds` hops of a visit are reported.
    """
    if mode not in ("exact", "compat"):
        raise ValueError(f"unknown mode: {mode}")
    named = patterns if isinstance(patterns, dict) else {"": patterns}
    visits = eligible(journeys)
    visit = list(VISIT)
    # Each array is a column of its own before it is searched, so it is made once per visit.
    split = visits.select(
        *visit,
        tokens(F.col("content_id_sequence")).alias("ids"),
        *[tokens(F.col(x)).alias(x) for x in sorted({p.sequence for p in named.values()})],
    )
    entered = split.withColumns({f"in_{n}": _entries(F.col(p.sequence), p) for n, p in enumerate(named.values())})
    found_at = [_matches(F.col(p.sequence), F.col(f"in_{n}"), p) for n, p in enumerate(named.values())]
    if mode == "compat":
        found_at = [F.slice(x, 1, p.rounds) for x, p in zip(found_at, named.values())]
    matched = entered.select(*visit, "ids", *[x.alias(f"at_{n}") for n, x in enumerate(found_at)])
    found = [_described(name, p, F.col(f"at_{n}")) for n, (name, p) in enumerate(named.items())]
    entry, content, content_id = _exact() if mode == "exact" else _compat()
    hops = matched.select(*visit, "ids", F.inline(F.concat(*found))).select(
        *visit,
        "family",
        (F.col("before") + 1).alias("hop"),
        entry.cast("int").alias("entry_page_num"),
        content.cast("int").alias("content_page_num"),
        content_id.alias("content_id"),
    )
    return hops if isinstance(patterns, dict) else hops.drop("family")


def page_rows(journeys: DataFrame) -> DataFrame:
    """One row per page of visits given as delimited strings: their other columns, page_count, page_name, page, content_id."""
    strings = {"page_name_sequence": "page_name", "page_sequence": "page", "content_id_sequence": "content_id"}
    others = [x for x in journeys.columns if x not in strings]
    pages = F.arrays_zip(*[tokens(F.col(x)).alias(y) for x, y in strings.items()])
    split = journeys.select(*others, F.posexplode(pages).alias("n", "at"))
    return split.select(*others, (F.col("n") + 1).alias("page_count"), *[f"at.{x}" for x in strings.values()])


def _blocks(pages: DataFrame, columns: list[str], ahead: int, block_size: int) -> tuple[DataFrame, Window]:
    """Rows of pages dealt to blocks, each also holding the first `ahead` pages of the next; own is a page's own block."""
    at = F.col("page_count")
    own = block_of(at - 1, block_size)
    spread = (
        pages.select(*VISIT, "page_count", *columns)
        .withColumn("own", own)
        .withColumn("block", F.explode(F.sequence(block_of(at - 1 - ahead, block_size), own)))
    )
    return spread, Window.partitionBy(*VISIT, "block").orderBy("page_count")


def _same_visit(prefix: str, *more: str) -> Column:
    """Equal visit (and more) columns here and with a prefix; null user ids are equal."""
    return reduce(and_, [F.col(x).eqNullSafe(F.col(f"{prefix}{x}")) for x in (*VISIT, *more)])


def _prefixed(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.withColumnsRenamed({x: f"{prefix}{x}" for x in names})


def page_hops(
    pages: DataFrame, patterns: HopPattern | dict[str, HopPattern], block_size: int, mode: str = "exact"
) -> DataFrame:
    """The hops of `extract_hops`, from rows of the visit columns, page_count (from 1, without gaps), page_name, page
    and content_id.

    Visits are searched in blocks of `block_size` pages. The first pages of a block are also the last ones of the
    block before, where a hop may end. The hops and the misses of earlier blocks are added up per visit; results
    are the same for any block size.
    """
    if mode not in ("exact", "compat"):
        raise ValueError(f"unknown mode: {mode}")
    named = patterns if isinstance(patterns, dict) else {"": patterns}
    hops = _page_hops(eligible(pages), named, block_size)
    if mode == "compat":
        hops = _chopped(eligible(pages), hops, named)
    return hops if isinstance(patterns, dict) else hops.drop("family")


def _chopped(pages: DataFrame, hops: DataFrame, named: dict[str, HopPattern]) -> DataFrame:
    """What chopping the strings reports of these hops: see `_compat`, here with joins in place of arrays.

    Only the few hops of the rounds remain of a visit; the ids are looked up by visit and page.
    """

    def of_family(value) -> Column:
        return F.coalesce(*[F.when(F.col("family") == name, F.lit(value(p))) for name, p in named.items()])

    ordered = Window.partitionBy(*VISIT, "family").orderBy("hop")
    lasts = _prefixed(pages.groupBy(*VISIT).agg(F.max("page_count").alias("last")), "_", *VISIT)
    kept = (
        hops.filter(F.col("hop") <= of_family(lambda p: p.rounds))
        .withColumns({
            "distance": of_family(lambda p: p.distance), "consumed": of_family(lambda p: p.consumed),
            "before": F.col("hop") - 1, "at": F.col("entry_page_num"), "previous": F.lag("entry_page_num").over(ordered),
        })
        .join(lasts, _same_visit("_"))
    )
    wanted, begin = _compat_tokens()
    place = F.when(F.col("wanted") < F.col("last"), F.col("wanted")).otherwise(F.col("begin"))
    kept = kept.withColumns({"wanted": wanted, "begin": begin}).withColumn("place", place)
    ids = pages.select(*[F.col(x).alias(f"p_{x}") for x in VISIT], F.col("page_count").alias("p_place"), F.col("content_id").alias("id"))
    nothing_left = (F.col("wanted") >= F.col("last")) & (F.col("begin") == F.col("last"))
    entry, content = _compat_pages()
    return kept.join(ids, _same_visit("p_", "place"), "left").select(
        *VISIT,
        "family",
        "hop",
        entry.cast("int").alias("entry_page_num"),
        content.cast("int").alias("content_page_num"),
        F.when(nothing_left, "").otherwise(F.col("id")).alias("content_id"),
    )


def _page_hops(pages: DataFrame, named: dict[str, HopPattern], block_size: int) -> DataFrame:
    at = F.col("page_count")
    columns = ["content_id", *sorted({p.page for p in named.values()})]
    spread, in_block = _blocks(pages, columns, max(p.distance for p in named.values()), block_size)

    def coming(column: str, step: int) -> Column:
        return F.lead(column, step).over(in_block)

    def entry(name: str, pattern: HopPattern) -> Column:
        followed = F.lit(True)
        for step, then in enumerate(pattern.then, start=1):
            page = coming(pattern.page, step)
            followed = followed & (page.ilike(f"%{then}%") if pattern.guard else page == then)
        followed = F.coalesce(followed, F.lit(False))
        return F.when(
            F.col(pattern.page).isin(*pattern.entry) & (F.lit(pattern.guard) | followed),
            F.struct(
                F.lit(name).alias("family"),
                followed.alias("good"),
                at.alias("entry_page_num"),
                (at + pattern.distance).alias("content_page_num"),
                coming("content_id", pattern.distance).alias("content_id"),
            ),
        )

    # Each entry is a column of its own before its block's copies of later pages are dropped.
    searched = spread.withColumns({f"at_{n}": entry(name, p) for n, (name, p) in enumerate(named.items())})
    entries = (
        searched.filter("block = own")
        .select(*VISIT, "block", F.explode(F.array_compact(F.array(*[f"at_{n}" for n in range(len(named))]))).alias("at"))
        .select(*VISIT, "block", "at.*")
    )
    # Written once: few of all pages, read for the hops and for what a block must know of earlier ones.
    entries = materialise(entries, "entries")
    hits, misses = F.col("good").cast("long"), (~F.col("good")).cast("long")
    key = [*VISIT, "family"]
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        entries.groupBy(*key, "block")
        .agg(F.sum(hits).alias("hits"), F.sum(misses).alias("misses"))
        .select(*key, "block", F.sum("hits").over(earlier).alias("hits"), F.sum("misses").over(earlier).alias("misses"))
        .filter("hits IS NOT NULL")  # none for the first block, and so for visits of one block
        .toDF(*[f"_{x}" for x in key], "_block", "hits", "misses")
    )
    same = reduce(and_, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in (*key, "block")])
    upto = Window.partitionBy(*VISIT, "block", "family").orderBy("entry_page_num").rowsBetween(Window.unboundedPreceding, 0)
    hops = (
        entries.withColumns({"hop": F.sum(hits).over(upto), "missed": F.sum(misses).over(upto)})
        .join(before, same, "left")
        .filter(F.col("missed") + F.coalesce("misses", F.lit(0)) == 0)
        .select(
            *VISIT,
            "family",
            (F.col("hop") + F.coalesce("hits", F.lit(0))).cast("int").alias("hop"),
            F.col("entry_page_num").cast("int").alias("entry_page_num"),
            F.col("content_page_num").cast("int").alias("content_page_num"),
            "content_id",
        )
    )
    return hops


def _described(name: str, pattern: HopPattern, positions: Column) -> Column:
    """The matches of one pattern, with what is needed to report them."""
    return F.transform(
        positions,
        lambda at, before: F.struct(
            F.lit(name).alias("family"),
            F.lit(pattern.distance).alias("distance"),
            F.lit(pattern.consumed).alias("consumed"),
            before.alias("before"),
            at.alias("at"),
            _at(positions, before).alias("previous"),
        ),
    )


def _exact() -> tuple[Column, Column, Column]:
    content = F.col("at") + F.col("distance")
    return F.col("at"), content, _at(F.col("ids"), content)


def _compat_pages() -> tuple[Column, Column]:
    """Entry and content page as chopping the strings counts them."""
    entry = F.col("at") - F.col("before") * (F.col("consumed") - 1)
    return entry, entry + (F.col("before") + 1) * F.col("distance")


def _compat_tokens() -> tuple[Column, Column]:
    """The id that is looked for, and where the ids still left begin: at the previous hop's, at first with the first."""
    distance, consumed, before = F.col("distance"), F.col("consumed"), F.col("before")

    def token(at: Column, earlier: Column) -> Column:
        return at + distance + earlier * (distance - consumed)

    return token(F.col("at"), before), F.when(before == 0, F.lit(1)).otherwise(token(F.col("previous"), before - 1))


def _compat() -> tuple[Column, Column, Column]:
    ids, (wanted, begin) = F.col("ids"), _compat_tokens()
    last_page = F.when(begin == F.size(ids), "").otherwise(_at(ids, begin))
    return *_compat_pages(), F.when(wanted >= F.size(ids), last_page).otherwise(_at(ids, wanted))


def hop_outcomes(hops: DataFrame, outcomes: DataFrame, label: str) -> DataFrame:
    """Distinct hops with the 0/1 start and complete flags of the content they led to."""
    key = ["dt", "visit_id", "content_id"]
    distinct = hops.select(
        "app_type", "dt", "visit_id", "hid", "entry_page_num", "content_page_num", "content_id"
    ).distinct()
    facts = outcomes.select(
        *key, F.col("page_count").alias("content_page_num"), "start_flag", "watched_flag"
    )
    return distinct.join(facts, [*key, "content_page_num"], "left").select(
        *distinct.columns,
        F.lit(label).alias("click_placement"),
        fn.flag_to_int(F.col("start_flag"), c.START_ATTRIBUTE).alias("start_flag"),
        fn.flag_to_int(F.col("watched_flag"), c.COMPLETE_ATTRIBUTE).alias("watched_flag"),
    )


def runs_of_pages(pages: DataFrame, column: str, names: tuple[str, ...], block_size: int) -> DataFrame:
    """The visit columns, page_count, block and, in `found`, whether pages of these names follow one another from there on."""
    spread, in_block = _blocks(pages, [column], len(names) - 1, block_size)
    found = F.lit(True)
    for step, name in enumerate(names):
        page = F.lead(column, step).over(in_block) if step else F.col(column)
        found = found & (page == name)
    searched = spread.withColumn("found", F.coalesce(found, F.lit(False)))
    return searched.filter("block = own").select(*VISIT, "page_count", "block", column, "found")


def _has_border(names: tuple[str, ...]) -> bool:
    """Whether two runs of these names can overlap."""
    return any(names[:n] == names[-n:] for n in range(1, len(names)))


def count_runs(pages: DataFrame, column: str, names: tuple[str, ...], block_size: int, containing: str | None = None) -> DataFrame:
    """Per visit, how many runs of pages with these names follow one another without sharing a page (`times`).

    Without `containing`, only visits with a run; with it, those that have a page with that piece in its name.

    Where runs can overlap, the first is taken, then the first one after its end, and so on. What a block takes depends
    on how many of its first pages a run from the block before covers; it is worked out for each such number, and
    the blocks of a visit are then put together in their order.
    """
    rows = runs_of_pages(pages, column, names, block_size)
    if containing is not None:
        shown = F.col(column).ilike(f"%{containing}%")
    else:
        shown = F.col("found")
    visits = rows.groupBy(*VISIT).agg(
        F.coalesce(F.bool_or(shown), F.lit(False)).alias("shown"), F.sum(F.col("found").cast("long")).alias("times")
    ).filter("shown").drop("shown")
    if not _has_border(names):
        return visits
    length = len(names)
    if block_size < length:
        raise ValueError("a block must hold a run")

    def taken(covered: int) -> Column:
        begin = (F.col("block") * block_size + 1).cast("long")
        zero = F.struct(F.lit(0).cast("long").alias("times"), (begin + covered).alias("free"))

        def step(state: Column, at: Column) -> Column:
            free = at >= state["free"]
            return F.struct(
                (state["times"] + free.cast("long")).alias("times"), F.when(free, at + length).otherwise(state["free"]).alias("free")
            )

        return F.aggregate(
            "places", zero, step,
            lambda x: F.struct(x["times"].alias("times"), F.greatest(x["free"] - begin - block_size, F.lit(0)).alias("covers")),
        )

    by_block = (
        rows.filter("found")
        .groupBy(*VISIT, "block")
        .agg(F.sort_array(F.collect_list(F.col("page_count").cast("long"))).alias("places"))  # at most a block
        .select(*VISIT, F.struct("block", F.array(*[taken(n) for n in range(length)]).alias("taken")).alias("part"))
    )
    zero = F.struct(F.lit(0).cast("long").alias("times"), F.lit(0).cast("long").alias("covers"), F.lit(-2).cast("long").alias("block"))

    def join(state: Column, part: Column) -> Column:
        covered = F.when(part["block"] == state["block"] + 1, state["covers"]).otherwise(F.lit(0))
        here = F.get(part["taken"], covered.cast("int"))
        return F.struct(
            (state["times"] + here["times"]).alias("times"), here["covers"].alias("covers"), part["block"].cast("long").alias("block")
        )

    counted = by_block.groupBy(*VISIT).agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        *[F.col(x).alias(f"_{x}") for x in VISIT], F.aggregate("parts", zero, join, lambda x: x["times"]).alias("counted")
    )
    return visits.join(counted, _same_visit("_"), "left").select(*VISIT, F.coalesce("counted", F.lit(0)).alias("times"))


def run_histogram(pages: DataFrame, column: str, names: tuple[str, ...], block_size: int, containing: str | None = None) -> DataFrame:
    """Visits by how often the run occurs in them; see `count_runs`."""
    counted = count_runs(pages, column, names, block_size, containing)
    return counted.groupBy(F.col("times").alias("num_time_page_occurs")).agg(F.count("visit_id").alias("num_visits"))


def short_visits(pages: DataFrame, page: str, most_pages: int = 3, limit: int | None = None) -> DataFrame:
    """App type and pages of visits that have a page with this piece in its name and at most so many pages.

    With `limit`, the first ones by date, visit and user. Of a longer visit nothing but its length is kept.
    """
    names = [F.max(F.when(F.col("page_count") == n + 1, F.col("page_name"))).alias(f"name_{n}") for n in range(most_pages)]
    visits = (
        pages.groupBy(*VISIT)
        .agg(F.count("*").alias("n"), F.bool_or(F.col("page_name").ilike(f"%{page}%")).alias("has"), *names)
        .filter((F.col("n") <= most_pages) & F.col("has"))
    )
    if limit is not None:
        visits = visits.orderBy("dt", "visit_id", "hid", "app_type").limit(limit)
    sequence = F.concat_ws(DELIMITER, *[f"name_{n}" for n in range(most_pages)])
    return visits.select("app_type", sequence.alias("page_name_sequence"))


def pages_from(
    pages: DataFrame, column: str, names: tuple[str, ...], block_size: int, limit: int | None = None
) -> DataFrame:
    """dt, visit_id, step (from 1) and page: the pages of each visit from the first run of these names on.

    With `limit`, of the first visits by date, visit and user. Visits meet their first run block by block.
    """
    rows = runs_of_pages(pages, column, names, block_size)
    visits = rows.groupBy(*VISIT).agg(
        F.min(F.when(F.col("found"), F.col("page_count"))).alias("first"), F.max("page_count").alias("last")
    ).filter("first IS NOT NULL")
    if limit is not None:
        visits = visits.orderBy("dt", "visit_id", "hid", "app_type").limit(limit)
    blocks = F.sequence(block_of(F.col("first") - 1, block_size), block_of(F.col("last") - 1, block_size))
    wanted = _prefixed(visits.withColumn("block", F.explode(blocks)).drop("last"), "_", *VISIT, "block")
    own = pages.select(*VISIT, "page_count", F.col(column).alias("page"), block_of(F.col("page_count") - 1, block_size).alias("block"))
    return own.join(wanted, _same_visit("_", "block")).filter(F.col("page_count") >= F.col("first")).select(
        "dt", "visit_id", (F.col("page_count") - F.col("first") + 1).cast("int").alias("step"), "page"
    )
