"""Column expressions: classifiers, extractors and event predicates. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c

# Page types by placement pattern, first match wins. The coding of the tracked product is not
# public, so this is a default a caller can replace by rules or by a mapping table.
PAGE_TYPE_RULES = (
    ("%tleo%", "tleo_page"),
    ("%episode%", "episode_page"),
    ("%playback%", "episode_page"),
    ("%.tv.page", "homepage"),
    ("%watching%", "watching_page"),
)

# Frequency bands to coarser groups; NULL (no band yet) has a group of its own.
FREQUENCY_GROUPS = {
    "A. Daily": "heavy",
    "B. Most days": "heavy",
    "C. Weekly": "medium",
    "D. Monthly": "light",
}


def platform_of(app_type: Column) -> Column:
    return (
        F.when(app_type.ilike("%bigscreen-html%"), "bigscreen")
        .when(app_type.ilike("%responsive%"), "web")
        .otherwise("unknown")
    )


def trackable(app_type: Column) -> Column:
    """TV and web only: other apps send too little to follow a journey."""
    return app_type.ilike("%bigscreen-html%") | app_type.ilike("%responsive%")


def age_band(age: Column) -> Column:
    return (
        F.when(age >= 35, "35+")
        .when(age <= 10, "under 10")
        .when(age.between(11, 15), "11-15")
        .when(age.between(16, 24), "16-24")
        .when(age.between(25, 34), "25-34")
        .otherwise("unknown")
    )


def frequency_band(band: Column) -> Column:
    return F.coalesce(band, F.lit("new"))


def frequency_group(band: Column, groups: dict[str, str] | None = None) -> Column:
    """Group of the raw band; a NULL band is 'new', an unlisted one 'other'."""
    expr = F.when(band.isNull(), "new")
    for value, group in (groups or FREQUENCY_GROUPS).items():
        expr = expr.when(band == value, group)
    return expr.otherwise("other")


def normalise_container(container: Column) -> Column:
    return F.when(container.ilike(f"%{c.LIKED_MODULE}%"), c.LIKED_MODULE).otherwise(container)


def episode_from_placement(placement: Column) -> Column:
    """The eight characters before the five-character page suffix, if one of them is a digit."""
    part = F.left(F.right(placement, F.lit(13)), F.lit(8))
    return F.when(part.rlike("[0-9]"), part).otherwise(c.NO_EPISODE)


def content_from_url(url: Column) -> Column:
    """Last programme id in a playback URL: '' if it has none, 'unknown' for any other URL."""
    last_id = F.regexp_extract(url, r"(?s)^.*/([pbwnmlc][0-9][A-Za-z0-9]{6})", 1)
    return F.when(url.ilike("%/playback%"), last_id).otherwise(c.UNKNOWN)


def flag_to_int(flag: Column, value: str) -> Column:
    return F.when(flag == value, 1).otherwise(0)


def fill_flag(flag: Column, sentinel: str) -> Column:
    return F.coalesce(flag, F.lit(sentinel))


def playback_group(container: Column) -> Column:
    return F.when(container.ilike("%rec%"), "rec").otherwise("next-episode")


def page_type(placement: Column, rules=PAGE_TYPE_RULES) -> Column:
    """First rule whose pattern matches, else 'other' (also for NULL)."""
    expr = F
    for pattern, kind in rules:
        expr = expr.when(placement.ilike(pattern), kind)
    return expr.otherwise("other")


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def is_standard_click(attribute: Column, is_click: Column) -> Column:
    named = any_of([attribute.startswith(p) for p in c.CLICK_PREFIXES]) | attribute.isin(*c.CLICK_ATTRIBUTES)
    return named & (is_click == 1)


def is_off_title_page(placement: Column) -> Column:
    """Not a title page; a NULL placement is dropped too."""
    return ~placement.ilike("%tleo%")


def is_autoplay_click(attribute: Column, is_click: Column) -> Column:
    return any_of([attribute.contains(p) for p in c.AUTOPLAY_PARTS]) & (is_click == 1)


def is_web_autoplay(attribute: Column, is_click: Column, is_impression: Column) -> Column:
    """The web player sends no autoplay click: the finished countdown impression stands in for it."""
    return (attribute.contains(c.PANEL_COMPLETE) & (is_impression == 1)) | (
        attribute.contains(c.PANEL_SELECT) & (is_click == 1)
    )


def is_start(attribute: Column, is_impression: Column) -> Column:
    return (attribute == c.START_ATTRIBUTE) & (is_impression == 1)


def is_complete(attribute: Column, is_impression: Column) -> Column:
    return (attribute == c.COMPLETE_ATTRIBUTE) & (is_impression == 1)


def is_home_impression(placement: Column, is_impression: Column) -> Column:
    return (placement == c.HOME_PLACEMENT) & (is_impression == 1)


def week_of(dt: Column) -> Column:
    """Monday of a `yyyyMMdd` string."""
    return F.to_date(F.date_trunc("week", F.to_date(dt, "yyyyMMdd")))
