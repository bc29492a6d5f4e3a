"""Settings and fixed values of the journey operators."""

from __future__ import annotations

from dataclasses import dataclass

# Strings carried by the tracked data.
PRODUCT = "PS_IPLAYER"
HOME_PLACEMENT = "iplayer.tv.page"
RECOMMENDATIONS_PAGE = "iplayer.tv.recommendations.page"
WATCHING_PAGE = "watching_page"
TITLE_PAGE = "tleo_page"
EPISODE_PAGE = "episode_page"
START_ATTRIBUTE = "iplxp-ep-started"
COMPLETE_ATTRIBUTE = "iplxp-ep-watched"
RECOMMENDED_MODULE = "module-recommendations-recommended-for-you"
CONTINUE_MODULE = "module-watching-continue-watching"
LIKED_MODULE = "module-if-you-liked"
HOME_MODULES = (RECOMMENDED_MODULE, CONTINUE_MODULE, LIKED_MODULE)
MOBILE_APP = "mobile-app"
UNKNOWN = "unknown"
NO_EPISODE = "none"
DEEPLINK = "deeplink"

# Which attributes count as a click to content.
CLICK_PREFIXES = ("content-item", "start-watching")
CLICK_ATTRIBUTES = ("resume", "next-episode", "search-result-episode~click", "page-section-related~select")
AUTOPLAY_PARTS = ("squeeze-auto-play", "squeeze-play", "end-play", "end-auto-play", "select-play")
PANEL_COMPLETE = "onward-journey-panel~complete"
PANEL_SELECT = "onward-journey-panel~select"

# Columns that identify a visit of one signed-in user.
VISIT = ("dt", "cookie_id", "hid", "visit_id")


@dataclass(frozen=True)
class DateWindow:
    """Inclusive range of `dt` partition values, `yyyyMMdd`."""

    first: str
    last: str


@dataclass(frozen=True)
class Settings:
    """What a caller may change; the defaults give the reference results.

    block_size     width, in event positions, of the slices a visit is cut into, so that
                   no task ever holds more than one slice of one visit
    lookup_rows    a lookup table is broadcast only if it has at most this many rows (and 64 MB)
    hot_rows       a join key with more rows than this is spread over `salts` tasks
    drop_backward_only  drop clicks whose matching starts all come earlier
    link_across_users   link a click to starts and completes of other users of its visit, as the reference does
    keep_unsegmented    keep users without a frequency row for the week, as 'new'
    frequency_groups    (band, group) pairs in place of the default grouping
    """

    window: DateWindow
    product: str = PRODUCT
    block_size: int = 10_000
    lookup_rows: int = 1_000_000
    hot_rows: int = 1_000_000
    salts: int = 64
    drop_backward_only: bool = True
    link_across_users: bool = False
    keep_unsegmented: bool = False
    frequency_groups: tuple[tuple[str, str], ...] = ()
