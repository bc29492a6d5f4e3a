"""The registered queries as plain SQL on the driver tables, written as literally as SQL allows:
candidates are joined and ranked, whereas the Spark side never lists pairs."""

from __future__ import annotations

import re

from trailhead import config as c
from trailhead.sources import driver_tables as d

V = "dt, cookie_id, hid, visit_id"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _same(left: str, right: str, columns: str = V) -> str:
    return " AND ".join(f"{left}.{x.strip()} = {right}.{x.strip()}" for x in columns.split(","))


def _id(prefix: str, number: str) -> str:
    return f"('{prefix}' || lpad(CAST({number} AS VARCHAR), 7, '0'))"


EPISODE = _id("p", "(k % 8)")
WINDOW = f"dt BETWEEN '{d.WINDOW.first}' AND '{d.WINDOW.last}' AND destination = '{c.PRODUCT}'"

PLACEMENT = f"""CASE WHEN (k // 7) % 5 = 1 THEN 'site.tv.tleo.page'
     WHEN (k // 7) % 5 = 2 THEN 'site.tv.episode.' || {EPISODE} || '.page'
     WHEN (k // 7) % 5 = 3 AND k % 2 = 0 THEN '{c.RECOMMENDATIONS_PAGE}'
     WHEN (k // 7) % 5 = 3 AND k % 13 = 0 THEN NULL
     ELSE '{c.HOME_PLACEMENT}' END"""


def _page_type(placement: str) -> str:
    return f"""CASE WHEN {placement} ILIKE '%tleo%' THEN 'tleo_page'
     WHEN {placement} ILIKE '%episode%' THEN 'episode_page'
     WHEN {placement} ILIKE '%playback%' THEN 'episode_page'
     WHEN {placement} ILIKE '%.tv.page' THEN 'homepage'
     WHEN {placement} ILIKE '%watching%' THEN 'watching_page' ELSE 'other' END"""


LIKED = f"CASE WHEN container ILIKE '%{c.LIKED_MODULE}%' THEN '{c.LIKED_MODULE}' ELSE container END"
TOTALS = """count(DISTINCT hid) AS num_si_users, count(visit_id) AS num_clicks,
    CAST(sum(start_flag) AS BIGINT) AS num_starts, CAST(sum(watched_flag) AS BIGINT) AS num_completes"""

CTES: dict[str, str] = {}

CTES["user_weeks"] = f"""SELECT event_id, ts, user_id, event_type,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CAST(date_trunc('week', ts) AS DATE) AS monday,
    strftime(CAST(date_trunc('week', ts) AS DATE) + CAST(user_id % 7 AS INTEGER), '%Y%m%d') AS dt,
    CASE WHEN user_id % 12 = 11 THEN '{d.OTHER_PRODUCT}' ELSE '{c.PRODUCT}' END AS destination,
    'c' || CAST(user_id AS VARCHAR) AS cookie_id, CAST(user_id AS VARCHAR) AS hid,
    CAST(user_id AS VARCHAR) || '-' || strftime(CAST(date_trunc('week', ts) AS DATE), '%Y%m%d') AS visit_id
  FROM events"""
CTES["numbered"] = """SELECT *, row_number() OVER (PARTITION BY user_id, monday ORDER BY ts, event_id)
    AS event_position FROM user_weeks"""
CTES["all_hits"] = f"""SELECT destination, dt, cookie_id, visit_id, event_position,
    {_list(d.CONTAINERS)}[k % 7 + 1] AS container,
    CASE WHEN event_type = 'click' THEN
        CASE WHEN k % 10 < 6 THEN {_list(d.STANDARD_ATTRIBUTES)}[k % 10 + 1]
             WHEN k % 10 = 6 THEN {_list(d.AUTOPLAY_ATTRIBUTES)}[(k // 10) % 5 + 1]
             WHEN k % 10 = 7 THEN 'onward-journey-panel~select'
             WHEN k % 10 = 8 THEN 'content-item~select-play' ELSE 'navigation~select' END
      WHEN event_type = 'view' THEN '{c.START_ATTRIBUTE}'
      WHEN event_type = 'purchase' THEN '{c.COMPLETE_ATTRIBUTE}'
      WHEN k % 5 = 0 THEN 'onward-journey-panel~complete' ELSE 'module~impression' END AS attribute,
    CASE WHEN event_type = 'error' AND k % 2 = 0 THEN '{c.HOME_PLACEMENT}' ELSE {PLACEMENT} END AS placement,
    CASE WHEN event_type IN ('view', 'purchase') THEN {EPISODE}
         WHEN k = 98 THEN '' WHEN k = 97 THEN NULL
         WHEN k // 20 = 4 THEN '{c.UNKNOWN}' WHEN k // 20 = 3 THEN {_id('b', '(k % 8) // 4')}
         WHEN k // 20 = 2 THEN {_id('s', '(k % 8) // 2')} ELSE {EPISODE} END AS result,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
    CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS is_impression
  FROM numbered WHERE event_type <> 'signup'"""
CTES["hits"] = f"SELECT * FROM all_hits WHERE {WINDOW}"
CTES["url_events"] = f"""SELECT * FROM (SELECT destination, dt, cookie_id, visit_id, event_position,
    CASE WHEN k % 4 = 0 THEN 'https://host.example/b0abcdef/playback/' || {EPISODE} || '?deeplink=1'
         WHEN k % 4 = 1 THEN 'https://host.example/Playback/live?deeplink=1'
         WHEN k % 4 = 2 THEN 'https://host.example/title/' || {EPISODE} || '?deeplink=1'
         ELSE 'https://host.example/home' END AS url
  FROM numbered WHERE event_type = 'signup') u WHERE {WINDOW}"""
CTES["platforms"] = f"""SELECT DISTINCT dt, visit_id,
    CASE WHEN app_type ILIKE '%bigscreen-html%' THEN 'bigscreen' ELSE 'web' END AS platform
  FROM (SELECT destination, dt, visit_id, CASE WHEN k % 10 = 0 THEN NULL ELSE
      ['tv|Bigscreen-HTML|1', 'tv|bigscreen-html|2', 'web|responsive', '{c.MOBILE_APP}'][user_id % 4 + 1] END AS app_type
      FROM user_weeks) t
  WHERE {WINDOW} AND (app_type ILIKE '%bigscreen-html%' OR app_type ILIKE '%responsive%')"""
CTES["audiences"] = f"""SELECT DISTINCT dt, cookie_id, visit_id, destination,
    CASE WHEN user_id % 9 <> 8 THEN hid END AS audience_id FROM user_weeks WHERE {WINDOW}"""
CTES["profile"] = """SELECT CAST(c_custkey AS VARCHAR) AS hid,
    CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 60 END AS age FROM customer"""
CTES["frequency"] = """SELECT CAST(c_custkey AS VARCHAR) AS hid,
    ['A. Daily', 'C. Weekly', 'D. Monthly', NULL][c_custkey % 4 + 1] AS frequency_band,
    CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 7 DAY)) AS DATE)
      - CASE WHEN c_custkey % 11 = 10 THEN 364 ELSE 0 END AS week
  FROM customer"""
CTES["arms"] = """SELECT CAST(c_custkey AS VARCHAR) AS hid,
    ['control', 'variation_1', 'variation_2', 'unknown'][(c_custkey // 3) % 4 + 1] AS exp_group FROM customer"""
CTES["catalogue"] = f"""SELECT DISTINCT p_brand AS master_brand_name, lower(p_brand) AS master_brand_id,
    'Brand ' || CAST(p_partkey // 4 AS VARCHAR) AS brand_title, {_id('b', 'p_partkey // 4')} AS brand_id,
    'Series ' || CAST(p_partkey // 2 AS VARCHAR) AS series_title,
    CASE WHEN p_partkey % 8 <> 6 THEN {_id('s', 'p_partkey // 2')} END AS series_id,
    CASE WHEN p_partkey % 8 <> 7 THEN {_id('p', 'p_partkey')} END AS episode_id, p_name AS episode_title, p_type AS genre
  FROM part"""
CTES["visit_platforms"] = """SELECT DISTINCT h.destination, h.dt, h.cookie_id, h.visit_id, p.platform
  FROM hits h JOIN platforms p ON h.dt = p.dt AND h.visit_id = p.visit_id"""
CTES["population"] = """SELECT DISTINCT v.destination, v.dt, v.cookie_id, v.visit_id, v.platform, p.hid,
    coalesce(f.frequency_band, 'new') AS frequency_band,
    CASE WHEN f.frequency_band IS NULL THEN 'new' WHEN f.frequency_band IN ('A. Daily', 'B. Most days') THEN 'heavy'
         WHEN f.frequency_band = 'C. Weekly' THEN 'medium' WHEN f.frequency_band = 'D. Monthly' THEN 'light'
         ELSE 'other' END AS frequency_group,
    CASE WHEN p.age >= 35 THEN '35+' WHEN p.age <= 10 THEN 'under 10' WHEN p.age BETWEEN 11 AND 15 THEN '11-15'
         WHEN p.age BETWEEN 16 AND 24 THEN '16-24' WHEN p.age BETWEEN 25 AND 34 THEN '25-34' ELSE 'unknown' END
         AS age_range,
    coalesce(a.exp_group, 'unknown') AS exp_group
  FROM visit_platforms v
    JOIN audiences b ON v.cookie_id = b.cookie_id AND v.visit_id = b.visit_id AND v.dt = b.dt
        AND v.destination = b.destination
    JOIN profile p ON b.audience_id = p.hid
    JOIN frequency f ON p.hid = f.hid AND CAST(date_trunc('week', strptime(v.dt, '%Y%m%d')) AS DATE) = f.week
    LEFT JOIN arms a ON p.hid = a.hid"""
CTES["frequency_groups"] = """SELECT DISTINCT frequency_band AS band, 'early-' || left(frequency_band, 1) AS name,
    DATE '0001-01-01' AS valid_from, DATE '2024-01-14' AS valid_to FROM frequency WHERE frequency_band < 'D'
  UNION ALL SELECT DISTINCT frequency_band, 'late-' || left(frequency_band, 1), DATE '2024-01-15', DATE '9999-12-31'
    FROM frequency WHERE frequency_band < 'D'"""
CTES["module_impressions"] = f"""SELECT DISTINCT b.dt, b.cookie_id, b.hid, b.platform, b.age_range, b.visit_id,
    {LIKED} AS container
  FROM hits a JOIN population b ON a.destination = b.destination AND a.dt = b.dt AND a.visit_id = b.visit_id
    AND a.cookie_id = b.cookie_id
  WHERE a.is_impression = 1 AND a.placement = '{c.HOME_PLACEMENT}' AND b.platform = 'web'"""


def _clicks(predicate: str, extra: str = "") -> str:
    return f"""SELECT DISTINCT a.dt, a.cookie_id, b.hid, a.visit_id, a.event_position, {LIKED} AS container,
    a.attribute, a.placement, a.result AS content_id{extra}
  FROM hits a JOIN population b ON a.dt = b.dt AND a.cookie_id = b.cookie_id AND a.visit_id = b.visit_id
    AND a.destination = b.destination
  WHERE {predicate}"""


CURRENT = """, CASE WHEN regexp_matches(left(right(a.placement, 13), 8), '[0-9]')
    THEN left(right(a.placement, 13), 8) ELSE 'none' END AS current_ep_id"""
STANDARD = f"""({" OR ".join(f"a.attribute LIKE '{p}%'" for p in c.CLICK_PREFIXES)}
    OR a.attribute IN ({_in(c.CLICK_ATTRIBUTES)})) AND a.is_click = 1"""
CTES["standard_b"] = _clicks(STANDARD)
CTES["standard_a"] = _clicks(STANDARD + " AND a.placement NOT ILIKE '%tleo%'")
CTES["autoplay"] = _clicks(
    "(" + " OR ".join(f"a.attribute LIKE '%{p}%'" for p in c.AUTOPLAY_PARTS) + ") AND a.is_click = 1", CURRENT
)
CTES["web_autoplay"] = _clicks(
    f"((a.attribute LIKE '%{c.PANEL_COMPLETE}%' AND a.is_impression = 1) OR "
    f"(a.attribute LIKE '%{c.PANEL_SELECT}%' AND a.is_click = 1))",
    CURRENT,
)
CTES["deeplink"] = f"""SELECT * FROM (SELECT dt, cookie_id, hid, visit_id, event_position,
    CASE WHEN url ILIKE '%/playback%' THEN regexp_extract(url, '^.*/([pbwnmlc][0-9][A-Za-z0-9]{{6}})', 1, 's')
         ELSE '{c.UNKNOWN}' END AS content_id,
    row_number() OVER (PARTITION BY dt, cookie_id, visit_id ORDER BY event_position, hid, url) AS n
  FROM (SELECT DISTINCT a.dt, a.cookie_id, b.hid, a.visit_id, a.event_position, a.url
    FROM url_events a JOIN population b ON a.dt = b.dt AND a.cookie_id = b.cookie_id AND a.visit_id = b.visit_id
      AND a.destination = b.destination WHERE a.url LIKE '%deeplink%') s) t WHERE n = 1"""
CLICK_COLUMNS = f"{V}, event_position, container, attribute, placement, content_id"
for _side in "ab":
    CTES[f"clicks_{_side}"] = f"""SELECT {CLICK_COLUMNS}, 'standard' AS kind FROM standard_{_side}
  UNION ALL SELECT {CLICK_COLUMNS}, 'autoplay' FROM autoplay
  UNION ALL SELECT {CLICK_COLUMNS}, 'web_autoplay' FROM web_autoplay
  UNION ALL SELECT {V}, event_position, '{c.DEEPLINK}', '{c.DEEPLINK}', '{c.DEEPLINK}', content_id, 'deeplink'
    FROM deeplink"""
CTES["starts"] = f"""SELECT DISTINCT a.dt, a.cookie_id, b.hid, a.visit_id, a.event_position, a.container, a.attribute,
    a.placement, a.result AS content_id, coalesce(k.series_id, '{c.UNKNOWN}') AS series_id,
    coalesce(k.brand_id, '{c.UNKNOWN}') AS brand_id
  FROM hits a JOIN population b ON a.cookie_id = b.cookie_id AND a.dt = b.dt AND a.visit_id = b.visit_id
    LEFT JOIN catalogue k ON a.result = k.episode_id
  WHERE a.is_impression = 1 AND a.attribute = '{c.START_ATTRIBUTE}'"""
CTES["completes"] = f"""SELECT DISTINCT a.dt, a.cookie_id, b.hid, a.visit_id, a.event_position, a.container,
    a.attribute, a.placement, a.result AS content_id
  FROM hits a JOIN population b ON a.cookie_id = b.cookie_id AND a.dt = b.dt AND a.visit_id = b.visit_id
  WHERE a.is_impression = 1 AND a.attribute = '{c.COMPLETE_ATTRIBUTE}'"""
for _side in "ab":
    CTES[f"timeline_{_side}"] = f"""SELECT *, row_number() OVER (PARTITION BY {V} ORDER BY event_position,
      (kind = 'start'), attribute NULLS FIRST, container NULLS FIRST, placement NULLS FIRST, content_id NULLS FIRST,
      kind) AS ordinal
    FROM (SELECT {CLICK_COLUMNS}, series_id, brand_id, 'start' AS kind FROM starts
      UNION ALL SELECT {CLICK_COLUMNS}, NULL, NULL, kind FROM clicks_{_side}) t"""
    CTES[f"candidates_{_side}"] = f"""SELECT a.dt, a.cookie_id, a.hid, a.visit_id,
      a.event_position AS click_event_position, a.attribute, a.container, a.placement, a.content_id AS click_id, a.ordinal, s.ordinal AS s_ordinal,
      s.attribute AS s_attribute, s.placement AS s_placement,
      s.content_id AS content_id, s.event_position AS s_position,
      coalesce(s.event_position - a.event_position, 0) AS distance
    FROM (SELECT * FROM timeline_{_side} WHERE kind <> 'start') a
      LEFT JOIN (SELECT * FROM timeline_{_side} WHERE kind = 'start') s ON {_same('a', 's')} AND (
        (a.content_id <> '{c.UNKNOWN}' AND (a.content_id = s.content_id OR (s.content_id IS NOT NULL
          AND a.content_id IN (s.series_id, s.brand_id))))
        OR (a.content_id = '{c.UNKNOWN}' AND a.ordinal = s.ordinal - 1))
    WHERE coalesce(s.event_position - a.event_position, 0) >= 0"""
    _order = "distance, ordinal DESC, s_ordinal"
    CTES[f"ranked_{_side}"] = f"""SELECT *,
      CASE WHEN s_position IS NULL THEN 1 ELSE row_number() OVER (
        PARTITION BY {V}, click_event_position, (s_position IS NULL) ORDER BY {_order}) END AS per_click,
      CASE WHEN s_position IS NULL THEN 1 ELSE row_number() OVER (
        PARTITION BY {V}, s_position ORDER BY {_order}) END AS per_start
    FROM candidates_{_side}"""
    CTES[f"linked_{_side}"] = f"""SELECT {V}, click_event_position, attribute AS click_attribute,
      container AS click_container, placement AS click_placement, click_id,
      CASE WHEN per_start = 1 AND s_position IS NOT NULL THEN s_attribute ELSE 'no-start-flag' END AS content_attribute,
      CASE WHEN per_start = 1 THEN s_placement END AS content_placement,
      CASE WHEN per_start = 1 THEN content_id END AS content_id,
      CASE WHEN per_start = 1 THEN s_position END AS content_start_event_position
    FROM ranked_{_side} WHERE per_click = 1"""
    CTES[f"watch_candidates_{_side}"] = f"""SELECT a.*, w.event_position AS w_position, w.attribute AS w_attribute,
      coalesce(w.event_position - a.content_start_event_position, 0) AS w_distance
    FROM linked_{_side} a LEFT JOIN completes w ON {_same('a', 'w')} AND a.content_id = w.content_id
    WHERE coalesce(w.event_position - a.content_start_event_position, 0) >= 0"""
    CTES[f"watched_{_side}"] = f"""SELECT {V}, click_event_position, click_attribute, click_container,
      click_placement, click_id, content_attribute, content_placement, content_id, content_start_event_position,
      CASE WHEN per_complete = 1 AND w_position IS NOT NULL THEN w_attribute ELSE 'no-watched-flag' END AS watched_flag,
      CASE WHEN per_complete = 1 THEN w_position END AS content_watched_event_position
    FROM (SELECT *,
        CASE WHEN w_position IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {V}, content_start_event_position,
          (w_position IS NULL) ORDER BY w_distance) END AS per_start,
        CASE WHEN w_position IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY {V}, w_position
          ORDER BY w_distance) END AS per_complete
      FROM watch_candidates_{_side}) r WHERE per_start = 1"""
    CTES[f"final_{_side}"] = f"""SELECT a.dt, a.cookie_id, a.hid, b.frequency_band, b.frequency_group, a.visit_id,
      a.click_event_position, a.click_container, a.click_placement, a.content_placement, a.content_id,
      a.content_start_event_position, a.content_watched_event_position,
      CASE WHEN a.content_attribute = '{c.START_ATTRIBUTE}' THEN 1 ELSE 0 END AS start_flag,
      CASE WHEN a.watched_flag = '{c.COMPLETE_ATTRIBUTE}' THEN 1 ELSE 0 END AS watched_flag,
      b.platform, b.age_range, b.exp_group
    FROM watched_{_side} a LEFT JOIN population b ON a.dt = b.dt AND a.hid = b.hid AND a.visit_id = b.visit_id"""
    CTES[f"funnel_{_side}"] = f"""SELECT {_page_type('click_placement')} AS page_type, click_container, {TOTALS}
    FROM final_{_side} GROUP BY 1, 2"""
    CTES[f"home_{_side}"] = f"""SELECT {_page_type('click_placement')} AS page_type, click_container, {TOTALS}
    FROM final_{_side} WHERE click_placement = '{c.HOME_PLACEMENT}' GROUP BY 1, 2"""

# The same from visits that have a second user. Only the joins that link leave the user out.
_SHARED = ["population", "standard_a", "standard_b", "autoplay", "web_autoplay", "deeplink", "starts", "completes"]
for _side in "ab":
    _SHARED += [
        f"{x}_{_side}"
        for x in ("clicks", "timeline", "candidates", "ranked", "linked", "watch_candidates", "watched", "final", "funnel")
    ]
CTES["audiences_shared"] = f"""SELECT * FROM audiences
  UNION SELECT dt, cookie_id, visit_id, destination, CAST(user_id + 1 AS VARCHAR) FROM user_weeks
    WHERE {WINDOW} AND user_id % 3 = 0"""
for _name in _SHARED:
    _sql = re.sub(
        r"(FROM|JOIN)(\s+)(\w+)\b",
        lambda m: m[0] + "_shared" if m[3] in (*_SHARED, "audiences") else m[0],
        CTES[_name],
    )
    if "candidates" in _name:
        # An event recorded for several users is one candidate.
        _sql = _sql.replace(" AND a.hid = s.hid", "").replace(" AND a.hid = w.hid", "")
        if "watch" in _name:
            _once = "SELECT DISTINCT dt, cookie_id, visit_id, event_position, attribute, content_id FROM completes_shared"
            _sql = _sql.replace("JOIN completes_shared w", f"JOIN ({_once}) w")
        else:
            _sql = _sql.replace("SELECT", "SELECT DISTINCT", 1)
            _sql = _sql.replace("s.ordinal AS s_ordinal,", "s.series_id, s.brand_id,")
    # Of starts at one position the first by what it is: their ordinals differ between users.
    CTES[f"{_name}_shared"] = _sql.replace(
        "ordinal DESC, s_ordinal", "ordinal DESC, s_attribute NULLS FIRST, s_container NULLS FIRST, "
        "s_placement NULLS FIRST, content_id NULLS FIRST, series_id NULLS FIRST, brand_id NULLS FIRST"
    ).replace("s.placement AS s_placement", "s.container AS s_container, s.placement AS s_placement")

CTES["playback"] = f"""SELECT *, {_page_type('click_placement')} AS page_type,
    CASE WHEN click_container ILIKE '%rec%' THEN 'rec' ELSE 'next-episode' END AS container_group
  FROM final_b WHERE {_page_type('click_placement')} = 'episode_page' AND click_container ILIKE '%next%'"""
CTES["cta_pairs"] = f"""SELECT a.*, b.attribute
  FROM (SELECT * FROM final_b WHERE {_page_type('click_placement')} ILIKE '%TLEO%'
        AND click_container ILIKE '%CTA%') a
    JOIN (SELECT dt, hid, visit_id, container, attribute FROM clicks_b
        WHERE {_page_type('placement')} ILIKE '%TLEO%') b
    ON a.dt = b.dt AND a.hid = b.hid AND a.visit_id = b.visit_id AND a.click_container = b.container"""
CTES["cta_confirmed"] = f"""SELECT a.* FROM final_b a WHERE {_page_type('a.click_placement')} ILIKE '%TLEO%'
    AND a.click_container ILIKE '%CTA%' AND EXISTS (SELECT 1 FROM clicks_b b WHERE a.dt = b.dt AND a.hid = b.hid
      AND a.visit_id = b.visit_id AND a.click_container = b.container AND {_page_type('b.placement')} ILIKE '%TLEO%')"""

CTES["pages_seen"] = f"""SELECT destination,
    ['tv-bigscreen-html', 'tv-bigscreen-html', 'web-responsive', '{c.MOBILE_APP}'][user_id % 4 + 1] AS app_type, dt,
    visit_id, hid, CAST(event_position AS INTEGER) AS page_count, k % 4 AS page,
    {EPISODE} AS content_id, event_type
  FROM numbered"""
CTES["all_journeys"] = f"""SELECT destination, app_type, dt, visit_id, hid,
    string_agg({_list(d.JOURNEY_NAMES)}[page + 1], '|' ORDER BY page_count) AS page_name_sequence,
    string_agg({_list(d.JOURNEY_PAGES)}[page + 1], '|' ORDER BY page_count) AS page_sequence,
    string_agg(content_id, '|' ORDER BY page_count) AS content_id_sequence
  FROM pages_seen GROUP BY ALL"""
CTES["journeys"] = f"SELECT * FROM all_journeys WHERE {WINDOW}"
CTES["outcomes"] = f"""SELECT dt, visit_id, content_id, page_count,
    CASE WHEN event_type IN ('click', 'view', 'purchase') THEN '{c.START_ATTRIBUTE}' ELSE 'no-start-flag' END AS start_flag,
    CASE WHEN event_type = 'purchase' THEN '{c.COMPLETE_ATTRIBUTE}' ELSE 'no-watched-flag' END AS watched_flag
  FROM pages_seen WHERE page = 2"""
CTES["journey_pages"] = f"""SELECT app_type, dt, visit_id, hid, unnest(string_split(page_name_sequence, '|')) AS name,
    unnest(string_split(page_sequence, '|')) AS page, unnest(string_split(content_id_sequence, '|')) AS id,
    generate_subscripts(string_split(page_sequence, '|'), 1) AS n
  FROM journeys WHERE app_type <> '{c.MOBILE_APP}'"""
_next = "OVER (PARTITION BY app_type, dt, visit_id, hid ORDER BY n)"
CTES["looked_ahead"] = f"""SELECT *, lead(name) {_next} AS name1, lead(name, 2) {_next} AS name2,
    lead(page) {_next} AS page1, lead(page, 2) {_next} AS page2, lead(id) {_next} AS id1, lead(id, 2) {_next} AS id2
  FROM journey_pages"""


def _hops(family: str, entry: str, good: str, step: int) -> None:
    """Recommendation hops end at the first entry that does not qualify; `misses` counts those so far."""
    CTES[family] = f"""SELECT app_type, dt, visit_id, hid, CAST(hop AS INTEGER) AS hop,
      CAST(n AS INTEGER) AS entry_page_num, CAST(n + {step} AS INTEGER) AS content_page_num, id{step} AS content_id
    FROM (SELECT *, row_number() {_next} AS hop,
        sum(CASE WHEN {good} THEN 0 ELSE 1 END) OVER (PARTITION BY app_type, dt, visit_id, hid ORDER BY n) AS misses
      FROM looked_ahead WHERE {entry}) t WHERE misses = 0"""


_rec = f"name = '{c.RECOMMENDATIONS_PAGE}'"
_hops("rec_direct", _rec, "coalesce(name1 ILIKE '%episode%', false)", 1)
_hops("rec_via", _rec, "coalesce(name1 ILIKE '%tleo%' AND name2 ILIKE '%episode%', false)", 2)
_watch = f"page = '{c.WATCHING_PAGE}' AND page1 = "
_hops("watch_direct", _watch + f"'{c.EPISODE_PAGE}'", "true", 1)
_hops("watch_via", _watch + f"'{c.TITLE_PAGE}' AND page2 = '{c.EPISODE_PAGE}'", "true", 2)
CTES["rec_all"] = "SELECT * FROM rec_via UNION ALL SELECT * FROM rec_direct"
CTES["watch_all"] = "SELECT * FROM watch_via UNION ALL SELECT * FROM watch_direct"


def _rounds(family: str, sequence: str, pattern: str, guard: str, step: int, most: int) -> None:
    """Hops as the strings are chopped round by round, with page numbers added up over the rounds.

    `substring` from a position before the text returns what of the text lies in that stretch.
    """
    source = "journeys"
    for n in range(1, most + 1):
        columns = f"app_type, dt, visit_id, hid, {sequence} AS seq, content_id_sequence AS ids, 0 AS entry0, 0 AS page0"
        if n > 1:
            columns = "app_type, dt, visit_id, hid, rest AS seq, ids_left AS ids, entry_num AS entry0, page_num AS page0"
        where = f"app_type <> '{c.MOBILE_APP}' AND instr({sequence}, '{pattern}') > 0" if n == 1 else "times > 1"
        CTES[f"{family}_{n}"] = f"""SELECT app_type, dt, visit_id, hid, {n} AS hop, rest, times,
      ids_left, split_part(ids_left, '|', 1) AS content_id, entry0 + page AS entry_num, page0 + page + {step} AS page_num
    FROM (SELECT *, CASE WHEN start >= 1 THEN substring(ids, start, length(ids))
          ELSE left(ids, greatest(start + length(ids) - 1, 0)) END AS ids_left
      FROM (SELECT *, CASE WHEN len(string_split(ids, '|')) > page + {step}
            THEN length(array_to_string(string_split(ids, '|')[1:page + {step}], '|')) + 1
            ELSE 0 END + 1 - 9 AS start
        FROM (SELECT *, length(left(seq, found_at)) - length(replace(left(seq, found_at), '|', '')) + 1 AS page,
            right(seq, greatest(length(seq) - (found_at + length('{pattern}')), 0)) AS rest
          FROM (SELECT *, instr(seq, '{pattern}') AS found_at,
              (length(seq) - length(replace(seq, '{pattern}', ''))) // length('{pattern}') AS times
            FROM (SELECT {columns} FROM {source} WHERE {where}) a) b) d) e
      WHERE {guard}) f"""
        source = f"{family}_{n}"
    CTES[family] = " UNION ALL ".join(
        f"""SELECT app_type, dt, visit_id, hid, hop, CAST(entry_num AS INTEGER) AS entry_page_num,
      CAST(page_num AS INTEGER) AS content_page_num, content_id FROM {family}_{n}"""
        for n in range(1, most + 1)
    )


_episode_next = "split_part(seq, '|', CAST(page + {0} AS INTEGER)) ILIKE '%{1}%'"
_rounds(
    "rec_direct_chopped", "page_name_sequence", c.RECOMMENDATIONS_PAGE, _episode_next.format(1, "episode"), 1, 5
)
_rounds(
    "rec_via_chopped",
    "page_name_sequence",
    c.RECOMMENDATIONS_PAGE,
    _episode_next.format(1, "tleo") + " AND " + _episode_next.format(2, "episode"),
    2,
    2,
)
_rounds("watch_direct_chopped", "page_sequence", f"{c.WATCHING_PAGE}|{c.EPISODE_PAGE}", "true", 1, 5)
_rounds(
    "watch_via_chopped", "page_sequence", f"{c.WATCHING_PAGE}|{c.TITLE_PAGE}|{c.EPISODE_PAGE}", "true", 2, 2
)


def _outcomes(hops: str, label: str) -> str:
    return f"""SELECT h.*, '{label}' AS click_placement,
    CASE WHEN o.start_flag = '{c.START_ATTRIBUTE}' THEN 1 ELSE 0 END AS start_flag,
    CASE WHEN o.watched_flag = '{c.COMPLETE_ATTRIBUTE}' THEN 1 ELSE 0 END AS watched_flag
  FROM (SELECT DISTINCT app_type, dt, visit_id, hid, entry_page_num, content_page_num, content_id FROM {hops}) h
    LEFT JOIN outcomes o ON h.dt = o.dt AND h.visit_id = o.visit_id AND h.content_id = o.content_id
      AND h.content_page_num = o.page_count"""


CTES["rec_all_chopped"] = "SELECT * FROM rec_via_chopped UNION ALL SELECT * FROM rec_direct_chopped"
CTES["watch_all_chopped"] = "SELECT * FROM watch_via_chopped UNION ALL SELECT * FROM watch_direct_chopped"
for _name in ("rec", "watch"):
    for _path in ("direct", "via", "all"):
        _label = "rec_page" if _name == "rec" else c.WATCHING_PAGE
        CTES[f"{_name}_{_path}_outcomes"] = _outcomes(f"{_name}_{_path}", _label)
        CTES[f"{_name}_{_path}_chopped_outcomes"] = _outcomes(f"{_name}_{_path}_chopped", _label)

CTES["home_module_users"] = f"""SELECT DISTINCT {_page_type('click_placement')} AS page_type, click_container, hid
  FROM final_a WHERE click_placement = '{c.HOME_PLACEMENT}' AND click_container IN ({_in(c.HOME_MODULES)})"""
CTES["reach"] = """SELECT DISTINCT 'recommendations_page' AS source, hid FROM rec_all
  UNION ALL SELECT DISTINCT 'watching_page', hid FROM watch_all
  UNION ALL SELECT DISTINCT 'title_page_cta', hid FROM cta_confirmed
  UNION ALL SELECT DISTINCT 'end_of_playback', hid FROM playback
  UNION ALL SELECT DISTINCT 'homepage_modules', hid FROM home_module_users"""


def _population_stats(by: str) -> str:
    return f"""SELECT {by}, count(DISTINCT hid) AS num_signed_in_users, count(DISTINCT cookie_id) AS num_uv,
    count(DISTINCT dt || hid || visit_id) AS num_visits FROM population GROUP BY ALL"""


def _arm_report(by: str, where: str, clicks: str, keep: str = "true") -> str:
    on = " AND ".join(f"u.{x.strip()} = m.{x.strip()}" for x in by.split(","))
    columns = ", ".join(f"u.{x.strip()}" for x in by.split(","))
    return f"""SELECT {columns}, num_signed_in_users, num_visits, num_starts, num_watched, {clicks}
  FROM ({_population_stats(by)}) u JOIN (SELECT {by}, CAST(sum(start_flag) AS BIGINT) AS num_starts,
      CAST(sum(watched_flag) AS BIGINT) AS num_watched, count(visit_id) AS {clicks}
    FROM final_a WHERE {where} GROUP BY ALL) m ON {on} WHERE {keep}"""


HOME = f"click_placement = '{c.HOME_PLACEMENT}'"
RECOMMENDED = f"{HOME} AND click_container = '{c.RECOMMENDED_MODULE}'"
PAIRED = "a.page_type = b.page_type AND a.click_container = b.click_container"
POPULATION = "destination, dt, cookie_id, visit_id, platform, hid, frequency_band, frequency_group, age_range, exp_group"
FIRST_FINAL = ", ".join(
    ["dt", "cookie_id", "hid", "frequency_band", "frequency_group", "visit_id", "click_event_position",
     "click_container", "click_placement", "content_placement", "content_id", "content_start_event_position",
     "content_watched_event_position", "start_flag", "watched_flag", "platform", "age_range"]
)

SELECTS = {
    "visit_platforms": "SELECT * FROM visit_platforms",
    "signed_in_population": f"SELECT {POPULATION} FROM population",
    "timed_frequency_groups": """SELECT frequency_band, CASE WHEN frequency_band = 'new' THEN 'new'
      ELSE coalesce(name, 'other') END AS frequency_group, count(DISTINCT visit_id) AS num_visits,
    min(dt) AS first_dt, max(dt) AS last_dt
  FROM population LEFT JOIN frequency_groups ON frequency_band = band
    AND CAST(date_trunc('week', strptime(dt, '%Y%m%d')) AS DATE) BETWEEN valid_from AND valid_to
  GROUP BY ALL""",
    "population_dates": "SELECT DISTINCT dt FROM population",
    "module_impressions": "SELECT * FROM module_impressions",
    "catalogue_snapshot": "SELECT * FROM catalogue",
    "standard_clicks": f"SELECT {CLICK_COLUMNS} FROM standard_b",
    "clicks_by_date": f"SELECT {CLICK_COLUMNS} FROM standard_b",
    "standard_clicks_no_title": f"SELECT {CLICK_COLUMNS} FROM standard_a",
    "autoplay_clicks": f"SELECT {CLICK_COLUMNS}, current_ep_id FROM autoplay",
    "web_autoplay": f"SELECT {CLICK_COLUMNS}, current_ep_id FROM web_autoplay",
    "first_deeplink": f"SELECT {V}, event_position, content_id FROM deeplink",
    "all_clicks": f"SELECT kind, {CLICK_COLUMNS} FROM clicks_b",
    "play_starts": f"SELECT {CLICK_COLUMNS}, series_id, brand_id FROM starts",
    "play_completes": f"SELECT {CLICK_COLUMNS} FROM completes",
    "timeline_ordinals": f"SELECT {CLICK_COLUMNS}, series_id, brand_id, ordinal FROM timeline_a",
    "clicks_linked_starts": "SELECT * FROM linked_a",
    "starts_linked_completes": "SELECT * FROM watched_a",
    "final_no_title": f"SELECT {FIRST_FINAL} FROM final_a",
    "final_with_title": f"SELECT {FIRST_FINAL} FROM final_b",
    "shared_clicks_linked_starts": "SELECT * FROM linked_a_shared",
    "shared_starts_linked_completes": "SELECT * FROM watched_a_shared",
    "shared_funnel": "SELECT * FROM funnel_b_shared",
    "funnel": "SELECT * FROM funnel_a",
    "homepage_funnel": "SELECT * FROM home_a",
    "homepage_funnel_direct": "SELECT * FROM home_b",
    "home_containers": f"SELECT DISTINCT click_container FROM final_a WHERE {HOME}",
    "path_comparison": f"""SELECT a.page_type, a.click_container,
    CASE WHEN a.num_si_users > b.num_si_users THEN a.num_si_users ELSE b.num_si_users END AS num_si_users,
    CASE WHEN a.num_clicks > b.num_clicks THEN a.num_clicks ELSE b.num_clicks END AS num_clicks,
    a.num_starts AS both_paths_starts, a.num_completes AS both_paths_completes,
    b.num_starts AS direct_starts, b.num_completes AS direct_completes
  FROM home_a a JOIN home_b b ON {PAIRED} WHERE a.click_container IN ({_in(c.HOME_MODULES)})""",
    "via_title_difference": "SELECT a.page_type, a.click_container, "
    + ", ".join(
        f"a.{x} - b.{x} AS via_title_{x}" for x in ("num_si_users", "num_clicks", "num_starts", "num_completes")
    )
    + f" FROM home_a a JOIN home_b b ON {PAIRED}",
    "end_of_playback": f"SELECT page_type, container_group AS click_container, {TOTALS} FROM playback GROUP BY 1, 2",
    "cta_funnel": f"SELECT click_container, {TOTALS} FROM cta_confirmed GROUP BY 1",
    "cta_funnel_compat": f"SELECT click_container, {TOTALS} FROM cta_pairs GROUP BY 1",
    "distinct_users": """SELECT 'title_pages_skipped' AS source, count(DISTINCT hid) AS num_si_users FROM final_a
  UNION ALL SELECT 'title_pages_kept', count(DISTINCT hid) FROM final_b
  UNION ALL SELECT 'population', count(DISTINCT hid) FROM population
  UNION ALL SELECT 'module_impressions', count(DISTINCT hid) FROM module_impressions""",
    "sketched_module_users": "SELECT click_container, count(DISTINCT hid) AS num_si_users FROM final_b GROUP BY 1",
    "distinct_visits": """SELECT 'title_pages_skipped' AS source, count(DISTINCT dt || visit_id) AS num_visits FROM final_a
  UNION ALL SELECT 'title_pages_kept', count(DISTINCT dt || visit_id) FROM final_b""",
    "visits_by_frequency": "SELECT frequency_band, count(DISTINCT dt || visit_id) AS num_visits FROM final_a GROUP BY 1",
    "arm_platform_users": """SELECT platform, exp_group, count(DISTINCT hid) AS num_users,
    count(DISTINCT visit_id) AS num_visits FROM final_a GROUP BY 1, 2""",
    "arm_users": "SELECT exp_group, count(DISTINCT hid) AS num_users FROM final_a GROUP BY 1",
    "arm_population_stats": _population_stats("platform, exp_group").replace("num_signed_in_users", "num_hids"),
    "arm_module_report": _arm_report(
        "platform, exp_group", f"{HOME} AND click_container <> '{c.RECOMMENDED_MODULE}'", "num_clicks_to_module"
    ),
    "arm_age_report": _arm_report(
        "platform, exp_group, age_range", RECOMMENDED, "num_clicks_to_module", "u.age_range <> 'under 10'"
    ),
    "arm_product_report": _arm_report("platform, exp_group", "true", "num_clicks"),
    "impression_visits": f"""SELECT a.platform, b.exp_group, b.age_range, count(DISTINCT a.visit_id)
    AS num_visits_saw_module
  FROM module_impressions a JOIN final_a b ON a.dt = b.dt AND a.visit_id = b.visit_id AND a.platform = b.platform
    AND a.hid = b.hid
  WHERE a.container = '{c.RECOMMENDED_MODULE}' AND b.age_range <> 'under 10' GROUP BY 1, 2, 3""",
    "arm_population_overview": """SELECT exp_group, count(DISTINCT hid) AS num_signed_in_users,
    count(DISTINCT dt || visit_id) AS num_visits FROM population WHERE exp_group <> 'unknown' GROUP BY 1""",
    "arm_module_overview": f"""SELECT exp_group, CAST(sum(start_flag) AS BIGINT) AS num_starts,
    CAST(sum(watched_flag) AS BIGINT) AS num_watched, count(visit_id) AS num_clicks FROM final_a
  WHERE {RECOMMENDED} GROUP BY 1""",
    "user_results": f"""SELECT DISTINCT a.exp_group, a.age_range, a.hid, a.frequency_band, a.frequency_group,
    coalesce(b.num_starts, 0) AS num_starts, coalesce(b.num_watched, 0) AS num_watched
  FROM population a LEFT JOIN (SELECT exp_group, age_range, hid, CAST(sum(start_flag) AS BIGINT) AS num_starts,
      CAST(sum(watched_flag) AS BIGINT) AS num_watched FROM final_a WHERE {RECOMMENDED} GROUP BY 1, 2, 3) b
    ON a.hid = b.hid AND a.exp_group = b.exp_group AND a.age_range = b.age_range""",
    "engagement_groups": f"""SELECT starts AS starts_per_user, count(hid) AS num_users,
    CAST(sum(starts) AS BIGINT) AS num_starts, CAST(sum(completes) AS BIGINT) AS num_watched
  FROM (SELECT DISTINCT a.hid, coalesce(b.starts, 0) AS starts, coalesce(b.completes, 0) AS completes
    FROM population a LEFT JOIN (SELECT hid, CAST(sum(start_flag) AS BIGINT) AS starts,
      CAST(sum(watched_flag) AS BIGINT) AS completes FROM final_a WHERE {RECOMMENDED} GROUP BY 1) b
    ON a.hid = b.hid) u GROUP BY 1""",
    "occurrence_histogram": f"""SELECT CAST((length(page_name_sequence) - length(replace(page_name_sequence,
      '{c.RECOMMENDATIONS_PAGE}', ''))) // length('{c.RECOMMENDATIONS_PAGE}') AS BIGINT) AS num_time_page_occurs,
    count(visit_id) AS num_visits FROM all_journeys WHERE page_name_sequence ILIKE '%recommendations.page%' GROUP BY 1""",
    "occurrence_histogram_pairs": """SELECT CAST((length(page_sequence) - length(replace(page_sequence,
      'watching_page|episode_page', ''))) // length('watching_page|episode_page') AS BIGINT) AS num_time_page_occurs,
    count(visit_id) AS num_visits FROM all_journeys WHERE page_sequence ILIKE '%watching_page|episode_page%' GROUP BY 1""",
    "short_visits": """SELECT app_type, page_name_sequence FROM all_journeys
  WHERE page_name_sequence ILIKE '%recommendations.page%'
    AND length(page_sequence) - length(replace(page_sequence, '|', '')) < 3""",
    "journeys_from_title_pages": """SELECT dt, visit_id, CAST(generate_subscripts(rest, 1) AS INTEGER) AS step,
    unnest(rest) AS page
  FROM (SELECT dt, visit_id, string_split(right(page_sequence, length(page_sequence)
      - instr(page_sequence, 'watching_page|tleo_page|episode_page') + 1), '|') AS rest
    FROM all_journeys WHERE page_sequence LIKE '%watching_page|tleo_page|episode_page%') t""",
    "sample_short_visits": """SELECT app_type, page_name_sequence FROM all_journeys
  WHERE page_name_sequence ILIKE '%recommendations.page%' AND len(string_split(page_sequence, '|')) <= 3
  ORDER BY dt, visit_id, hid, app_type LIMIT 10""",
    "hops_direct": "SELECT * FROM rec_direct",
    "hops_via_title": "SELECT * FROM rec_via",
    "hops_watching_direct": "SELECT * FROM watch_direct",
    "hops_watching_via_title": "SELECT * FROM watch_via",
    "hops_direct_compat": "SELECT * FROM rec_direct_chopped",
    "hops_via_title_compat": "SELECT * FROM rec_via_chopped",
    "hops_watching_direct_compat": "SELECT * FROM watch_direct_chopped",
    "hops_watching_via_title_compat": "SELECT * FROM watch_via_chopped",
    "hop_outcomes": "SELECT * FROM rec_direct_outcomes",
    "hop_outcomes_watching": "SELECT * FROM watch_direct_outcomes",
    "hop_counts": " UNION ALL ".join(
        f"SELECT '{x}' AS family, hop, count(visit_id) AS num_visits FROM {x} GROUP BY 2"
        for x in ("rec_direct", "rec_via", "watch_direct", "watch_via")
    ),
    "cta_users": "SELECT DISTINCT hid FROM cta_confirmed",
    "playback_users": "SELECT DISTINCT page_type, container_group AS click_container, hid FROM playback",
    "homepage_module_users": "SELECT * FROM home_module_users",
    "reach_union": "SELECT * FROM reach",
    "dist_users": "SELECT DISTINCT hid FROM reach",
    "reach_share": """SELECT source, num_users, round(num_users * 100.0 / total, 4) AS pct_of_signed_in
  FROM (SELECT source, count(DISTINCT hid) AS num_users FROM reach GROUP BY 1
    UNION ALL SELECT 'all', count(DISTINCT hid) FROM reach) r,
    (SELECT count(DISTINCT hid) AS total FROM population) p""",
    "reach_overlap": """SELECT sources, num_sources, count(hid) AS num_users
  FROM (SELECT hid, count(*) AS num_sources, string_agg(source, '+' ORDER BY CASE source WHEN 'recommendations_page' THEN 1
      WHEN 'watching_page' THEN 2 WHEN 'title_page_cta' THEN 3 WHEN 'end_of_playback' THEN 4 ELSE 5 END) AS sources
    FROM (SELECT DISTINCT source, hid FROM reach WHERE hid IS NOT NULL) d GROUP BY 1) u
  GROUP BY ALL""",
    "reach_measures": f"""WITH played AS (
    SELECT 'recommendations_page' AS source, hid, start_flag, watched_flag FROM rec_all_outcomes
    UNION ALL SELECT 'watching_page', hid, start_flag, watched_flag FROM watch_all_outcomes
    UNION ALL SELECT 'end_of_playback', hid, start_flag, watched_flag FROM playback
    UNION ALL SELECT 'title_page_cta', hid, start_flag, watched_flag FROM cta_confirmed
    UNION ALL SELECT 'homepage:' || click_container, hid, start_flag, watched_flag FROM final_a
      WHERE {HOME} AND click_container IN ({_in(c.HOME_MODULES)}))
  SELECT source, 'clicked' AS measure, count(DISTINCT hid) AS num_users FROM played GROUP BY 1
  UNION ALL SELECT source, 'started', count(DISTINCT hid) FILTER (start_flag = 1) FROM played GROUP BY 1
  UNION ALL SELECT source, 'completed', count(DISTINCT hid) FILTER (watched_flag = 1) FROM played GROUP BY 1""",
    "stage_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS stage, count(*) AS num_rows FROM {cte}"
        for name, cte in (
            ("population", "population"),
            ("clicks", "clicks_a"),
            ("starts", "starts"),
            ("completes", "completes"),
            ("journeys", "final_a"),
        )
    ),
}
for _name, _query in (("rec", "hop_funnel"), ("watch", "hop_funnel_watching")):
    for _path, _suffix in (("direct", ""), ("via", "_via_title"), ("all", "_all")):
        SELECTS[_query + _suffix + "_compat"] = (
            f"SELECT click_placement, {TOTALS} FROM {_name}_{_path}_chopped_outcomes GROUP BY 1"
        )
        SELECTS[_query + _suffix] = (
            f"SELECT click_placement, {TOTALS} FROM {_name}_{_path}_outcomes GROUP BY 1"
        )
SELECTS["arm_exports"] = f"SELECT * FROM ({SELECTS['user_results']}) r WHERE exp_group IN ('control', 'variation_1')"


def _sources(sql: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) & set(CTES)


def _needed(sql: str) -> list[str]:
    """The common table expressions a query uses, directly or through others, in order of definition."""
    found, todo = set(), [sql]
    while todo:
        new = _sources(todo.pop()) - found
        found |= new
        todo.extend(CTES[x] for x in new)
    return [x for x in CTES if x in found]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, select in SELECTS.items():
        ctes = ",\n".join(f"{x} AS ({CTES[x]})" for x in _needed(select))
        out[name] = f"WITH {ctes}\n{select}" if not select.startswith("WITH ") else f"WITH {ctes},\n{select[5:]}"
    return out
