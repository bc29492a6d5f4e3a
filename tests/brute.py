"""Linking by listing all pairs, to check the operators against. Plain Python, for small inputs only."""

from collections import defaultdict


def _key(*values):
    """Sort key in which None comes first, as in Spark."""
    return tuple((x is not None, x if x is not None else "") for x in values)


def ordinals(events):
    """events: dicts with visit, position, kind, attribute, container, placement, content_id."""
    by_visit = defaultdict(list)
    for e in events:
        by_visit[e["visit"]].append(e)
    for rows in by_visit.values():
        rows.sort(
            key=lambda e: (
                e["position"],
                e["kind"] == "start",
                _key(e["attribute"], e["container"], e["placement"], e["content_id"]),
            )
        )
        for n, e in enumerate(rows, 1):
            e["ordinal"] = n


def click_start_match(click, start):
    if click["content_id"] is None:
        return False
    if click["content_id"] == "unknown":
        return click["ordinal"] == start["ordinal"] - 1
    ids = (start["content_id"], start["series"], start["brand"])
    return start["content_id"] is not None and click["content_id"] in ids


def link(lefts, rights, match, left_position, right_position, left_tie, right_tie):
    """Returns (left, linked right or None) for every left row kept."""
    by_visit = defaultdict(list)
    for right in rights:
        by_visit[right["visit"]].append(right)
    pairs, kept = [], []
    for left in lefts:
        matches = [r for r in by_visit[left["visit"]] if match(left, r)]
        if not matches:
            kept.append((left, None))
        for right in matches:
            distance = right[right_position] - left[left_position]
            if distance >= 0:
                pairs.append((distance, left_tie(left), right_tie(right), id(left), left, right))
    pairs.sort(key=lambda p: p[:4])
    best_left, best_right = {}, {}
    for pair in pairs:
        left, right = pair[4], pair[5]
        best_left.setdefault((left["visit"], left[left_position]), pair)
        best_right.setdefault((right["visit"], right[right_position]), pair)
    for pair in best_left.values():
        left, right = pair[4], pair[5]
        mutual = best_right[(right["visit"], right[right_position])] is pair
        kept.append((left, right if mutual else None))
    return kept
