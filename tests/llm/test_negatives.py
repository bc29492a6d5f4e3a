"""Hard negatives against all pairs in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailhead.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, id string, score int, `a.b` int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("size", [0, 1, 300, 2**20, 2**40, 10**30])
def test_wide_products_are_exact(size):
    rng = random.Random(size)
    for n, m, d in [(1, 1, 1), (3, 7, 5), (4, 16, 64), (2, 5, 0)]:
        a = np.array([[float(rng.randint(-size, size)) for _ in range(d)] for _ in range(n)]).reshape(n, d)
        c = np.array([[float(rng.randint(-size, size)) for _ in range(d)] for _ in range(m)]).reshape(m, d)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in c] for r in a]
        most = 2**63 - 1
        assert negatives.wide_products(a, c).tolist() == [[max(-most, min(most, x)) for x in r] for r in want]


def brute(rows, settings):
    usable = [
        (i, label, [math.floor(settings.scale * float(np.float32(x))) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    most, out = 2**63 - 1, []

    def first(found, k):
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    for a, (i, label, v) in enumerate(usable):
        if i is None or i % 10:
            continue
        scored = [
            (max(-most, min(most, sum(x * y for x, y in zip(v, w)))), j, other, b)
            for b, (j, other, w) in enumerate(usable) if b != a
        ]
        for p, j, _, _ in first([x for x in scored if x[2] == label], settings.positives):
            inside = [x for x in scored if x[2] != label and settings.low_percent * p <= 100 * x[0] <= settings.high_percent * p]
            out += [(i, j, n + 1, x[1], p, x[0]) for n, x in enumerate(first(inside, settings.negatives))]
    return sorted(out, key=str)


def mined(spark, rows, settings):
    frame = spark.createDataFrame([(*(r[0], r[2], r[1]), "u", "i", 1, 2) for r in rows], SCHEMA).repartition(3)
    found = negatives.hard_negatives(frame, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("id") % 10 == 0, settings)
    return sorted(([x[c] for c in COLUMNS] for x in found.collect()), key=str)


@pytest.mark.parametrize("size, settings", [
    (1.0, negatives.NegativeSettings()),
    (1.0, negatives.NegativeSettings(anchor_bytes=200, block=2, rows_per_task=30, positives=3, negatives=4)),
    (0.01, negatives.NegativeSettings(low_percent=-50, high_percent=100)),  # many ties
    (1e6, negatives.NegativeSettings(rows_per_task=50)),
    (1e15, negatives.NegativeSettings(rows_per_task=50)),
])
def test_equals_all_pairs(spark, size, settings):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, 0, 0, 0, 1, 2]), [rng.uniform(-size, size) for _ in range(rng.choice([6, 6, 6, 0, 3, 8]))]) for _ in range(220)]
    rows += rows[:30] + [(10, 1, None), (20, 1, [1.0, None]), (30, 1, [float("nan")]), (40, 0, [float("inf")]), (50, 0, [])]
    expected = brute(rows, settings)
    assert expected and [tuple(x) for x in mined(spark, rows, settings)] == [tuple(x) for x in expected]


def test_none(spark):
    settings = negatives.NegativeSettings()
    assert mined(spark, [], settings) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])], settings) == []  # no anchor
    assert mined(spark, [(10, 1, [1.0]), (2, 2, [1.0])], settings) == []  # no positive
    assert mined(spark, [(None, None, None)], settings) == []


def test_one_huge_row_does_not_disturb_the_others(spark):
    settings = negatives.NegativeSettings()
    rows = [(i, i % 3, [i / 40, 1.0, -0.25]) for i in range(40)] + [(77, 2, [3e38, -3e38, 1.0])]
    assert [tuple(x) for x in mined(spark, rows, settings)] == [tuple(x) for x in brute(rows, settings)]
