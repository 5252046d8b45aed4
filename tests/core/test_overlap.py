"""Overlap joins of boxes of any size."""

import random

import pytest
from pyspark.sql import functions as F

from crownwork.operators import overlap


def boxes(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        side = lambda: rng.choice([1, 2, 5, 16, 17, 64, 65, 300, 4096, 100_000])
        x, y = rng.randrange(-3000, 3000), rng.randrange(-3000, 3000)
        rows.append((k % 2, k, x, y, x + side(), y + side()))
    return rows + [(0, n, 5, 5, 5, 9), (0, n + 1, 9, 9, 5, 20), (0, n + 2, None, 1, 2, 3)]  # without area, or without a place


def test_sides_from_1_to_100000(spark):
    a, b = boxes(1, 300), boxes(2, 300)
    kind = "image_id bigint, id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint"
    left, right = (spark.createDataFrame(rows, kind).repartition(3) for rows in (a, b))
    sound = lambda r: None not in r and r[4] > r[2] and r[5] > r[3]
    want = []
    for p in filter(sound, a):
        for q in filter(sound, b):
            w, h = min(p[4], q[4]) - max(p[2], q[2]), min(p[5], q[5]) - max(p[3], q[3])
            if p[0] == q[0] and w > 0 and h > 0:
                want.append((p[1], q[1], w * h))
    got = overlap.overlap_join(left, right, cell=None).select("l_id", "r_id", "inter")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 1500
    assert overlap.overlap_join(left.limit(0), right, cell=None).isEmpty()


@pytest.mark.parametrize("side", [1, 1000, 100_000])
def test_a_box_meets_itself_once(spark, side):
    one = spark.createDataFrame([(0, 7, 13, 13 + side, 7 + side)], "image_id bigint, xmin bigint, ymin bigint, ymax bigint, xmax bigint").withColumn("id", F.lit(1))
    plan = overlap.overlap_join(one, one, cell=None)
    assert plan.count() == 1


def test_boxes_go_where_they_can_meet(spark):
    """Sides of one level meet in one join, also if a few are smaller; a table of larger ones adds the other."""
    kind = "image_id bigint, id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint"
    rng = random.Random(4)

    def some(n, *sides):
        at = [(rng.randrange(2000), rng.randrange(2000), sides[k % len(sides)]) for k in range(n)]
        return [(k % 2, k, x, y, x + s, y + s) for k, (x, y, s) in enumerate(at)]

    def check(a, b):
        left, right = (spark.createDataFrame(rows, kind) for rows in (a, b))
        common = lambda p, q: max(0, min(p[4], q[4]) - max(p[2], q[2])) * max(0, min(p[5], q[5]) - max(p[3], q[3]))
        want = sorted((p[1], q[1], common(p, q)) for p in a for q in b if p[0] == q[0] and common(p, q))
        got = overlap.overlap_join(left, right, cell=None)
        assert sorted(map(tuple, got.select("l_id", "r_id", "inter").collect())) == want and want
        return got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")

    regular = some(200, 100, 140, 90)
    assert check(regular, some(200, 120)) == 1
    assert check(regular, some(200, *[120] * 39, 50)) == 1
    assert check(some(200, *[100] * 9, 3000), some(200, 120)) == 2
    assert check(some(50, 3), some(50, 3000)) == 1
    assert overlap._raised({0: 3, 1: 3462, 2: 148703, 6: 200000}) == {0: 2, 1: 2} and overlap._raised({}) == {}
