"""Best overlaps by trees of bounds against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownwork.operators import best, match, overlap

BOX = "image_id bigint, xmin {0}, ymin {0}, xmax {0}, ymax {0}"


def boxes(n, seed, wide=90, images=3, unit=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(-60, 200) * unit, rng.randrange(-60, 200) * unit
        out.append((k, k % images, x, y, x + rng.randrange(-5, wide) * unit, y + rng.randrange(-5, wide) * unit))
    return out


@pytest.mark.parametrize("kind, unit, most", [("bigint", 1, 1_000_000), ("int", 1, 7), ("double", 0.25, 1_000_000)])
def test_best_values_equal_all_pairs(spark, monkeypatch, kind, unit, most):
    monkeypatch.setattr(best, "LEAF", 2)
    det = spark.createDataFrame([*boxes(60, 1, unit=unit), (60, 0, None, None, None, None), (61, 9, 0 * unit, 0 * unit, 5 * unit, 5 * unit)], "pred_id bigint, " + BOX.format(kind))
    gt = spark.createDataFrame(boxes(40, 2, unit=unit), "gt_id bigint, " + BOX.format(kind)).withColumn("category", F.when(F.col("gt_id") % 7 != 0, F.col("gt_id") % 3))
    pairs = overlap.overlap_join(det, gt, cell=None)
    m = overlap.pair_measures(pairs)
    named = m.select(F.col("l_pred_id").alias("pred_id"), F.col("r_category").alias("category"), "iou", F.col("l_share").alias("iop"))
    want = match.best_overlaps(det.select("pred_id", "image_id"), named)
    got = best.best_of_boxes(det, gt, cell=64, most=most)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    whole = m.groupBy(F.col("l_image_id").alias("image_id")).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("iou", "l_share", "r_share")])
    assert sorted(best.measures_by_group(det, gt, cell=64, most=most).collect()) == sorted(whole.collect())
    assert best.measures_by_group(det, gt.limit(0)).collect() == []


def test_pairs_are_counted_by_places():
    one, two = (np.array(boxes(400, s, images=1), float)[:, 2:].T for s in (3, 4))
    one, two = (b[:, (b[2] > b[0]) & (b[3] > b[1])] for b in (one, two))
    cells = [(x, y) for x in range(-64, 320, 32) for y in range(-64, 320, 32)]
    assert [best.count_pairs(one, two, x, y, 32, True) for x, y in cells] == [best.count_pairs(one, two, x, y, 32, False) for x, y in cells]


@pytest.mark.parametrize("measure", ["iou", "l_share", "r_share"])
def test_few_of_all_pairs_are_looked_at(monkeypatch, measure):
    looked, inter = [], best._inter
    monkeypatch.setattr(best, "_inter", lambda p, lo, hi: looked.append(v := inter(p, lo, hi)) or v)
    n, rng = 16000, np.random.default_rng(1)
    corners, sides = rng.integers(0, 512, (2, 2, n)), rng.integers(60, 150, (2, 2, n))
    one, two = (np.concatenate([c, c + s]).astype(float) for c, s in zip(corners, sides))
    of = np.zeros(n, int) if measure == "r_share" else np.arange(n)  # that one is asked for by group only
    best.best_values(one, two, measure, of, n)
    assert sum(v.size for v in looked) < n * n / 20
