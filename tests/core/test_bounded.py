"""Results of linear size are made without a table of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from crownwork.operators import match, overlap, suppress
from crownwork.plans import queries

SIDES = "xmin bigint, ymin bigint, xmax bigint, ymax bigint"


def crowd(n, seed=1, span=120):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        out.append((k % 2, k, rng.randrange(50), x, y, x + rng.randrange(60, 150), y + rng.randrange(60, 150)))
    return out


def common(a, b):
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def area(a):
    return (a[2] - a[0]) * (a[3] - a[1])


def counting(monkeypatch, module, name, at):
    """Counts the rows of the table that is argument ``at`` of a function."""
    seen, inner = [], getattr(module, name)

    def counted(*a, **k):
        seen.append(a[at].count())
        return inner(*a, **k)

    monkeypatch.setattr(module, name, counted)
    return seen


def test_suppression_of_a_crowd_makes_few_pairs(spark, monkeypatch):
    rows = crowd(1500) + [(7, 2000, None, 0, 0, 9, 9), (7, 2001, 3, 0, 0, 9, 9)]
    kept = []
    for r in sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[1])):
        if r[2] is None or not any(k[0] == r[0] and (2 * (i := common(k[3:], r[3:])) >= area(k[3:]) + area(r[3:]) - i or 2 * i >= area(r[3:])) for k in kept):
            kept.append(r)
    seen = counting(monkeypatch, suppress, "survivors", 1)
    got = suppress.box_nms(spark.createDataFrame(rows, f"image_id bigint, det_id bigint, score bigint, {SIDES}"))
    assert sorted(r["det_id"] for r in got.collect()) == sorted(r[1] for r in kept)
    assert sum(seen) < 20 * len(rows)


def test_suppression_of_masks_at_a_place_makes_few_pairs(spark, monkeypatch):
    rng, masks = random.Random(4), {}
    for k in range(1200):
        x = rng.randrange(12)
        masks[k] = {(y, x + i) for y in range(3) for i in range(10 + rng.randrange(4))}
    rows = [(k, 0, y, min(x for v, x in m if v == y), max(x for v, x in m if v == y) + 1) for k, m in masks.items() for y in range(3)]
    kept = []
    for k in sorted(masks, key=lambda k: (-(k * 37 % 100), k)):
        if not any(len(masks[k] & masks[j]) > 0.3 * len(masks[k] | masks[j]) for j in kept):
            kept.append(k)
    seen = counting(monkeypatch, suppress, "survivors", 1)
    objects = spark.createDataFrame([(k, k * 37 % 100) for k in [*masks, 9999]], "obj_id bigint, score bigint")
    got = suppress.mask_nms(objects, spark.createDataFrame(rows, "obj_id bigint, image_id bigint, y bigint, x0 bigint, x1 bigint"))
    assert sorted(r["obj_id"] for r in got.collect()) == sorted([*kept, 9999])
    assert sum(seen) < 100 * len(masks)


@pytest.mark.parametrize("least", [0.9, 0.5, 0.3, 0.0])
def test_alike_join_loses_no_pair(spark, least):
    rows = crowd(120, 5) + [(0, 900, 1, -700, -700, 900, 900), (0, 901, 1, -690, -700, 900, 905), (1, 902, 1, 3, 3, 4, 4), (1, 903, 1, 3, 3, 4, 4)]
    df = spark.createDataFrame(rows, f"image_id bigint, det_id bigint, score bigint, {SIDES}")
    got = [(r["l_det_id"], r["r_det_id"]) for r in overlap.alike_join(df, df, least).collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (i := common(a[3:], b[3:])) and i / (area(a[3:]) + area(b[3:]) - i) >= least}
    assert len(got) == len(want) and set(got) == want


def test_bands_match_as_one_scan_and_make_few_pairs(spark, monkeypatch):
    det, gt = crowd(400, 2), crowd(300, 3)
    pairs = sorted((-(i := common(p[3:], t[3:])) / (area(p[3:]) + area(t[3:]) - i), p[1], t[1]) for p in det for t in gt if p[0] == t[0])
    used, want = set(), set()
    for v, p, t in pairs:
        if v <= -0.4 and ("p", p) not in used and ("t", t) not in used:
            used |= {("p", p), ("t", t)}
            want.add((p, t))
    seen = counting(monkeypatch, match, "one_to_one", 0)
    one = spark.createDataFrame(det, f"image_id bigint, det_id bigint, score_m bigint, {SIDES}")
    two = spark.createDataFrame(gt, f"image_id bigint, gt_id bigint, category bigint, {SIDES}")
    got = queries.greedy(one, two)
    assert {(r["pred_id"], r["gt_id"]) for r in got.collect()} == want
    assert sum(seen) < sum(v <= -0.4 for v, _, _ in pairs) / 2


@pytest.mark.parametrize("measure", ["iop", "iou"])
@pytest.mark.parametrize("most", [2_000_000, 0])
def test_scans_of_boxes(spark, monkeypatch, measure, most):
    det = [(k % 3, *r) for k, r in enumerate(crowd(200, 6) + [(0, 700, 99, -2000, -2000, 3000, 3000), (4, 701, 1, 0, 0, 5, 5)])]
    gt = [r[:2] + r[3:] for r in crowd(150, 7) + [(0, 800, 0, -2000, -2000, 2900, 3000), (1, 801, 0, 5, 5, 5, 9)]]
    used, want = set(), set()
    for p in sorted(det, key=lambda p: (-p[3], p[2])):
        free = []
        for t in gt:
            if p[1] == t[0] and (p[0], t[1]) not in used and (i := common(p[4:], t[2:])):
                v = i / (area(p[4:]) if measure == "iop" else area(p[4:]) + area(t[2:]) - i)
                free += [(-v, t[1])] if v >= 0.4 else []
        if free:
            used.add((p[0], min(free)[1]))
            want.add((p[0], p[1], p[2], min(free)[1], -min(free)[0]))
    if most:
        monkeypatch.setattr(match, "overlap_join", None)  # no pairs
    one = spark.createDataFrame(det, f"model bigint, image_id bigint, pred_id bigint, score bigint, {SIDES}")
    two = spark.createDataFrame(gt, f"image_id bigint, gt_id bigint, {SIDES}")
    got = match.boxes_in_score_order(one, two, ("model", "image_id"), ("image_id",), measure, 0.4, most)
    got = list(map(tuple, got.select("model", "image_id", "pred_id", "gt_id", F.col("value")).collect()))
    assert len(got) == len(want) and set(got) == want
