import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crownwork.functions import boxes as B
from crownwork.functions import boxes as B
from crownwork.functions import circular
from crownwork.operators import components, joins, match, metrics, scoring, spans, suppress, tiling
from crownwork.sources import readers, writers
from crownwork.streaming import ingest

BOXES = "image_id bigint, det_id bigint, score bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint"


def scan_nms(rows, iou, cover):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        def hit(k):
            i = max(0, min(k[5], r[5]) - max(k[3], r[3])) * max(0, min(k[6], r[6]) - max(k[4], r[4]))
            a, b = (k[5] - k[3]) * (k[6] - k[4]), (r[5] - r[3]) * (r[6] - r[4])
            return i > 0 and (i >= iou * (a + b - i) or i >= cover * b) and k[0] == r[0]

        if not any(hit(k) for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


@pytest.mark.parametrize("n", [0, 1, 300])
def test_nms_equals_a_scan(spark, n):
    rng = random.Random(n)
    rows = []
    for k in range(n):
        x, y = rng.randrange(-50, 300), rng.randrange(-50, 300)
        rows.append((k % 3, k, rng.randrange(20), x, y, x + rng.randrange(0, 90), y + rng.randrange(0, 90)))
    got = {r["det_id"] for r in suppress.box_nms(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == scan_nms(rows, 0.5, 0.5)


def test_matchings_equal_scans(spark):
    rng = random.Random(5)
    pairs = [(p, 10 * (p % 7), g, rng.randrange(1, 6) / 5) for p in range(40) for g in rng.sample(range(25), 4)]
    df = spark.createDataFrame(pairs, "pred_id bigint, score bigint, gt_id bigint, value double")
    used_p, used_g, want = set(), set(), set()
    for p, _, g, v in sorted(pairs, key=lambda r: (-r[3], r[0], r[2])):
        if p not in used_p and g not in used_g:
            want.add((p, g))
            used_p.add(p)
            used_g.add(g)
    assert {(r["pred_id"], r["gt_id"]) for r in match.one_to_one(df).collect()} == want
    used, want = set(), set()
    for p in sorted({r[0] for r in pairs}, key=lambda p: (-10 * (p % 7), p)):
        free = [(-v, g) for q, _, g, v in pairs if q == p and g not in used]
        if free:
            used.add(min(free)[1])
            want.add((p, min(free)[1]))
    assert {(r["pred_id"], r["gt_id"]) for r in match.in_score_order(df).collect()} == want
    assert match.one_to_one(df.limit(0)).collect() == [] and match.in_score_order(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_average_precision(spark, parts):
    rng = random.Random(2)
    rows = [("m", k, rng.randrange(50), rng.randrange(2)) for k in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    points = metrics.pr_curve(spark.createDataFrame(rows, "model string, pred_id bigint, score bigint, tp bigint"), spark.createDataFrame([("m", 130)], "model string, n_gt bigint"), ["model"])
    got = metrics.average_precision(points, ["model"]).first()["ap"]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    tp = np.cumsum([r[3] for r in sorted(rows, key=lambda r: (-r[2], r[1]))])
    prec, rec = tp / np.arange(1, 201), tp / 130
    env = np.maximum.accumulate(prec[::-1])[::-1]
    assert math.isclose(got, np.trapezoid(env, rec), abs_tol=1e-12)


def test_four_quarter_turns_are_none(spark):
    df = spark.createDataFrame([(1, 10, 20, 30, 50), (2, 0, 0, 0, 0)], "det_id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint")
    once = B.quarter_turns(df, F.lit(100), F.lit(80)).where("k = 1").drop("k")
    for size in ((80, 100), (100, 80), (80, 100)):
        once = B.quarter_turns(once, F.lit(size[0]), F.lit(size[1])).where("k = 1").drop("k")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, df.collect()))


def test_opposed_directions(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 180.0), (2, 350.0), (2, 10.0), (3, None)], "image_id bigint, azimuth double")
    got = {r["image_id"]: r for r in circular.consensus(df, "image_id", "azimuth").collect()}
    assert got[2]["n_inliers"] == 2 and min(got[2]["azimuth"], 360 - got[2]["azimuth"]) < 1e-6 and set(got) == {1, 2}


def test_tiles(spark):
    images = spark.createDataFrame([(1, 400, 400), (2, 300, 1000), (3, 401, 400)], "image_id bigint, width bigint, height bigint")
    got = {}
    for r in tiling.tile_grid(images, 400, 0.05, "gap").collect():
        got.setdefault(r["image_id"], []).append((r["x0"], r["y0"]))
    assert got[1] == [(0, 0)] and sorted(got[2]) == [(0, 0), (0, 380), (0, 760)] and sorted(got[3]) == [(0, 0), (380, 0)]
    box = spark.createDataFrame([(2, 1, 0, 10, 10, 20, 20), (2, 2, 0, 5000, 0, 5010, 10)], BOXES)
    by = {r["det_id"]: (r["tile_x"], r["tile_y"]) for r in tiling.first_tiles(box, tiling.tile_grid(images), 380, 400).collect()}
    assert by == {1: (0, 0), 2: (None, None)}
    crops = tiling.safe_crops(images, 3, 300).collect()
    assert len(crops) == 9 and all(0 <= r["x0"] and 0 <= r["y0"] for r in crops)


def test_split_keeps_images_together(spark):
    df = spark.range(1000).selectExpr("id", "id % 37 image_id", "id % 37 % 2 domain")
    out = joins.split(df, "image_id", 0.8, by="domain", least=1)
    folds = out.select("image_id", "fold").distinct().collect()
    assert len(folds) == 37 and sum(r["fold"] == "train" for r in folds) == int(19 * 0.8) + int(18 * 0.8)


def test_masks(spark):
    ring = [(1.0, 1.0), (5.0, 1.0), (5.0, 4.0), (1.0, 4.0), (1.0, 1.0)]
    df = spark.createDataFrame([(1, 1, [{"x": x, "y": y} for x, y in ring])], "obj_id bigint, image_id bigint, ring array<struct<x double, y double>>")
    assert df.select(spans.ring_area()).first()[0] == 12.0
    got = spans.ring_spans(df)
    assert sorted((r["y"], r["x0"], r["x1"]) for r in got.collect()) == [(1, 1, 5), (2, 1, 5), (3, 1, 5)]
    out = spans.outlines(got, 5).first()
    assert out["area"] == 12.0 and {(p["x"], p["y"]) for p in out["ring"]} == set(ring) and out["ring"][0] == out["ring"][-1]
    assert spans.outlines(got, 50).collect() == []
    rle = spark.createDataFrame([(1, 1, [0, 2, 3, 4], [3, 3])], "obj_id bigint, image_id bigint, counts array<int>, size array<int>")
    px = {(r["y"], r["x"]) for r in spans.rle_pixels(rle).collect()}
    flat = [1, 1, 0, 0, 0, 1, 1, 1, 1]
    assert px == {(k % 3, k // 3) for k, v in enumerate(flat) if v}
    text = spark.createDataFrame([("0234",)], "s string")
    assert text.select(spans.decoded_counts("s")).first()[0] == [0, 2, 3, 6]
    boxes = spark.createDataFrame([(1, 0, 0, 4, 4)], "box_id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint")
    parts = spark.createDataFrame([(1, "a", 0, 0, 2), (1, "b", 3, 3, 30), (1, "c", 9, 0, 90)], "box_id bigint, label string, y bigint, x0 bigint, x1 bigint")
    assert spans.largest_touching(parts, boxes).first()["label"] == "b" and spans.best_part(parts, boxes).first()["label"] == "a"
    assert spans.best_candidates(parts.withColumnRenamed("label", "candidate"), boxes).first()["candidate"] == "a"


def test_components(spark):
    rng = random.Random(4)
    on = {(rng.randrange(20), rng.randrange(20)) for _ in range(150)}
    px = spark.createDataFrame([(1, y, x) for y, x in on], "image_id bigint, y bigint, x bigint")
    got = {}
    for r in components.labelled(px).collect():
        for x in range(r["x0"], r["x1"]):
            got.setdefault(r["label"], set()).add((r["y"], x))
    left, want = set(on), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        want.append(part)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_scoring_goes_on_after_errors(spark):
    tiles = spark.createDataFrame([(1, 10, 20, 2, 2, [0, 200, 0, 0]), (2, 0, 0, 2, 2, [1, 2, 3]), (3, 0, 0, 1, 1, [255])], "image_id bigint, x0 bigint, y0 bigint, w bigint, h bigint, data array<int>")
    done = spark.createDataFrame([(3,)], "image_id bigint")
    rows = {r["image_id"]: r for r in scoring.scored(tiles, scoring.threshold_scorer, 0.1, done).collect()}
    assert set(rows) == {1, 2} and (rows[1]["xmin"], rows[1]["ymin"], rows[1]["xmax"]) == (11.0, 20.0, 12.0) and rows[2]["error"]
    assert {r["image_id"]: r["failed"] for r in scoring.progress(scoring.scored(tiles, scoring.threshold_scorer)).collect()} == {1: 0, 2: 1, 3: 0}


def test_files_round_trip(spark, tmp_path):
    det = spark.createDataFrame([(1, 7, 0.5, 0, 0, 4, 3, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 3.0}])], "image_id bigint, det_id bigint, score double, xmin bigint, ymin bigint, xmax bigint, ymax bigint, ring array<struct<x double, y double>>")
    writers.write_geojson(det, str(tmp_path / "g"))
    back = readers.read_predictions_geojson(spark, str(tmp_path / "g" / "*")).first()
    assert back["tree_id"] == 1 and back["score"] == 0.5 and len(back["ring"]) == 2 and back["bbox"] == [0, 0, 4, 3]
    written = json.loads(next((tmp_path / "g").glob("*/*.txt")).read_text())
    assert written["crs"] == {"type": "name", "properties": {"name": "EPSG:4326"}}
    (tmp_path / "low").mkdir()
    of = lambda **p: {"type": "Feature", "properties": p, "geometry": None}
    (tmp_path / "low" / "p.geojson").write_text(json.dumps({"features": [of(confidence=0.3), of(Confidence=0.4), of(score="0.5"), of(tree_id=7)]}))
    assert [r["score"] for r in readers.read_predictions_geojson(spark, str(tmp_path / "low")).collect()] == [0.3, 0.4, 0.5, 1.0]
    writers.write_box_csv(spark.createDataFrame([("a.tif", 1, 2, 3, 4, "Tree")], readers.BOX), str(tmp_path / "c"))
    row = readers.read_box_csv(spark, str(tmp_path / "c")).first()
    assert row["xmax"] == 3 and row["domain"] is None
    (tmp_path / "m").mkdir()
    a = [{"id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "segmentation": [[0, 0, 4, 0, 4, 4]]}, {"id": 2, "category_id": 1, "segmentation": [[1, 1, 9, 1, 9, 5]]}]
    (tmp_path / "m" / "x_meta.json").write_text(json.dumps({"image_id": "x", "coco_annotations": a}))
    (tmp_path / "m" / "y_meta.json").write_text(json.dumps({"coco_annotations": json.dumps(a)}))
    (tmp_path / "m" / "z_meta.json").write_text(json.dumps({"image_id": "z", "coco_annotations": "junk"}))
    meta = readers.read_tile_meta(spark, str(tmp_path / "m"))
    boxes = readers.annotation_boxes(meta).collect()
    assert {r["image_id"] for r in meta.collect()} == {"x", "unknown", "z"}
    assert sorted((r["image_id"], r["category"], r["xmin"], r["xmax"]) for r in boxes) == [("unknown", 1, 1, 9), ("unknown", 2, 1, 4), ("x", 1, 1, 9), ("x", 2, 1, 4)]
    (tmp_path / "a.csv").write_text("filename,shadow_azimuth,skipped\nf,10,false\ng,20,TRUE\nf,30,false\nh,40,\n")
    assert sorted(tuple(r) for r in readers.read_azimuth_csv(spark, str(tmp_path / "a.csv")).collect()) == [("f", 30.0), ("h", 40.0)]
    (tmp_path / "v.xml").write_text("<annotation><object><name>tree</name><bndbox><xmin>1.9</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>")
    assert readers.read_voc_boxes(spark, str(tmp_path / "v.xml"), "tree").first()["xmin"] == 1
    assert readers.list_images(spark, str(tmp_path), ("xml",)).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k % 30, "A" if k % 3 else "B", 1_700_000_000 + k) for k in range(100)]
    df = spark.createDataFrame(rows, "image_id bigint, biome_name string, t bigint").selectExpr("image_id", "biome_name", "timestamp_seconds(t) ts")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_tiles(stream, ["A"], str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(1, "A", 1_900_000_000), (500, "A", 1_900_000_000)], "image_id bigint, biome_name string, s bigint").selectExpr("image_id", "biome_name", "timestamp_seconds(s) ts").select(*df.columns).write.mode("append").parquet(str(tmp_path / "in"))
    rows.append((500, "A", 1_900_000_000))  # tile 1 comes again, years later
    ingest.ingest_tiles(stream, ["A"], str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["image_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted({r[0] for r in rows if r[1] == "A"})
    spark.createDataFrame([(None, "A", 1), (501, "A", 1)], "image_id bigint, biome_name string, s bigint").selectExpr("image_id", "biome_name", "timestamp_seconds(s) ts").write.mode("append").parquet(str(tmp_path / "in"))
    # the checkpoint is lost: all is looked at again, and what was written stays
    ingest.ingest_tiles(stream, ["A"], str(tmp_path / "out"), str(tmp_path / "other")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["image_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([*got, 501])
    # each run has the ids it saw in its state, and a batch of the only run reads nothing that was written
    alone = ingest.ingest_tiles(stream, ["A"], str(tmp_path / "alone"), str(tmp_path / "state")).trigger(availableNow=True).start()
    alone.awaitTermination()
    assert alone.lastProgress["stateOperators"][0]["numRowsTotal"] == len(got) + 1 and len(list((tmp_path / "alone").iterdir())) == 1
    values = spark.range(60).selectExpr("id % 7 tile_id", "id % 10 / 10.0 value").selectExpr("tile_id", "cast(value as double) value")
    values.repartition(3).write.parquet(str(tmp_path / "v"))
    live = ingest.live_metrics(spark.readStream.schema(values.schema).parquet(str(tmp_path / "v")))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["tile_id"], r["n_pred"], r["n_tp"]) for r in df.collect())
    assert key(spark.sql("select * from live")) == key(ingest.live_metrics(values))


def test_segmentations_of_all_kinds(spark, tmp_path):
    square = [[1, 1, 4, 1, 4, 3, 1, 3]]
    found = [{"score": 0.9, "category_id": 2, "segmentation": square}, {"category_id": 1, "segmentation": {"counts": [0, 2, 3, 4], "size": [3, 3]}}, {"segmentation": {"counts": "0234", "size": [3, 3]}}, {"segmentation": "junk"}, {"segmentation": None}]
    (tmp_path / "Prediction_1.json").write_text(json.dumps(found))
    rows = readers.read_detection_json(spark, str(tmp_path)).withColumns({"obj_id": F.monotonically_increasing_id(), "image_id": F.lit(1)})
    by = {r["obj_id"]: r for r in rows.collect()}
    assert [by[k]["kind"] for k in range(5)] == ["rings", "runs", "packed", "unknown", "unknown"] and [by[k]["score"] for k in range(3)] == [0.9, 0.0, 0.0]
    px = {}
    for r in spans.spans_of(rows).collect():
        px.setdefault(r["obj_id"], set()).update((r["y"], x) for x in range(r["x0"], r["x1"]))
    filled = lambda counts: {(k % 3, k // 3) for k, v in enumerate(v for j, n in enumerate(counts) for v in [j % 2] * n) if v}
    assert px == {0: {(y, x) for y in (1, 2) for x in (1, 2, 3)}, 1: filled([0, 2, 3, 4]), 2: filled([0, 2, 3, 6])}
    assert {r["kind"]: r["n"] for r in spans.kinds(rows).collect()} == {"rings": 1, "runs": 1, "packed": 1, "unknown": 2}


def test_tiles_without_predictions_count(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.1), (9, 0.5)], "image_id bigint, value double")
    truth = spark.createDataFrame([(1,), (2,), (2,), (3,)], "image_id bigint")
    tiles = spark.createDataFrame([(1,), (2,), (4,)], "image_id bigint")
    keys = ("n_pred", "n_tp", "n_gt", "precision", "recall", "mean_overlap")
    got = {r["image_id"]: tuple(r[k] for k in keys) for r in metrics.overlap_metrics(scored, truth, ["image_id"], evaluated=tiles).collect()}
    assert got == {1: (2, 1, 1, 0.5, 1.0, 0.5), 2: (0, 0, 2, 0.0, 0.0, 0.0), 4: (0, 0, 0, 0.0, 0.0, 0.0)}
    assert {r["image_id"] for r in metrics.overlap_metrics(scored, truth, ["image_id"]).collect()} == {1, 2, 3, 9}


def test_max_of_rest_of_one_large_group(spark):
    n = 20_000
    df = spark.range(n).selectExpr("1 g", "id rank", "cast((id * 7919) % 10007 as double) v")
    got = {r["rank"]: r["top"] for r in metrics.max_of_rest(df, ["g"], "rank", "v", "top").collect()}
    top, want = 0.0, {}
    for k in reversed(range(n)):
        top = max(top, float(k * 7919 % 10007))
        want[k] = top
    assert got == want


def test_row_split_prompts_and_domains(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 image_id")
    out = joins.split_rows(df, 0.8, "id")
    assert out.count() == 1000 and out.where("fold = 'train'").count() == 800 and out.repartition(7).where("fold = 'val'").select("id").distinct().count() == 200
    files = spark.createDataFrame([("/i/0",), ("/m/0",), ("/n/0",), ("/i/1",), ("/m/1",)], "path string")
    at = lambda d: F.concat(F.lit(f"/{d}/"), F.col("image_id"))
    assert {r["image_id"] for r in joins.prompts(df, files, at("i"), at("m"), at("n")).collect()} == {0}
    paths = spark.createDataFrame([("/x/WON_1.tif",), ("/x/bru.tif",), (None,)], "p string")
    assert [(r["domain"], r["azimuth"]) for r in joins.domain_of(paths, "p").collect()] == [("WON", 215), ("BRU", 118), ("BRU", 118)]
    assert joins.with_optional(paths, {"p": "string", "q": "double"}).columns == ["p", "q"]
    assert sorted({tuple(r) for r in df.select(*joins.random_flips(df, 3, "id")).collect()}) == [(False, False), (False, True), (True, False), (True, True)]


def test_azimuths_of_crops(spark):
    light = [[255.0 - 10 * x for x in range(8)] for _ in range(8)]  # dark to the east
    rows = [(1, 1, 8, 8, [v for r in light for v in r]), (1, 2, 8, 8, [1.0] * 64), (1, 3, 8, 8, [1.0])]
    crops = spark.createDataFrame(rows, "image_id bigint, crop_id bigint, h int, w int, data array<double>")
    got = {r["crop_id"]: r["azimuth"] for r in scoring.scored_azimuths(crops, scoring.brightness_slope_scorer).collect()}
    assert abs(got[1] - 90) < 1e-6 and got[2] is None and got[3] is None
    known = scoring.scored_azimuths(crops, scoring.brightness_slope_scorer).where("azimuth is not null")
    assert abs(circular.consensus(known, "image_id", "azimuth").first()["azimuth"] - 90) < 1e-6


def test_outline_is_simplified(spark):
    rows = [(1, 1, y, 5, 60 + (y % 2)) for y in range(40)]  # a right side of teeth of one pixel
    df = spark.createDataFrame(rows, "obj_id bigint, image_id bigint, y bigint, x0 bigint, x1 bigint")
    plain, simple = spans.outlines(df, most=0.0).first(), spans.outlines(df).first()
    assert len(plain["ring"]) > 40 and len(simple["ring"]) <= 7 and plain["area"] == simple["area"] == sum(r[4] - r[3] for r in rows)
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)])], "obj_id bigint, ring array<struct<x double, y double>>")
    assert tuple(ring.select(spans.ring_centroid().alias("c")).first()["c"]) == (2.0, 1.0)


def test_clear_boxes_and_rotated_copies(spark):
    px = spark.range(400).selectExpr("1L image_id", "id div 20 y", "id % 20 x", "if(id % 20 < 10, 0, 9) luma")
    rows = [(1, 1, 0, 0, 0, 10, 20), (1, 2, 0, 5, 0, 19, 20), (1, 3, 0, 10, 0, 19, 20)]
    boxes = spark.createDataFrame(rows, BOXES)
    assert [r["det_id"] for r in B.clear_enough(boxes, px).collect()] == [2]
    images = spark.createDataFrame([(1, 20, 20, 90.0, "WON")], "image_id bigint, width int, height int, azimuth double, domain string")
    turned = B.rotation_copies(boxes, images, copies=2, seed=3)
    assert turned.count() <= 6 and all(abs((90.0 - r["angle"]) % 360 - r["azimuth"]) < 1e-9 and r["image_name"] == f"1_rot{int(r['angle'])}" and 0 <= r["xmin"] < r["xmax"] <= 20 for r in turned.collect())
    assert B.rotation_copies(boxes, images, px=px).where("not (xmax - xmin >= 10 and ymax - ymin >= 10)").count() == 0


def test_written_metadata(spark, tmp_path):
    tiles = spark.createDataFrame([("a", 3, "x"), ("b", 4, None)], "image_id string, width int, biome_name string")
    writers.write_tile_meta(tiles, str(tmp_path / "t"))
    assert {json.loads(p.read_text())["width"] for p in (tmp_path / "t").glob("*/*.txt")} == {3, 4}
    m = spark.createDataFrame([("m0", 0.5), ("m1", 0.6)], "model string, ap double")
    writers.write_summary(m, spark.createDataFrame([("m0", 0.7)], "model string, f1 double"), str(tmp_path / "s"))
    assert {r["model"]: r["optimum"] and r["optimum"]["f1"] for r in spark.read.json(str(tmp_path / "s")).collect()} == {"m0": 0.7, "m1": None}
    tiles.write.parquet(str(tmp_path / "c"))
    assert readers.catalogue(spark, str(tmp_path / "c"), "image_id").columns == ["image_id"]
    assert readers.picked_sites([tiles, tiles], "image_id", "a", 1).count() == 1
