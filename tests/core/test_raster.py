"""Raster operators held against numpy on one small image."""

import math

import numpy as np
import pytest

from crownwork.operators import components, raster

H, W = 30, 34


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(8)
    a = rng.integers(20, 240, (H, W)).astype(float)
    a[5:20, 8:22] = rng.integers(20, 60, (15, 14))
    return a


@pytest.fixture(scope="module")
def px(spark, image):
    rows = [(1, y, x, int(image[y, x]), int(image[y, x] * 7 % 256), int(image[y, x] * 13 % 256)) for y in range(H) for x in range(W)]
    df = spark.createDataFrame(rows, "image_id bigint, y bigint, x bigint, r bigint, g bigint, b bigint").withColumnRenamed("r", "luma")
    return df.withColumn("r", df["luma"]).repartition(3)


def grid(df, column=None, empty=0.0):
    out = np.full((H, W), empty)
    for r in df.collect():
        out[r["y"], r["x"]] = 1 if column is None else r[column]
    return out


def shifted(a, dy, dx, fill=np.nan):
    out = np.full(a.shape, fill)
    if abs(dy) >= H or abs(dx) >= W:
        return out
    ys, xs = slice(max(0, -dy), min(H, H - dy)), slice(max(0, -dx), min(W, W - dx))
    out[ys, xs] = a[max(0, dy) : H + min(0, dy), max(0, dx) : W + min(0, dx)]
    return out


def mean(a, weights):
    r, v, n = len(weights) // 2, np.zeros(a.shape), np.zeros(a.shape)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            s, w = shifted(a, dy, dx), weights[dy + r] * weights[dx + r]
            v, n = v + np.where(np.isnan(s), 0, s) * w, n + ~np.isnan(s) * w
    return v / n


def dilate(m, offsets):
    return np.max([shifted(m, dy, dx, 0) for dx, dy in offsets], axis=0)


def tidy(m, size):
    o = raster.square(size)
    erode = lambda m: 1 - dilate(1 - m, o)
    return erode(dilate(dilate(erode(m), o), o))


def test_means(image, px):
    for weights in (raster.box(5), raster.gaussian(2.0), raster.blur(51), raster.gaussian(3.0, 7)):
        assert np.allclose(grid(raster.local_mean(px, "luma", weights, "m"), "m"), mean(image, weights))
    assert len(raster.gaussian(3.0, 7)) == 7 and math.isclose(raster.blur(51)[24], math.exp(-1 / (2 * 8.0**2)), rel_tol=1e-9)


def test_morphology_and_dark_masks(image, px):
    m = (image < 90).astype(float)
    mask = px.where("luma < 90").select(*raster.KEY)
    o = raster.square(3)
    erode = lambda m: 1 - dilate(1 - m, o)
    assert (grid(raster.opened(mask, o, px)) == dilate(erode(m), o)).all() and (grid(raster.closed(mask, o, px)) == erode(dilate(m, o))).all()
    assert (grid(raster.darker_than_surroundings(px, 0.7, 21)) == tidy((image < 0.7 * mean(image, raster.blur(21))).astype(float), 5)).all()
    assert (grid(raster.darkest(px, 0.3, tidy=3, least=1)) == tidy((image < np.quantile(image, 0.3)).astype(float), 3)).all()
    left = (image < 100) * (1 - dilate((image > 200).astype(float), o))
    assert (grid(raster.subtracted(px.where("luma < 100"), px.where("luma > 200"), 3, px)) == erode(dilate(left, o))).all()


def slopes(image):
    p = np.pad(image, 1, mode="reflect")
    at = lambda dy, dx: p[1 + dy : 1 + dy + H, 1 + dx : 1 + dx + W]
    gx = sum((2 if d == 0 else 1) * (at(d, 1) - at(d, -1)) for d in (-1, 0, 1))
    gy = sum((2 if d == 0 else 1) * (at(1, d) - at(-1, d)) for d in (-1, 0, 1))
    return gx, gy


def test_sobel(image, px):
    found = raster.sobel(px)
    gx, gy = slopes(image)
    assert np.allclose(grid(found, "gx"), gx) and np.allclose(grid(found, "gy"), gy)


def gradient(image, valid, azimuth, near, far, steps, sigma):
    sun, anti = raster.ray(azimuth, near, far, steps)
    lit = np.where(valid > 0, image, np.nan)
    best = lambda offsets: np.nanmax([image, *[shifted(lit, dy, dx) for dx, dy in offsets]], axis=0) - image
    dg = np.where(valid > 0, np.maximum(best(sun) - 0.4 * best(anti), 0), 0)
    return mean(dg, raster.gaussian(sigma))


def test_shadow_map_by_definition(image, px):
    azimuth = 215.0
    valid = 1 - dilate(1 - ((image > 15) & (image < 250)).astype(float), raster.ellipse(7))
    dg = (0.5 * gradient(image, valid, azimuth, 8, 35, 8, 2.0) + 0.5 * gradient(image, valid, azimuth, 35, 150, 12, 4.0)) * valid
    gx, gy = slopes(image)
    sx, sy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
    along, across = mean(np.abs(gx * sx + gy * sy), raster.gaussian(2.0, 5)), mean(np.abs(-gx * sy + gy * sx), raster.gaussian(2.0, 5))
    base = np.clip(dg / max(dg.max(), 30), 0, 1) * np.clip((71 - image) / 20, 0, 1) * np.clip(1.5 - across / (along + 1e-3) * 0.5, 0, 1)
    p = 1 / (1 + np.exp(-12 * (base - 0.35)))
    p = np.where(p >= 0.2, p, 0) * valid
    assert np.allclose(grid(raster.shadow_map(px, azimuth, least=1), "p"), p) and p.max() > 0.2
    kept = grid(raster.shadow_map(px, azimuth, least=5), "p")
    assert ((kept == 0) | np.isclose(kept, p)).all() and (kept > 0).sum() < (p > 0).sum()


def test_colours(image, px):
    import colorsys

    for r in px.select("r", "g", "b", *[c.alias(n) for c, n in zip(raster.hsv(px["r"], px["g"], px["b"]), "hsv")]).limit(200).collect():
        h, s, v = colorsys.rgb_to_hsv(r[0] / 255, r[1] / 255, r[2] / 255)
        assert math.isclose(r["h"], h * 360, abs_tol=1e-6) and math.isclose(r["s"], s, abs_tol=1e-9) and math.isclose(r["v"], v, abs_tol=1e-9)
    boosted = raster.saturated(px.select(*raster.KEY, "r", "g", "b")).join(px.selectExpr("image_id", "y", "x", "r r0", "g g0", "b b0"), raster.KEY).limit(200)
    for r in boosted.collect():
        h, s, v = colorsys.rgb_to_hsv(r["r0"] / 255, r["g0"] / 255, r["b0"] / 255)
        want = [255 * c for c in colorsys.hsv_to_rgb(h, min(1.0, s * 1.2), v)]
        assert np.allclose([r["r"], r["g"], r["b"]], want, atol=1e-6)
    black = px.sparkSession.createDataFrame([(0, 0, 0), (255, 255, 255), (0, 255, 0)], "r bigint, g bigint, b bigint")
    l, a, b = raster.lab(black["r"], black["g"], black["b"])
    got = np.array([tuple(r) for r in black.select(l, a, b).collect()])
    assert np.allclose(got, [[0, 0, 0], [100, 0, 0], [87.73, -86.18, 83.18]], atol=0.05)


def test_methods_and_their_masks(px):
    rows = {r["method"]: r["coverage"] for r in raster.compared(px).collect()}
    assert set(rows) == set(raster.METHODS) and all(0 <= v <= 100 for v in rows.values()) and rows["adaptive"] > 0 and rows["otsu"] > 0
    chroma, low = raster.chromatic_shadow(px, 51, 0.6, least=1), raster.combined_shadow(px)
    assert chroma.join(low, raster.KEY, "left_anti").count() <= chroma.count()
    assert raster.without_canopy(raster.lab_shadow(px, least=1), raster.lab_canopy(px, least=1)).join(raster.lab_canopy(px, least=1), raster.KEY, "left_semi").count() == 0


def test_noise_modes(px):
    shadow = px.where("luma < 90").select(*raster.KEY)
    assert raster.with_noise(px, shadow).collect() == px.collect()
    one, two = (raster.with_noise(px.repartition(n), shadow, "sana", 5).select("y", "x", "luma") for n in (1, 7))
    assert sorted(one.collect()) == sorted(two.collect())
    both = raster.noisy(px.selectExpr("image_id", "y", "x", "128.0 luma"), shadow, inside=5.0, outside=30.0)
    dark = {(r["y"], r["x"]) for r in shadow.collect()}
    parts = {True: [], False: []}
    for r in both.collect():
        parts[(r["y"], r["x"]) in dark].append(r["luma"] - 128)
    assert 4 < np.std(parts[True]) < 6 and 26 < np.std(parts[False]) < 33 and abs(np.mean(parts[False])) < 4
    with pytest.raises(ValueError):
        raster.with_noise(px, shadow, "other")


def test_negative_points(spark):
    shadow = spark.createDataFrame([(1, y, x) for y in range(2, 6) for x in range(3, 7)], "image_id bigint, y bigint, x bigint")
    boxes = spark.createDataFrame([(7, 1, 2, 2, 12, 12), (8, 1, 20, 20, 30, 30)], "box_id bigint, image_id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint")
    rows = {r["point"]: (r["px"], r["py"]) for r in raster.negative_points(shadow, boxes).collect()}
    assert set(rows) == {0, 1, 2} and rows[0] == ((4.5 - 2) / 10, (3.5 - 2) / 10) and all(0 <= a <= 1 and 0 <= b <= 1 for a, b in rows.values())


def test_crown_proposals(spark):
    shadow = spark.createDataFrame([(1, y, x, 0.9) for y in range(20, 40) for x in range(30, 50)], "image_id bigint, y bigint, x bigint, p double")
    from pyspark.sql import functions as F

    r = components.crown_proposals(shadow, "p", F.lit(90.0), 200, 200).first()  # along x: the near end is the left side
    assert (r["xmin"], r["ymin"], r["xmax"], r["ymax"]) == (0, 0, 63, 74)  # 30.5 - 12 + 45 and 29.5 + 45, cut to whole numbers
    assert components.crown_proposals(shadow, "p", F.lit(270.0), 200, 10, box=10).isEmpty()  # beyond the image: no box
