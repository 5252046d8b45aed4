"""Raster filters over tables of pixels: px(image_id, y, x, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .percentiles import percentiles

KEY = ["image_id", "y", "x"]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element of odd size: rows of half width round(c * sqrt(1 - (dy / r)^2))."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0
        out += [(dx, dy) for dx in range(-half, half + 1)]
    return out


def square(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


def _spread(px: DataFrame, offsets: list, *columns: str) -> DataFrame:
    """Each pixel's columns at the places that see it through an offset, with the offset's weight."""
    o = F.explode(F.array(*[F.struct(F.lit(d[0]).alias("dx"), F.lit(d[1]).alias("dy"), F.lit(float(d[2]) if len(d) > 2 else 1.0).alias("w")) for d in offsets]))
    moved = px.select(*KEY, *columns, o.alias("o"))
    return moved.select("image_id", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), *columns, F.col("o.w").alias("w"))


def dilated(mask: DataFrame, offsets: list) -> DataFrame:
    """Pixels that have a pixel of the mask at some offset."""
    return _spread(mask.select(*KEY), offsets).select(*KEY).distinct()


def eroded(mask: DataFrame, offsets: list, px: DataFrame | None = None) -> DataFrame:
    """Pixels of the mask all of whose offsets are in the mask; offsets outside the image px don't count."""
    if px is None:
        held = _spread(mask.select(*KEY), offsets).groupBy(*KEY).agg(F.count("*").alias("n"))
        return held.where(F.col("n") == len(offsets)).select(*KEY)
    rest = px.select(*KEY).join(mask.select(*KEY), KEY, "left_anti")
    return mask.select(*KEY).join(dilated(rest, offsets), KEY, "left_anti")


def opened(mask: DataFrame, offsets: list, px: DataFrame) -> DataFrame:
    return dilated(eroded(mask, offsets, px), offsets).join(px.select(*KEY), KEY, "left_semi")


def closed(mask: DataFrame, offsets: list, px: DataFrame) -> DataFrame:
    return eroded(dilated(mask, offsets).join(px.select(*KEY), KEY, "left_semi"), offsets, px)


def box(size: int) -> list[float]:
    """Equal weights of an odd number of places in a row."""
    return [1.0] * (size // 2 * 2 + 1)


def gaussian(sigma: float, size: int | None = None) -> list[float]:
    """Weights of the places in a row: ``size`` of them, else up to 3 sigma on either side."""
    r = size // 2 if size else int(math.ceil(3 * sigma))
    return [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]


def blur(size: int) -> list[float]:
    """Gaussian weights of an odd number of places, with the spread that goes with that size."""
    return gaussian(0.3 * ((size - 1) * 0.5 - 1) + 0.8, size)


def local_mean(px: DataFrame, value: str, weights: list[float], name: str) -> DataFrame:
    """px with the weighted mean of ``value`` over the square around each pixel, as far as it lies in the image.

    A square's weights are products of those of its rows and columns, so rows are summed first and then columns: twice
    as many rows as a side has places, not as many as the square has."""
    r = len(weights) // 2
    across, down = [(d - r, 0, w) for d, w in enumerate(weights)], [(0, d - r, w) for d, w in enumerate(weights)]
    rows = _spread(px, across, value).groupBy(*KEY).agg(F.sum(F.col(value) * F.col("w")).alias("_v"), F.sum("w").alias("_n"))
    both = _spread(rows, down, "_v", "_n").groupBy(*KEY).agg((F.sum(F.col("_v") * F.col("w")) / F.sum(F.col("_n") * F.col("w"))).alias(name))
    return px.join(both, KEY)


def rescaled(px: DataFrame, value: str) -> DataFrame:
    """Values of images whose greatest is over 255, brought to 0..255."""
    top = px.groupBy("image_id").agg(F.max(value).alias("_top"))
    return px.join(top, "image_id").withColumn(value, F.when(F.col("_top") > 255, F.floor(F.col(value) * 255 / F.col("_top"))).otherwise(F.col(value))).drop("_top")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def valid(px: DataFrame, value: str = "luma", size: int = 7) -> DataFrame:
    """Pixels over 15 and under 250, eroded by an ellipse."""
    return eroded(px.where((F.col(value) > 15) & (F.col(value) < 250)), ellipse(size), px)


def ray(azimuth: float, near: int, far: int, steps: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Offsets along the shadow's azimuth, where the lit side is looked for, and against it, at ``steps`` rounded
    distances."""
    ds = sorted({round(near + (far - near) * k / (steps - 1)) for k in range(max(steps, 2))})
    sx, sy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
    shadow = [(round(d * sx), round(d * sy)) for d in ds]
    return shadow, [(-x, -y) for x, y in shadow]


def directional_gradient(px: DataFrame, azimuth: float, near: int, far: int, steps: int, value: str = "luma", penalty: float = 0.4, name: str = "dg") -> DataFrame:
    """px with how much brighter the brightest pixel on the lit side is, less ``penalty`` times the same on the other;
    0 at least, and 0 at pixels that aren't valid. Pixels that aren't valid give no light."""
    sun, anti = ray(azimuth, near, far, steps)
    good = valid(px, value)
    light = px.join(good, KEY, "left_semi")
    best = lambda offsets, c: _spread(light, offsets, value).groupBy(*KEY).agg(F.max(value).alias(c))
    both = px.join(best(sun, "_s"), KEY, "left").join(best(anti, "_a"), KEY, "left").join(good.withColumn("_v", F.lit(1)), KEY, "left")
    up = lambda c: F.greatest(F.coalesce(F.col(c), F.col(value)) - F.col(value), F.lit(0))
    return both.withColumn(name, F.when(F.col("_v") == 1, F.greatest(up("_s") - penalty * up("_a"), F.lit(0.0))).otherwise(0.0)).drop("_s", "_a", "_v")


def shadow_map(px: DataFrame, azimuth: float, value: str = "luma", top_luma: float = 71.0, norm: float | None = None, centre: float = 0.35, slope: float = 12.0, floor: float = 0.2, least: int = 150) -> DataFrame:
    """px with ``p``, the chance of shadow: short and long gradients weighed alike, over the norm (else the image's
    greatest, 30 at least), less where it is bright or where edges run along the shadow, through a sigmoid; small values
    and specks are 0."""
    from .components import without_specks

    short = local_mean(directional_gradient(px, azimuth, 8, 35, 8, value, name="_d1"), "_d1", gaussian(2.0), "_g1")
    both = short.join(local_mean(directional_gradient(px, azimuth, 35, 150, 12, value, name="_d2"), "_d2", gaussian(4.0), "_g2").select(*KEY, "_g2"), KEY)
    good = valid(px, value).withColumn("_v", F.lit(1))
    dg = both.join(good, KEY, "left").withColumn("_dg", F.when(F.col("_v") == 1, 0.5 * F.col("_g1") + 0.5 * F.col("_g2")).otherwise(0.0))
    dg = dg.join(lateral_penalty(px, azimuth, value).select(*KEY, "_side"), KEY)
    tops = dg.groupBy("image_id").agg(F.greatest(F.max("_dg"), F.lit(30.0)).alias("_top"))
    dark = F.greatest(F.least((top_luma - F.col(value)) / 20.0, F.lit(1.0)), F.lit(0.0))
    own = F.least(F.col("_dg") / (F.lit(max(norm, 1.0)) if norm else F.col("_top")), F.lit(1.0))
    scaled = dg.join(tops, "image_id").withColumn("_n", own * dark * F.col("_side"))
    p = 1 / (1 + F.exp(-slope * (F.col("_n") - centre)))
    scaled = scaled.withColumn("p", F.when((F.col("_v") == 1) & (p >= floor), p).otherwise(0.0))
    kept = without_specks(scaled.where("p > 0").select(*KEY), least).withColumn("_k", F.lit(1))
    return scaled.join(kept, KEY, "left").select(*px.columns, F.when(F.col("_k") == 1, F.col("p")).otherwise(0.0).alias("p"))


def sobel(px: DataFrame, value: str = "luma") -> DataFrame:
    """px with the Sobel derivatives gx and gy; beyond the image's edge values are mirrored about the edge pixel."""
    k = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    seen = _spread(px, [(dx, dy, (dx + 2) * 10 + dy + 2) for dx, dy in k], value)
    at = seen.groupBy(*KEY).agg(*[F.max(F.when(F.col("w") == (dx + 2) * 10 + dy + 2, F.col(value))).alias(f"_{dx + 1}{dy + 1}") for dx, dy in k])
    both = px.join(at, KEY)
    v = {(dx, dy): F.col(f"_{dx + 1}{dy + 1}") for dx, dy in k} | {(0, 0): F.col(value)}

    def value_at(dx, dy):
        """The mirrored place where there is none."""
        return F.coalesce(v[dx, dy], *[v[x, y] for x, y in ((-dx, dy), (dx, -dy), (-dx, -dy)) if (x, y) != (dx, dy)], F.col(value)).cast("double")

    gx = sum(((2 if dy == 0 else 1) * (value_at(1, dy) - value_at(-1, dy)) for dy in (-1, 0, 1)), F.lit(0.0))
    gy = sum(((2 if dx == 0 else 1) * (value_at(dx, 1) - value_at(dx, -1)) for dx in (-1, 0, 1)), F.lit(0.0))
    return both.select(*px.columns, gx.alias("gx"), gy.alias("gy"))


def lateral_penalty(px: DataFrame, azimuth: float, value: str = "luma") -> DataFrame:
    """px with ``_side``: 1.5 less half the ratio of the slope across the shadow's direction to that along it, within
    0..1; both slopes smoothed over 5 x 5 places."""
    sx, sy = math.sin(math.radians(azimuth)), -math.cos(math.radians(azimuth))
    slopes = sobel(px.select(*KEY, value), value).select(*KEY, F.abs(F.col("gx") * sx + F.col("gy") * sy).alias("_along"), F.abs(F.col("gx") * -sy + F.col("gy") * sx).alias("_across"))
    smooth = local_mean(local_mean(slopes, "_along", gaussian(2.0, 5), "_a"), "_across", gaussian(2.0, 5), "_c")
    return smooth.select(*KEY, F.greatest(F.least(1.5 - F.col("_c") / (F.col("_a") + 1e-3) * 0.5, F.lit(1.0)), F.lit(0.0)).alias("_side"))


def isotropic_map(px: DataFrame, value: str = "luma", near: int = 8, far: int = 35, steps: int = 8) -> DataFrame:
    """px with the mean gradient over eight azimuths."""
    every = None
    for a in range(0, 360, 45):
        one = directional_gradient(px, float(a), near, far, steps, value).select(*KEY, "dg")
        every = one if every is None else every.unionByName(one)
    return px.join(every.groupBy(*KEY).agg(F.avg("dg").alias("iso")), KEY)


def darker_than_surroundings(px: DataFrame, share: float = 0.7, size: int = 51, value: str = "luma", tidy: int = 5) -> DataFrame:
    """Pixels under ``share`` of the weighted mean around them, opened and closed by a square of ``tidy`` (0: as they are)."""
    mask = local_mean(px, value, blur(size), "_m").where(F.col(value) < share * F.col("_m")).select(*KEY)
    return tidied(mask, tidy, px)


def tidied(mask: DataFrame, size: int, px: DataFrame) -> DataFrame:
    """The mask opened and closed by a square of the size; 0: as it is."""
    return closed(opened(mask, square(size), px), square(size), px) if size else mask


def darkest(px: DataFrame, share: float = 0.2, value: str = "luma", tidy: int = 5, least: int = 51) -> DataFrame:
    """Pixels under the image's percentile, opened and closed by a square of ``tidy``, in components of at least ``least``."""
    from .components import without_specks

    cut = px.groupBy("image_id").agg(F.percentile(value, share).alias("_cut"))
    mask = tidied(px.join(cut, "image_id").where(F.col(value) < F.col("_cut")).select(*KEY), tidy, px)
    return without_specks(mask, least) if least > 1 else mask


def otsu(px: DataFrame, value: str = "luma") -> DataFrame:
    """image_id, threshold: the value of 0..255 that parts the histogram with the greatest variance between the parts
    (the least such value)."""
    hist = px.groupBy("image_id", F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    w, every = Window.partitionBy("image_id").orderBy("v"), Window.partitionBy("image_id")  # 256 rows at most
    v = hist.select("image_id", "v", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(every).alias("w"), F.sum(F.col("n") * F.col("v")).over(every).alias("s"))
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    gap = F.try_divide(F.col("s0").cast("double"), F.col("w0").cast("double")) - F.try_divide(s1.cast("double"), w1.cast("double"))
    between = F.coalesce(F.col("w0").cast("double") * w1.cast("double") * gap * gap, F.lit(0.0))
    return v.withColumn("b", between).groupBy("image_id").agg(F.max(F.struct("b", (-F.col("v")).alias("v"))).alias("m")).select("image_id", (-F.col("m.v")).alias("threshold"))


def subtracted(mask: DataFrame, other: DataFrame, size: int, px: DataFrame) -> DataFrame:
    """The mask without what the other, dilated by a square of the size, covers; closed by a square of 3."""
    left = mask.select(*KEY).join(dilated(other, square(size)), KEY, "left_anti")
    return closed(left, square(3), px)


def without_canopy(shadow: DataFrame, canopy: DataFrame) -> DataFrame:
    """Shadow where no canopy is: canopy has priority."""
    return shadow.select(*KEY).join(canopy.select(*KEY), KEY, "left_anti")


def shadow_likeness(r: Column, g: Column, b: Column) -> Column:
    """Dark and bluish: (1 - luma) + (blue - red), of channels in 0..1."""
    return (1 - luma(r, g, b)) + (b - r)


def likeness_map(px: DataFrame, name: str = "likeness") -> DataFrame:
    """px (with r, g, b in 0..1) with the shadow likeness, smoothed over 7 x 7 places."""
    raw = px.withColumn("_s", shadow_likeness(F.col("r"), F.col("g"), F.col("b")))
    return local_mean(raw, "_s", gaussian(3.0, 7), name).drop("_s")


def contrast(px: DataFrame, factor: float, value: str = "luma") -> DataFrame:
    """Values moved away from the image's mean by a factor, within 0..255."""
    mean = px.groupBy("image_id").agg(F.avg(value).alias("_m"))
    return px.join(mean, "image_id").withColumn(value, F.greatest(F.least((F.col(value) - F.col("_m")) * factor + F.col("_m"), F.lit(255.0)), F.lit(0.0))).drop("_m")


def saturated(px: DataFrame, boost: float = 0.2) -> DataFrame:
    """px with the saturation of r, g, b raised by a share of itself, at most to full; hue and value stay."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    # a channel's distance from the greatest one is in proportion to the saturation
    more = F.least(F.lit(1.0 + boost), F.coalesce(F.try_divide(top.cast("double"), (top - low).cast("double")), F.lit(1.0)))
    return px.withColumns({c: top - (top - F.col(c)) * more for c in ("r", "g", "b")})


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of sRGB channels in 0..255."""
    lin = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 255.0 / 12.92) for c in (r, g, b)]
    x = (0.412453 * lin[0] + 0.357580 * lin[1] + 0.180423 * lin[2]) / 0.950456
    y = 0.212671 * lin[0] + 0.715160 * lin[1] + 0.072169 * lin[2]
    z = (0.019334 * lin[0] + 0.119193 * lin[1] + 0.950227 * lin[2]) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    return F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y), 500 * (f(x) - f(y)), 200 * (f(y) - f(z))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value in 0..1 of channels in 0..255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.when(top > low, (top - low).cast("double"))
    hue = F.when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60
    return F.coalesce(F.pmod(hue, F.lit(360.0)), F.lit(0.0)), F.coalesce(F.try_divide(d, top.cast("double")), F.lit(0.0)), top / 255.0


#: Methods by name: pixels with luma, r, g, b to the pixels of the mask.
METHODS = {
    "lab": lambda px: without_canopy(lab_shadow(px), lab_canopy(px)),
    "chromaticity": lambda px: chromatic_shadow(px),
    "gradient": lambda px: darker_than_surroundings(px, 0.6, 31),
    "combined": lambda px: combined_shadow(px),
    "adaptive": lambda px: darker_than_surroundings(px, 0.7, 51),
    "aggressive": lambda px: darkest(px, 0.2),
    "otsu": lambda px: tidied(px.join(otsu(px), "image_id").where(F.col("luma") < 0.8 * F.col("threshold")).select(*KEY), 5, px),
}


def compared(px: DataFrame, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """method, image_id, coverage in percent; 0 where a method finds nothing."""
    total = px.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    every = None
    for m in methods:
        one = METHODS[m](px).groupBy("image_id").agg(F.count("*").alias("k")).withColumn("method", F.lit(m))
        every = one if every is None else every.unionByName(one)
    return total.join(every, ["image_id", "method"], "left").select("method", "image_id", (100.0 * F.coalesce("k", F.lit(0)) / F.col("n")).alias("coverage"))


def lab_shadow(px: DataFrame, share: float = 0.25, least: int = 100) -> DataFrame:
    """Pixels (with r, g, b) of the darkest ``share`` by lightness that aren't green (a* over -5), opened and closed by a
    5 x 5 ellipse, without specks."""
    from .components import without_specks

    l, a, _ = lab(F.col("r"), F.col("g"), F.col("b"))
    seen = px.select(*KEY, l.alias("_l"), a.alias("_a"))
    cut = percentiles(seen, ["image_id"], "_l", [share]).select("image_id", F.col("value").alias("_cut"))
    mask = seen.join(cut, "image_id").where("_l < _cut and _a > -5").select(*KEY)
    return without_specks(closed(opened(mask, ellipse(5), px), ellipse(5), px), least)


def lab_canopy(px: DataFrame, top: float = -5.0, least: int = 100) -> DataFrame:
    """Green pixels: a* under ``top``, opened and closed, without specks."""
    from .components import without_specks

    _, a, _ = lab(F.col("r"), F.col("g"), F.col("b"))
    mask = px.where(a < top).select(*KEY)
    return without_specks(closed(opened(mask, ellipse(5), px), ellipse(5), px), least)


def chromatic_shadow(px: DataFrame, size: int = 31, share: float = 0.7, saturation: float = 0.6, least: int = 50) -> DataFrame:
    """Pixels darker than around them in lightness and in value, of low saturation, opened and closed, without specks."""
    from .components import without_specks

    l, _, _ = lab(F.col("r"), F.col("g"), F.col("b"))
    _, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    seen = px.select(*KEY, l.alias("_l"), s.alias("_s"), v.alias("_v0"))
    means = local_mean(local_mean(seen, "_l", blur(size), "_ml"), "_v0", blur(size), "_mv")
    mask = means.where((F.col("_l") < share * F.col("_ml")) & (F.col("_v0") < share * F.col("_mv")) & (F.col("_s") < saturation)).select(*KEY)
    return without_specks(closed(opened(mask, square(5), px), square(5), px), least)


def combined_shadow(px: DataFrame, share: float = 0.6, size: int = 51, votes: int = 1) -> DataFrame:
    """Pixels (with r, g, b) that at least ``votes`` of two hold: the chromatic method, and an intensity under ``share``
    of that around it; opened and closed."""
    grey = px.withColumn("_i", (F.col("r") + F.col("g") + F.col("b")) / 3.0)
    low = local_mean(grey, "_i", blur(size), "_mi").where(F.col("_i") < share * F.col("_mi"))
    mask = voted([chromatic_shadow(px, size, share), low], votes)
    return closed(opened(mask, square(5), px), square(5), px)


def voted(masks: list[DataFrame], votes: int = 1) -> DataFrame:
    """Pixels that at least ``votes`` of the masks hold."""
    every = masks[0].select(*KEY).distinct()
    for m in masks[1:]:
        every = every.unionByName(m.select(*KEY).distinct())
    return every.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= votes).select(*KEY)


def noisy(px: DataFrame, shadow: DataFrame, value: str = "luma", inside: float = 5.0, outside: float = 30.0, seed: int = 1) -> DataFrame:
    """Values with normal noise, less of it in shadow, within 0..255. A pixel's noise comes from a hash of its place and
    the seed, so it is the same however the pixels are dealt."""
    both = px.join(shadow.select(*KEY).withColumn("_in", F.lit(True)), KEY, "left")
    u, v = ((F.pmod(F.xxhash64(F.lit(seed + k), *KEY), F.lit(1 << 30)) + 0.5) / float(1 << 30) for k in (0, 1))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    return both.withColumn(value, F.greatest(F.least(F.col(value) + normal * F.when(F.col("_in"), inside).otherwise(outside), F.lit(255.0)), F.lit(0.0))).drop("_in")


#: Noise by name: pixels, the pixels in shadow and a seed to pixels with noise.
NOISE = {
    "none": lambda px, shadow, seed: px,
    "albumentations": lambda px, shadow, seed: noisy(px, shadow.limit(0), outside=math.sqrt(30.0), seed=seed),
    "sana": lambda px, shadow, seed: noisy(px, shadow, seed=seed),
}


def with_noise(px: DataFrame, shadow: DataFrame, mode: str = "none", seed: int = 1) -> DataFrame:
    """px with the noise of a mode of NOISE."""
    if mode not in NOISE:
        raise ValueError(f"unknown noise mode: {mode}")
    return NOISE[mode](px, shadow, seed)


def negative_points(shadow: DataFrame, boxes: DataFrame, more: int = 2, seed: int = 1) -> DataFrame:
    """box_id, point, px, py in shares of the box: the mean of the shadow in the box (point 0) and ``more`` of its
    pixels, in the order of a seeded hash."""
    rows = boxes.select("box_id", "image_id", "xmin", "xmax", F.explode(F.sequence(F.col("ymin").cast("bigint"), F.col("ymax").cast("bigint") - 1)).alias("y"))
    inside = shadow.join(rows, ["image_id", "y"]).where("x >= xmin and x < xmax").drop("xmin", "xmax")
    mean = inside.groupBy("box_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("box_id", F.lit(0).alias("point"), "x", "y")
    order = F.row_number().over(Window.partitionBy("box_id").orderBy((F.col("x") * 7919 + F.col("y") * 104729 + seed) % 10007, "y", "x"))
    some = inside.withColumn("point", order).where(F.col("point") <= more).select("box_id", "point", F.col("x").cast("double"), F.col("y").cast("double"))
    own = boxes.select("box_id", "xmin", "ymin", "xmax", "ymax")
    share = lambda c, lo, hi: ((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)))
    return mean.unionByName(some).join(own, "box_id").select("box_id", "point", share("x", "xmin", "xmax").alias("px"), share("y", "ymin", "ymax").alias("py"))


def nearest_resized(px: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels of the resized images, each the one at its scaled place. sizes: image_id, height, width, new_height,
    new_width, a row an image."""
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c).cast("bigint") - 1))
    grid = sizes.where("new_height > 0 and new_width > 0").select("*", upto("new_height").alias("ny")).select("*", upto("new_width").alias("nx"))
    at = grid.select("image_id", "ny", "nx", F.floor(F.col("ny") * F.col("height") / F.col("new_height")).alias("y"), F.floor(F.col("nx") * F.col("width") / F.col("new_width")).alias("x"))
    return at.join(px, KEY).drop("y", "x").withColumnsRenamed({"ny": "y", "nx": "x"})
