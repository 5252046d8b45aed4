"""Box geometry as column expressions. Boxes are xmin, ymin, xmax, ymax; pixel y grows downward; azimuths are degrees
clockwise from north."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("xmin", "ymin", "xmax", "ymax")


def area(p: str = "") -> Column:
    return (F.col(f"{p}xmax") - F.col(f"{p}xmin")) * (F.col(f"{p}ymax") - F.col(f"{p}ymin"))


def intersection(a: str, b: str) -> Column:
    """Common area of the boxes whose columns begin with a and b; 0 where they are apart."""
    dx = F.least(f"{a}xmax", f"{b}xmax") - F.greatest(f"{a}xmin", f"{b}xmin")
    dy = F.least(f"{a}ymax", f"{b}ymax") - F.greatest(f"{a}ymin", f"{b}ymin")
    return F.greatest(dx, F.lit(0)) * F.greatest(dy, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def clean(df: DataFrame, width: Column, height: Column, least_area: int = 50) -> DataFrame:
    """Boxes cleaned for training, with ``reason``: too small, empty (after clamping into the image), or null if kept."""
    clamp = lambda c, top: F.greatest(F.least(F.col(c), top - 1), F.lit(0))
    sized = df.withColumn("small", area() < least_area)
    clamped = sized.withColumns({"xmin": clamp("xmin", width), "ymin": clamp("ymin", height), "xmax": clamp("xmax", width), "ymax": clamp("ymax", height)})
    empty = (F.col("xmax") <= F.col("xmin")) | (F.col("ymax") <= F.col("ymin"))
    return clamped.withColumn("reason", F.when(F.col("small"), "too small").when(empty, "empty")).drop("small")


def to_xywh(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("xmin").alias("x"), F.col("ymin").alias("y"), (F.col("xmax") - F.col("xmin")).alias("w"), (F.col("ymax") - F.col("ymin")).alias("h"))


def from_xywh(df: DataFrame) -> DataFrame:
    return df.withColumns({"xmin": F.col("x"), "ymin": F.col("y"), "xmax": F.col("x") + F.col("w"), "ymax": F.col("y") + F.col("h")})


def shrink(df: DataFrame, when: Column, share: float = 0.5) -> DataFrame:
    """Boxes that ``when`` holds for keep their centre and ``share`` of their area."""
    side = share**0.5
    out = {}
    for lo, hi in (("xmin", "xmax"), ("ymin", "ymax")):
        mid, half = (F.col(lo) + F.col(hi)) / 2, (F.col(hi) - F.col(lo)) * side / 2
        out |= {lo: F.when(when, mid - half).otherwise(F.col(lo).cast("double")), hi: F.when(when, mid + half).otherwise(F.col(hi).cast("double"))}
    return df.withColumns(out)


def expand(df: DataFrame, width: Column, height: Column, share: float = 0.25) -> DataFrame:
    """Boxes grown by ``share`` of their sides on each side, truncated, within the image."""
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    cut = lambda c: c.cast("int")
    return df.withColumns(
        {
            "xmin": F.greatest(cut(F.col("xmin") - w * share), F.lit(0)),
            "ymin": F.greatest(cut(F.col("ymin") - h * share), F.lit(0)),
            "xmax": F.least(cut(F.col("xmax") + w * share), width.cast("int")),
            "ymax": F.least(cut(F.col("ymax") + h * share), height.cast("int")),
        }
    )


def normalised(df: DataFrame, x0: Column, y0: Column, w: Column, h: Column) -> DataFrame:
    """cx, cy, bw, bh: the box in shares of a crop."""
    return df.select(
        "*",
        ((F.col("xmin") + F.col("xmax")) / 2.0 - x0).__truediv__(w).alias("cx"),
        ((F.col("ymin") + F.col("ymax")) / 2.0 - y0).__truediv__(h).alias("cy"),
        ((F.col("xmax") - F.col("xmin")) / w).alias("bw"),
        ((F.col("ymax") - F.col("ymin")) / h).alias("bh"),
    )


def rescaled(df: DataFrame, width: Column, height: Column, target: int = 1024) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(target)) / (width if c[0] == "x" else height) for c in SIDES})


def flipped(df: DataFrame, width: Column, height: Column, across: Column, down: Column) -> DataFrame:
    """Boxes mirrored left to right where ``across`` holds, and upside down where ``down`` holds."""
    out = {}
    for lo, hi, size, flip in (("xmin", "xmax", width, across), ("ymin", "ymax", height, down)):
        out |= {lo: F.when(flip, size - F.col(hi)).otherwise(F.col(lo)), hi: F.when(flip, size - F.col(lo)).otherwise(F.col(hi))}
    return df.withColumns(out)


def coin(seed: int, *ids: str) -> Column:
    """An even chance, the same for the same ids in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(2)) == 0


def quarter_turns(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Four copies of each box: turned by k * 90 degrees counter-clockwise, k from 0. Boxes of zeros stay."""
    x0, y0, x1, y1 = (F.col(c) for c in SIDES)
    zero = (x0 == 0) & (y0 == 0) & (x1 == 0) & (y1 == 0)
    turns = [(x0, y0, x1, y1), (y0, width - x1, y1, width - x0), (width - x1, height - y1, width - x0, height - y0), (height - y1, x0, height - y0, x1)]
    copies = F.array(*[F.struct(F.lit(k).alias("k"), *[F.when(zero, F.lit(0)).otherwise(c).cast("bigint").alias(s) for c, s in zip(t, SIDES)]) for k, t in enumerate(turns)])
    keep = [c for c in df.columns if c not in SIDES]
    return df.select(*keep, F.explode(copies).alias("turned")).select(*keep, "turned.*")


def rotated(df: DataFrame, degrees: Column, width: Column, height: Column) -> DataFrame:
    """The box around each box turned counter-clockwise about the image's centre, within the image; empty ones go."""
    cos, sin, cx, cy = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), width / 2.0, height / 2.0
    xs, ys = [], []
    for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax")):
        dx, dy = F.col(x) - cx, F.col(y) - cy
        xs.append(cos * dx + sin * dy + cx)
        ys.append(cos * dy - sin * dx + cy)
    inside = lambda c, top: F.greatest(F.least(c, top.cast("double")), F.lit(0.0))
    out = df.withColumns({"xmin": inside(F.least(*xs), width), "ymin": inside(F.least(*ys), height), "xmax": inside(F.greatest(*xs), width), "ymax": inside(F.greatest(*ys), height)})
    return out.where("xmax > xmin and ymax > ymin")


def to_world(x: Column, y: Column, bounds: tuple[Column, Column, Column, Column], width: Column, height: Column) -> tuple[Column, Column]:
    """World coordinates of a pixel place; bounds: west, south, east, north."""
    west, south, east, north = bounds
    return west + x * (east - west) / width, north - y * (north - south) / height


def ring_to_world(ring: Column, bounds: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """A ring of points (x, y) in pixels in world coordinates."""

    def moved(p):
        x, y = to_world(p["x"], p["y"], bounds, width, height)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


def georeferenced(meta: DataFrame) -> DataFrame:
    """Rows of meta(crs, west, south, east, north, width, height) that name a reference system and whose pixels aren't
    the world's units from the origin."""
    identity = (F.col("west") == 0) & (F.col("north") == 0) & (F.col("east") == F.col("width")) & (F.col("south") == -F.col("height"))
    return meta.where(F.col("crs").isNotNull() & (F.trim("crs") != "") & ~F.coalesce(identity, F.lit(True)))


def azimuth_vector(df: DataFrame, azimuth: str) -> DataFrame:
    return df.select("*", F.sin(F.radians(azimuth)).alias("shadow_x"), F.cos(F.radians(azimuth)).alias("shadow_y"))


def vector_azimuth(x: Column, y: Column) -> Column:
    return (F.degrees(F.atan2(x, y)) + 360) % 360


def turned_azimuth(azimuth: Column, degrees: Column) -> Column:
    """The azimuth after the image is turned counter-clockwise."""
    return F.pmod(azimuth - degrees, F.lit(360))


def clear_enough(boxes: DataFrame, px: DataFrame, least_side: int = 10, least_share: float = 0.4) -> DataFrame:
    """Boxes with sides of least_side at least, of whose pixels (image_id, y, x, luma) least_share aren't black. Boxes at the
    same place are looked at once."""
    wide = boxes.where((F.col("xmax") - F.col("xmin") >= least_side) & (F.col("ymax") - F.col("ymin") >= least_side))
    place = ["image_id", *SIDES]
    rows = wide.select(*place).distinct().select(*place, F.explode(F.sequence(F.col("ymin").cast("bigint"), F.col("ymax").cast("bigint") - 1)).alias("y"))
    seen = rows.join(px.select("image_id", "y", "x", "luma"), ["image_id", "y"]).where("x >= xmin and x < xmax")
    share = seen.groupBy(*place).agg(F.avg((F.col("luma") > 0).cast("double")).alias("_s")).where(F.col("_s") >= least_share)
    return wide.join(share.select(*place), place, "left_semi").select(*boxes.columns)


def rotation_copies(boxes: DataFrame, images: DataFrame, copies: int = 1, seed: int = 1, px: DataFrame | None = None, least_side: int = 10) -> DataFrame:
    """``copies`` turned copies of each image's boxes: an angle for each image by a hash of (seed, image, copy), boxes and
    azimuth turned alike, and a new image name with the angle. images: image_id, width, height, azimuth, domain. px: where
    given, boxes go that are narrower than ``least_side`` or, before they were turned, not ``clear_enough``."""
    angles = images.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    angles = angles.withColumn("angle", ((F.col("image_id") * 7919 + F.col("copy") * 104729 + seed) % 360).cast("double"))
    both = (boxes if px is None else clear_enough(boxes, px, least_side=0)).join(angles, "image_id")
    turned = rotated(both, F.col("angle"), F.col("width"), F.col("height"))
    if px is not None:
        turned = turned.where((F.col("xmax") - F.col("xmin") >= least_side) & (F.col("ymax") - F.col("ymin") >= least_side))
    return turned.withColumns({"azimuth": turned_azimuth(F.col("azimuth"), F.col("angle")), "image_name": F.concat_ws("_rot", "image_id", F.col("angle").cast("int"))})


def as_pixels(df: DataFrame, width: str, height: str, by: str, order: str) -> DataFrame:
    """Adds pixel_space: whether the first shape of each file has its centre (mx, my) within the image, so that its
    coordinates are pixels whatever reference system it names."""
    first = df.groupBy(by).agg(F.min_by(F.struct("mx", "my", width, height), order).alias("_f"))
    f = F.col("_f")
    inside = f["mx"].between(0, f[width]) & f["my"].between(0, f[height])
    return df.join(first.select(by, inside.alias("pixel_space")), by)
