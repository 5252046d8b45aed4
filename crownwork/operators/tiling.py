"""Tile grids, assignment of boxes to tiles, and mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts(size: Column, tile: int, stride: int, mode: str) -> Column:
    """First pixels of the tiles along one side of an image.

    always: every ``stride`` pixels, and the last whole tile's start; gap: that one only if the others leave a gap;
    plain: every ``stride`` pixels; set: the last whole tile's start, and every ``stride`` pixels before it. Images no
    larger than a tile have one, at 0."""
    last = F.greatest(size - tile, F.lit(0))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)).cast("long"), F.lit(stride).cast("long"))
    end = F.array(last.cast("long"))
    if mode == "plain":
        out = steps
    elif mode == "always":
        out = F.concat(steps, end)
    elif mode == "gap":
        out = F.when(F.element_at(steps, -1) + tile < size, F.concat(steps, end)).otherwise(steps)
    elif mode == "set":
        out = F.concat(F.filter(steps, lambda s: s < F.greatest(size - tile, F.lit(1))), end)
    else:
        raise ValueError(mode)
    return F.when(size <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.array_sort(F.array_distinct(out)))


def tile_grid(images: DataFrame, tile: int = 400, overlap: float = 0.05, mode: str = "always", least: int = 0) -> DataFrame:
    """Tiles x0, y0, w, h of images(image_id, width, height); those with a side under ``least`` go."""
    stride = int(tile * (1 - overlap))
    grid = images.select("image_id", "width", "height", F.explode(starts(F.col("height"), tile, stride, mode)).alias("y0"))
    grid = grid.select("*", F.explode(starts(F.col("width"), tile, stride, mode)).alias("x0"))
    side = lambda size, at: F.least(F.lit(tile), F.col(size) - F.col(at))
    return grid.select("image_id", "x0", "y0", side("width", "x0").alias("w"), side("height", "y0").alias("h")).where((F.col("w") >= least) & (F.col("h") >= least))


def tile_estimate(images: DataFrame, tile: int = 400, overlap: float = 0.05) -> DataFrame:
    stride = int(tile * (1 - overlap))
    n = lambda c: F.greatest(F.ceil((F.col(c) - tile) / stride) + 1, F.lit(1))
    return images.select("image_id", (n("width") * n("height")).alias("n_tiles"))


def world_grid(areas: DataFrame, core: float = 40.0, buffer: float = 30.0) -> DataFrame:
    """Square cells over world bounds(west, south, east, north), each with a buffer around it."""
    at = lambda lo, hi: F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / core).cast("int") - 1, F.lit(0))))
    grid = areas.select("*", at("west", "east").alias("i")).select("*", at("south", "north").alias("j"))
    x, y = F.col("west") + F.col("i") * core, F.col("south") + F.col("j") * core
    return grid.select("image_id", "i", "j", (x - buffer).alias("x0"), (y - buffer).alias("y0"), (x + core + buffer).alias("x1"), (y + core + buffer).alias("y1"))


def safe_crops(images: DataFrame, n: int = 5, size: int = 400, margin: float = 0.2, seed: int = 1) -> DataFrame:
    """n windows of each image inside a margin, at places that a hash of (seed, image, number) gives. Where the margin
    leaves no room they lie anywhere in the image; images smaller than the window have none."""
    out = images.where((F.col("width") >= size) & (F.col("height") >= size)).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("crop"))
    cols = {}
    for name, side, salt in (("x0", "width", 1), ("y0", "height", 2)):
        edge = F.floor(F.col(side) * margin)
        room = F.col(side) - 2 * edge - size
        lo, span = F.when(room >= 0, edge).otherwise(0), F.when(room >= 0, room).otherwise(F.col(side) - size)
        cols[name] = lo + (F.col("image_id") * 7919 + F.col("crop") * 104729 + seed * 31 + salt * 15485863) % (span + 1)
    return out.withColumns(cols).select("image_id", "crop", "x0", "y0", F.lit(size).alias("w"), F.lit(size).alias("h"))


def first_tiles(boxes: DataFrame, tiles: DataFrame, stride: int, tile: int, key: str = "det_id") -> DataFrame:
    """Each box with the first tile, in row order, that holds its centre (half open); null if none does.

    Boxes and tiles meet by the cells of a grid of ``stride``."""
    reach = F.sequence(F.floor(F.col("x0") / stride), F.floor((F.col("x0") + F.col("w") - 1) / stride))
    down = F.sequence(F.floor(F.col("y0") / stride), F.floor((F.col("y0") + F.col("h") - 1) / stride))
    cells = tiles.select("*", F.explode(reach).alias("cx")).select("*", F.explode(down).alias("cy"))
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    at = boxes.select("image_id", key, x.alias("mx"), y.alias("my"), F.floor(x / stride).alias("cx"), F.floor(y / stride).alias("cy"))
    inside = (F.col("mx") >= F.col("x0")) & (F.col("mx") < F.col("x0") + F.col("w")) & (F.col("my") >= F.col("y0")) & (F.col("my") < F.col("y0") + F.col("h"))
    found = at.join(cells, ["image_id", "cx", "cy"]).where(inside).groupBy(key).agg(F.min(F.struct("y0", "x0")).alias("t"))
    return boxes.join(found, key, "left").select(*boxes.columns, F.col("t.x0").alias("tile_x"), F.col("t.y0").alias("tile_y"))


def to_tile(df: DataFrame, x0: Column, y0: Column, w: Column, h: Column) -> DataFrame:
    """Boxes in tile coordinates, clipped to the tile."""
    cut = lambda c, at, size: F.greatest(F.least(F.col(c) - at, size), F.lit(0))
    return df.withColumns({"xmin": cut("xmin", x0, w), "ymin": cut("ymin", y0, h), "xmax": cut("xmax", x0, w), "ymax": cut("ymax", y0, h)})


def to_image(df: DataFrame, x0: Column, y0: Column) -> DataFrame:
    return df.withColumns({"xmin": F.col("xmin") + x0, "ymin": F.col("ymin") + y0, "xmax": F.col("xmax") + x0, "ymax": F.col("ymax") + y0})


def mosaic(px: DataFrame, value: str = "p") -> DataFrame:
    """The mean of overlapping tiles' pixels(image_id, y, x, value)."""
    return px.groupBy("image_id", "y", "x").agg(F.avg(value).alias(value))
