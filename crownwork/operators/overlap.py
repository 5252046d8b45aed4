"""Overlap joins: boxes by grid cells, masks by row spans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import SIDES, area, intersection, ratio


def with_cells(df: DataFrame, cell: int) -> DataFrame:
    """A row for each grid cell (cx, cy) that a box touches."""
    at = lambda c: F.floor(F.col(c) / cell)
    return df.withColumn("cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("cy", F.explode(F.sequence(at("ymin"), at("ymax"))))


def overlap_join(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("image_id",), cell: int | None = 256) -> DataFrame:
    """Pairs of boxes that share some area, columns prefixed l_ and r_, with ``inter``.

    Both sides go to the grid cells that they touch and meet by equality of cell. A pair is kept only in the cell of its
    intersection's least corner, so no pair comes twice. cell: about the 90th percentile of the boxes' sides. None: for
    boxes of any sizes, a grid for each size; see ``_join_by_levels``."""
    a, b = (df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns]) for df, p in ((left, "l_"), (right, "r_")))
    if cell is None:
        return _join_by_levels(a, b, by)
    one = with_cells(a.withColumnsRenamed({f"l_{c}": c for c in SIDES}), cell).withColumnsRenamed({c: f"l_{c}" for c in SIDES})
    two = with_cells(b.withColumnsRenamed({f"r_{c}": c for c in SIDES}), cell).withColumnsRenamed({c: f"r_{c}" for c in SIDES})
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by] + [one["cx"] == two["cx"], one["cy"] == two["cy"]]
    x, y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
    meets = (x < F.least("l_xmax", "r_xmax")) & (y < F.least("l_ymax", "r_ymax"))
    here = (F.floor(x / cell) == one["cx"]) & (F.floor(y / cell) == one["cy"])
    found = one.join(two, on).where(meets & here).drop("cx", "cy")
    return found.withColumn("inter", intersection("l_", "r_"))


def alike_join(left: DataFrame, right: DataFrame, iou: float, by: tuple[str, ...] = ("image_id",), cell: int = 256) -> DataFrame:
    """The pairs of overlap_join whose IoU is at least ``iou``. From 0.5 on boxes meet by their least corners, which are as
    near each other as the IoU demands, so far fewer pairs are looked at: along each axis the common part is at least
    ``iou`` of what both cover, so corners differ by (1 - iou) / iou of a side at most."""
    share = (1 - iou) / iou if iou > 0 else 2.0
    if share > 1:
        found = overlap_join(left, right, by, cell)
    else:
        size = max(1, math.ceil(cell * share))
        a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns], F.floor(F.col("xmin") / size).alias("cx"), F.floor(F.col("ymin") / size).alias("cy"))

        def near(lo, hi):
            reach = (F.col(hi) - F.col(lo)) * (share + 1e-9)
            return F.sequence(F.floor((F.col(lo) - reach) / size), F.floor((F.col(lo) + reach) / size))

        sound = right.where((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))
        b = sound.withColumn("cx", F.explode(near("xmin", "xmax"))).withColumn("cy", F.explode(near("ymin", "ymax")))
        b = b.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], "cx", "cy")
        on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by] + [a["cx"] == b["cx"], a["cy"] == b["cy"]]
        found = a.join(b, on).drop("cx", "cy").withColumn("inter", intersection("l_", "r_"))
    return found.where((F.col("inter") > 0) & (ratio(F.col("inter"), area("l_") + area("r_") - F.col("inter")) >= iou))


#: The side of a cell of level 0; each level's is four times that of the one before.
FINEST = 16


def _join_by_levels(a: DataFrame, b: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A box's own level is the first whose cells are as wide as its longer side, so it touches four of them at most, and
    no more of those of coarser levels; a level that few boxes of a table have is left for the next (see ``_raised``). A pair
    meets at the own level of its larger box: the other one goes there too, to each such level that the other table has.
    Boxes that are small for their level are few, so small ones hardly meet in a large cell.

    A box has at most 4 rows for each of those levels (13 levels reach from sides of 1 to 100 million), and none for a
    level where the other table has nothing to meet."""

    def levelled(df, p):
        side = F.greatest(F.col(f"{p}xmax") - F.col(f"{p}xmin"), F.col(f"{p}ymax") - F.col(f"{p}ymin"))
        sound = df.where((F.col(f"{p}xmax") > F.col(f"{p}xmin")) & (F.col(f"{p}ymax") > F.col(f"{p}ymin")))
        out = sound.withColumn(f"{p}level", F.greatest(F.ceil(F.log2(side / FINEST) / 2), F.lit(0)).cast("int"))
        held = dict(out.groupBy(f"{p}level").count().where(F.col(f"{p}level").isNotNull()).collect())  # a row a level
        up = _raised(held)
        level = F.col(f"{p}level")
        for k, to in up.items():
            level = F.when(F.col(f"{p}level") == k, F.lit(to)).otherwise(level)
        return out.withColumn(f"{p}level", level), sorted(held.keys() - up.keys())

    def celled(df, p, levels):
        size = F.pow(F.lit(4.0), F.col("level")) * FINEST
        at = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{p}{lo}") / size), F.floor(F.col(f"{p}{hi}") / size)))
        return df.withColumn("level", F.explode(levels)).withColumn("cx", at("xmin", "xmax")).withColumn("cy", at("ymin", "ymax"))

    def met(one, two):
        x, y = F.greatest("l_xmin", "r_xmin"), F.greatest("l_ymin", "r_ymin")
        meets = (x < F.least("l_xmax", "r_xmax")) & (y < F.least("l_ymax", "r_ymax"))
        on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in by] + [one[c] == two[c] for c in ("level", "cx", "cy")]
        size = F.pow(F.lit(4.0), one["level"]) * FINEST
        here = (F.floor(x / size) == one["cx"]) & (F.floor(y / size) == one["cy"])
        return one.join(two, on).where(meets & here).drop("level", "cx", "cy", "l_level", "r_level")

    (a, of_a), (b, of_b) = levelled(a, "l_"), levelled(b, "r_")
    some = lambda levels, test: F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), test)
    # the right box is as large or larger; then the left one is larger
    found = met(celled(a, "l_", some(of_b, lambda k: k >= F.col("l_level"))), celled(b, "r_", F.array("r_level")))
    if of_a and of_b and of_a[-1] > of_b[0]:
        large = celled(a.where(F.col("l_level") > of_b[0]), "l_", F.array("l_level"))
        found = found.unionByName(met(large, celled(b, "r_", some(of_a, lambda k: k > F.col("r_level")))))
    return found.withColumn("inter", intersection("l_", "r_"))


#: A level is left for one whose boxes are at least so many times as many, for each level between them.
FEW = 32


def _raised(held: dict[int, int]) -> dict[int, int]:
    """To which level the boxes of a level go instead, from how many each holds: to the next that is held, if they and those
    that came to them are few beside it, and on from there likewise."""
    levels, up, own = sorted(held), {}, dict(held)
    for k, next_ in zip(levels, levels[1:]):
        if own[k] * FEW ** (next_ - k) <= held[next_]:
            up = {j: next_ if to == k else to for j, to in up.items()} | {k: next_}
            own[next_] += own[k]
    return up


def pair_measures(pairs: DataFrame) -> DataFrame:
    """iou, and what share of each side the intersection is."""
    a, b = area("l_"), area("r_")
    return pairs.select("*", ratio(F.col("inter"), a + b - F.col("inter")).alias("iou"), ratio(F.col("inter"), a).alias("l_share"), ratio(F.col("inter"), b).alias("r_share"))


def celled_spans(df: DataFrame, cell: int) -> DataFrame:
    """A row for each cell ``c`` of a row that a span touches."""
    return df.where("x1 > x0").withColumn("c", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell))))


def span_overlaps(left: DataFrame, right: DataFrame, by: str = "image_id", cell: int = 64) -> DataFrame:
    """l_id, r_id, inter of masks as spans (obj_id, image_id, y, x0, x1; half open): rows meet by image, y and cell of
    ``cell`` pixels; a pair counts in the cell where its common part begins."""
    a = celled_spans(left, cell).select(F.col("obj_id").alias("l_id"), by, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), "c")
    b = celled_spans(right, cell).select(F.col("obj_id").alias("r_id"), by, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), "c")
    first = F.greatest("a0", "b0")
    common = F.least("a1", "b1") - first
    return a.join(b, [by, "y", "c"]).where((common > 0) & (F.floor(first / cell) == F.col("c"))).groupBy("l_id", "r_id").agg(F.sum(common).alias("inter"))


def span_areas(spans: DataFrame) -> DataFrame:
    return spans.groupBy("obj_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("xmin"), F.min("y").alias("ymin"), (F.max("x1") - 1).alias("xmax"), F.max("y").alias("ymax"))


def mask_measures(left: DataFrame, right: DataFrame) -> DataFrame:
    """iou, and iop (share of the left mask), of masks that share a pixel."""
    a = span_areas(left).select(F.col("obj_id").alias("l_id"), F.col("area").alias("l_area"))
    b = span_areas(right).select(F.col("obj_id").alias("r_id"), F.col("area").alias("r_area"))
    pairs = span_overlaps(left, right).join(a, "l_id").join(b, "r_id")
    inter = F.col("inter")
    return pairs.select("l_id", "r_id", "inter", ratio(inter, F.col("l_area") + F.col("r_area") - inter).alias("iou"), ratio(inter, F.col("l_area")).alias("iop"))


def masks_of(spans: DataFrame, by: str = "image_id") -> DataFrame:
    """obj_id, by, area, filled (without spans that end before they begin), spans, even and bounds (half open) of masks given as spans: a row a mask, its spans in order of
    their rows. even: each row from the first to the last has one span. Those without a pixel have no bounds."""
    on = lambda c: F.when(F.col("x1") > F.col("x0"), c)
    own = spans.groupBy("obj_id", by).agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area"), F.sum(on(F.col("x1") - F.col("x0"))).alias("filled"),
        F.sort_array(F.collect_list(on(F.struct("y", "x0", "x1")))).alias("spans"),
        F.min(on(F.col("x0"))).alias("xmin"), F.min(on(F.col("y"))).alias("ymin"), F.max(on(F.col("x1"))).alias("xmax"), (F.max(on(F.col("y"))) + 1).alias("ymax"),
    )
    rows = F.size(F.array_distinct(F.transform("spans", lambda p: p["y"])))
    return own.withColumn("even", (F.size("spans") == rows) & (F.col("ymax") - F.col("ymin") == rows))


def _common(p: Column, q: Column) -> Column:
    return F.greatest(F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"]), F.lit(0)).cast("bigint")


def common_area(l: str = "l_", r: str = "r_") -> Column:
    """The pixels that two masks of ``masks_of`` in a row share: row by row where both are even, else all spans of the one
    with those of the other in their row."""
    a, b, zero = F.col(f"{l}spans"), F.col(f"{r}spans"), F.lit(0).cast("bigint")
    at = lambda p, y: F.get(F.col(f"{p}spans"), (y - F.col(f"{p}ymin")).cast("int"))
    rows = F.sequence(F.greatest(f"{l}ymin", f"{r}ymin"), F.least(f"{l}ymax", f"{r}ymax") - 1)
    even = F.aggregate(rows, zero, lambda s, y: s + _common(at(l, y), at(r, y)))
    beside = lambda p: F.aggregate(b, zero, lambda t, q: t + F.when(p["y"] == q["y"], _common(p, q)).otherwise(zero))
    return F.when(F.col(f"{l}even") & F.col(f"{r}even"), even).otherwise(F.aggregate(a, zero, lambda s, p: s + beside(p)))


def mask_pairs(left: DataFrame, right: DataFrame, by: str = "image_id", cell: int = 64) -> DataFrame:
    """The rows of mask_measures. Masks meet whole, by the cells of their bounds, and a pair is measured where it is found:
    pairs aren't shuffled, so a filter or a sum over them makes no table of all of them. Masks are told apart by id and image."""
    pairs = overlap_join(masks_of(left, by), masks_of(right, by), (by,), cell).drop("inter")
    inter = F.col("inter")
    found = pairs.select(F.col("l_obj_id").alias("l_id"), F.col("r_obj_id").alias("r_id"), "l_area", "r_area", common_area().alias("inter")).where(inter > 0)
    return found.select("l_id", "r_id", "inter", ratio(inter, F.col("l_area") + F.col("r_area") - inter).alias("iou"), ratio(inter, F.col("l_area")).alias("iop"))


def boxes_on_masks(boxes: DataFrame, spans: DataFrame, by: str = "image_id", cell: int = 256) -> DataFrame:
    """box_id, obj_id, inter, area, box: for boxes(box_id, by, sides) and each mask with a pixel in them what is common, and the
    whole areas. Pairs aren't shuffled: a box's are in the few cells that it touches, so its best one is a small sum."""
    own = boxes.select("box_id", by, *SIDES)
    zero = F.lit(0).cast("bigint")
    inside = lambda p: F.when((p["y"] >= F.col("l_ymin")) & (p["y"] < F.col("l_ymax")), F.greatest(F.least(p["x1"], F.col("l_xmax")) - F.greatest(p["x0"], F.col("l_xmin")), F.lit(0)).cast("bigint")).otherwise(zero)
    pairs = overlap_join(own, masks_of(spans, by), (by,), cell).drop("inter")
    within = (F.col("r_xmin") >= F.col("l_xmin")) & (F.col("r_xmax") <= F.col("l_xmax")) & (F.col("r_ymin") >= F.col("l_ymin")) & (F.col("r_ymax") <= F.col("l_ymax"))
    inter = F.when(within, F.col("r_filled")).otherwise(F.aggregate("r_spans", zero, lambda s, p: s + inside(p)))
    return pairs.select(F.col("l_box_id").alias("box_id"), F.col("r_obj_id").alias("obj_id"), inter.alias("inter"), F.col("r_area").alias("area"), area("l_").alias("box")).where("inter > 0")
