"""The best overlaps of boxes without a table of pairs, whose number grows with the square of the boxes at a place.

Boxes meet by grid cell. In a cell one side stands in a tree whose nodes know the ranges of their boxes' sides, and a node
isn't looked into if no box in those ranges could beat what was found. Values are those of all pairs, exact for sides of
whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import SIDES
from ..functions.storage import stored
from .overlap import with_cells

#: Boxes of a leaf; pairs of a box and a node, or of boxes, that are looked at together; boxes of a side that a task holds.
LEAF, AT_ONCE, MOST = 16, 100_000, 1_000_000

_MEASURES = {"iou": lambda i, a, b: i / (a + b - i), "l_share": lambda i, a, b: i / a, "r_share": lambda i, a, b: i / b}


def _inter(p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Common area of boxes (4 sides by row) with those from lo's least to hi's greatest corners; 0 where apart."""
    dx = np.minimum(p[2], hi[2]) - np.maximum(p[0], lo[0])
    dy = np.minimum(p[3], hi[3]) - np.maximum(p[1], lo[1])
    return np.maximum(dx, 0) * np.maximum(dy, 0)


def _area(b: np.ndarray) -> np.ndarray:
    return np.maximum(b[2] - b[0], 0) * np.maximum(b[3] - b[1], 0)


def best_values(boxes: np.ndarray, others: np.ndarray, measure: str, of: np.ndarray, n: int) -> np.ndarray:
    """The greatest measure (iou, or the share of either side) of the boxes of each of n groups with any of the others, 0
    where they meet none. Both are arrays of 4 sides by box, of some area; of: each box's group."""
    best = np.zeros(n)
    if not boxes.shape[1] or not others.shape[1]:
        return best
    value = _MEASURES[measure]
    depth = max(0, int(np.ceil(np.log2(others.shape[1] / LEAF))))
    own = np.resize(np.arange(others.shape[1]), (1, LEAF << depth))  # some twice, which does no harm
    for k in range(depth):
        own = np.take_along_axis(own, np.argsort(others[k % 4][own], axis=1, kind="stable"), 1).reshape(2 << k, -1)
    leaves = others[:, own]
    levels = [(leaves.min(2), leaves.max(2))]
    for _ in range(depth):
        lo, hi = levels[0]
        levels.insert(0, (lo.reshape(4, -1, 2).min(2), hi.reshape(4, -1, 2).max(2)))
    areas, leaf_areas = _area(boxes), _area(leaves)

    def bound(level, i, node):
        """What no box of the node is above."""
        lo, hi = (c[:, node] for c in levels[level])
        inter, a = _inter(boxes[:, i], lo, hi), areas[i]
        if measure == "l_share":
            return inter / a
        least = _area(np.stack([hi[0], hi[1], lo[2], lo[3]]))  # of its boxes' areas
        return np.minimum(inter / np.maximum(a + least - inter, a), 1) if measure == "iou" else np.where(inter < least, inter / np.maximum(least, 1e-300), inter > 0)

    def look(i, node):
        for at in range(0, len(i), AT_ONCE // LEAF):
            k, m = i[at : at + AT_ONCE // LEAF], node[at : at + AT_ONCE // LEAF]
            those = leaves[:, m]
            inter = _inter(boxes[:, k, None], those, those)
            np.maximum.at(best, of[k], value(inter, areas[k, None], leaf_areas[m]).max(1))

    every = np.arange(boxes.shape[1])
    for at in range(0, len(every), AT_ONCE):  # down to one leaf each, for a first value
        i = every[at : at + AT_ONCE]
        node = np.zeros(len(i), np.int64)
        for level in range(1, depth + 1):
            node = 2 * node + (bound(level, i, 2 * node + 1) > bound(level, i, 2 * node))
        look(i, node)
    if not depth:
        return best
    todo = [(0, i, np.zeros(len(i), np.int64), np.full(len(i), np.inf)) for i in np.array_split(every, -(-len(every) // AT_ONCE))]
    while todo:
        level, i, node, top = todo.pop()
        on = top > best[of[i]]
        i, node = i[on], node[on]
        if not len(i):
            continue
        if level == depth:
            look(i, node)
            continue
        one, two = bound(level + 1, i, 2 * node), bound(level + 1, i, 2 * node + 1)
        second = two > one
        for child, top in ((2 * node + ~second, np.minimum(one, two)), (2 * node + second, np.maximum(one, two))):  # the better one is looked at first
            on = top > best[of[i]]
            todo.append((level + 1, i[on], child[on], top[on]))
    return best


def _summed(b: np.ndarray, x: int, y: int, cell: int, dx: int, dy: int) -> np.ndarray:
    """How many boxes hold each place of a cell; a box begins dx and dy later than its corner."""
    x0, y0, x1, y1 = (np.clip(c, 0, cell).astype(np.int64) for c in (b[0] + dx - x, b[1] + dy - y, b[2] - x, b[3] - y))
    x1, y1 = np.maximum(x0, x1), np.maximum(y0, y1)
    at = lambda u, v: np.bincount(u * (cell + 1) + v, minlength=(cell + 1) ** 2)
    return (at(x0, y0) - at(x1, y0) - at(x0, y1) + at(x1, y1)).reshape(cell + 1, -1).cumsum(0).cumsum(1)


def count_pairs(one: np.ndarray, two: np.ndarray, x: int, y: int, cell: int, whole: bool) -> int:
    """Pairs of boxes whose intersection begins in the cell from (x, y) on. Many of sides of ``whole`` numbers are counted by
    places: a rectangle's pixels less the sides between two of them, plus the corners between four, are 1 in the cell
    where it begins and 0 in others, so sums over a cell's places do it. Others are looked at pair by pair, some at once."""
    if whole and one.shape[1] * two.shape[1] > 4 * cell * cell:
        return sum((1 - 2 * dx) * (1 - 2 * dy) * int((_summed(one, x, y, cell, dx, dy) * _summed(two, x, y, cell, dx, dy)).sum()) for dx in (0, 1) for dy in (0, 1))
    n, step = 0, max(1, AT_ONCE // max(two.shape[1], 1))
    for at in range(0, one.shape[1], step):
        p = one[:, at : at + step, None]
        x0, y0 = np.maximum(p[0], two[0]), np.maximum(p[1], two[1])
        meets = (np.minimum(p[2], two[2]) > x0) & (np.minimum(p[3], two[3]) > y0)
        n += int((meets & (x0 >= x) & (x0 < x + cell) & (y0 >= y) & (y0 < y + cell)).sum())
    return n


def _met(left: DataFrame, right: DataFrame, by: tuple[str, ...], cell: int, solve, schema: str, most: int) -> DataFrame:
    """What solve(left, right, x, y) makes of the boxes that touch a cell, as tables. Of a side of more than ``most`` boxes in a
    cell each part meets each part of the other side in a task of its own."""
    keys = [*by, "cx", "cy"]
    a, b = (stored(with_cells(df.where("xmax > xmin and ymax > ymin"), cell)) for df in (left, right))
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((a, "_a"), (b, "_b"))]
    sizes = counts[0].join(counts[1], keys)  # a row a cell
    if not sizes.where(F.greatest("_a", "_b") > most).isEmpty():
        sizes = sizes.select(*keys, *[F.ceil(F.col(n) / most).cast("int").alias(n) for n in ("_a", "_b")])
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
        a, b = (df.join(sizes, keys) for df in (a, b))
        a = a.withColumns({"_i": dealt(left, "_a"), "_j": every("_b")}).drop("_a", "_b")
        b = b.withColumns({"_i": every("_a"), "_j": dealt(right, "_b")}).drop("_a", "_b")
        keys += ["_i", "_j"]

    def run(p: pa.Table, q: pa.Table) -> pa.Table:
        some = p if p.num_rows else q
        return solve(p, q, *(int(some.column(c)[0].as_py()) * cell for c in ("cx", "cy")))

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def _sides(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in SIDES])


def best_of_boxes(predictions: DataFrame, truths: DataFrame, by: tuple[str, ...] = ("image_id",), cell: int = 512, most: int = MOST) -> DataFrame:
    """``match.best_overlaps`` of boxes: predictions(pred_id, by, sides), truths(by, category, sides). Gives pred_id, by,
    best_tree and best_canopy."""

    def solve(p, q, x, y):
        boxes, others, tree = _sides(p), _sides(q), q.column("category").to_numpy(zero_copy_only=False)
        every = np.arange(p.num_rows)
        best = lambda m, on: best_values(boxes, others[:, on], m, every, len(every))
        return pa.table({"pred_id": p.column("pred_id"), "t": best("iou", tree == 2), "c": best("l_share", (tree != 2) & (tree == tree))})

    own, kind = predictions.select("pred_id", *by, *SIDES), predictions.schema["pred_id"].dataType.simpleString()
    found = _met(own, truths.where("category is not null").select(*by, "category", *SIDES), by, cell, solve, f"pred_id {kind}, t double, c double", most)
    best = found.groupBy("pred_id").agg(F.max("t").alias("t"), F.max("c").alias("c"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return predictions.select("pred_id", *by).join(best, "pred_id", "left").select("pred_id", *by, zero("t", "best_tree"), zero("c", "best_canopy"))


def measures_by_group(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("image_id",), cell: int = 512, most: int = MOST) -> DataFrame:
    """by, n, iou, l_share, r_share: how many pairs of boxes of a group share some area, and the greatest of each of
    ``overlap.pair_measures``. Groups without a pair have no row."""

    whole = all(df.schema[c].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for df in (left, right) for c in SIDES)

    def solve(p, q, x, y):
        boxes, others, one = _sides(p), _sides(q), np.zeros(p.num_rows, np.int64)
        found = {"n": [count_pairs(boxes, others, x, y, cell, whole)], **{m: best_values(boxes, others, m, one, 1) for m in _MEASURES}}
        return pa.table({**{c: (p if p.num_rows else q).column(c).slice(0, 1) for c in by}, **found})

    schema = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in by)
    found = _met(left.select(*by, *SIDES), right.select(*by, *SIDES), by, cell, solve, f"{schema}, n bigint, iou double, l_share double, r_share double", most)
    return found.groupBy(*by).agg(F.sum("n").alias("n"), *[F.max(m).alias(m) for m in _MEASURES]).where("n > 0")
