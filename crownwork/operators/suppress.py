"""Non-maximum suppression: the same answer as a scan by score, by prefixes of that order and by groups that share no box."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import area
from ..functions.storage import discard, stored
from .grouped import MOST, by_groups
from .masks import nms_by_image, packed
from .metrics import running_sums
from .overlap import celled_spans, mask_measures, overlap_join, with_cells


def _dropped(t: pa.Table) -> pa.Table:
    """Nodes that a kept node suppresses: each is looked at once all that may suppress it are settled."""
    g, high, low = (t.column(c).to_numpy() for c in ("_g", "high", "low"))
    codes = np.unique(np.concatenate([high, low]), return_inverse=True)[1]
    code = np.unique(np.concatenate([g, g]), return_inverse=True)[1] * (codes.max(initial=0) + 1) + codes
    nodes, code = np.unique(code, return_inverse=True)
    h, l = code[: len(high)], code[len(high) :]
    order = np.argsort(h, kind="stable")
    h, l, ids = h[order], l[order], np.empty(len(nodes), np.int64)
    ids[code] = np.concatenate([high, low])
    waits, first = np.bincount(l, minlength=len(nodes)), np.searchsorted(h, np.arange(len(nodes) + 1)).tolist()
    gone, ready, targets = np.zeros(len(nodes), bool), np.flatnonzero(waits == 0).tolist(), l.tolist()
    while ready:
        k = ready.pop()
        for j in targets[first[k] : first[k + 1]]:
            gone[j] |= not gone[k]
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    if waits.any():
        raise ValueError("edges of suppression have a cycle")
    return pa.table({"id": ids[gone]})


def survivors(nodes: DataFrame, edges: DataFrame, by: tuple[str, ...] = (), most: int = MOST) -> DataFrame:
    """The nodes(id) that no kept node suppresses. edges(high, low): high suppresses low if high is kept; no cycles.

    by: columns of the edges whose groups share no node, such as the image; then they are finished by group."""
    own = edges.select(*by, F.col("high").cast("bigint").alias("high"), F.col("low").cast("bigint").alias("low"))
    dropped = by_groups(own, list(by), (F.xxhash64("high"), F.xxhash64("low")), _dropped, "id bigint", _dropped_in_rounds, most)
    return nodes.join(dropped, "id", "left_anti")


def _dropped_in_rounds(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Each round keeps what nothing left suppresses, and drops its targets; edges of dropped nodes go. A round's ids are
    written once."""
    left, dropped = stored(edges.select("high", "low")), []
    for _ in range(rounds):
        if left.isEmpty():
            out = left.select(F.col("low").alias("id"))
            for d in dropped:
                out = out.unionByName(d)
            return out
        lows = left.select(F.col("low").alias("high")).distinct()
        now = stored(left.join(lows, "high", "left_anti").select(F.col("low").alias("id")).distinct())
        dropped.append(now)
        rest = left.join(now.withColumnRenamed("id", "low"), "low", "left_anti").join(now.withColumnRenamed("id", "high"), "high", "left_anti")
        before, left = left, stored(rest.select("high", "low"))
        discard(before)
    raise RuntimeError("suppression didn't end")


def _before(a: Column, b: Column, one: Column, two: Column) -> Column:
    """Whether the row of score a and id one comes before that of b and two: greater score, of equal ones the smaller id."""
    return (a > b) | ((a == b) & (one < two))


def _cuts(n: int, meetings: float, pairs: int = 256) -> list[int]:
    """Ranks at which the prefixes end, each four times as long as that before it. meetings: how many pairs of rows have
    a cell in common; of the first prefix there are about ``pairs`` for each row of the table at most."""
    steps = 0
    while meetings > pairs * max(n, 1) * 16**steps:
        steps += 1
    return [n // 4**k for k in range(steps, -1, -1)]


def _meetings(cells: DataFrame, *by: str) -> float:
    return cells.groupBy(*by).count().agg(F.coalesce(F.sum(F.col("count").cast("double") ** 2), F.lit(0.0))).first()[0]


def kept_by_prefixes(rows: DataFrame, order: DataFrame, cuts: list[int], edges: Callable[[DataFrame, DataFrame], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The ids of rows(id, ...) that a scan in order(id, score) keeps: greatest score first, of equal ones the smaller id.
    edges(a, b): (by, high, low) of the pairs where a row of a suppresses a later one of b, if it is kept itself. Several
    rows may have one id, such as a mask's spans. cuts: where the prefixes of that order end, the last one with the last id.

    What the prefixes before have kept clears the next one first, so only pairs of rows that are still open are written: not
    all pairs, whose number grows with the square of the rows at a place."""
    if len(cuts) == 1:
        return survivors(order.select("id"), edges(rows, rows), by)
    ranked = running_sums(order.select("id", "score").withColumn("_one", F.lit(1)), [], [F.desc("score"), F.asc("id")], {"_one": "_r"})
    own = rows.join(ranked.select("id", "_r"), "id")
    level = F.lit(0)
    for c in cuts[:-1]:
        level = level + (F.col("_r") > c).cast("int")
    dealt = stored(own.withColumn("_level", level).drop("_r"))
    done = None
    for k in range(len(cuts)):
        now = dealt.where(F.col("_level") == k)
        if done is not None:
            now = stored(now.join(edges(done, now).select(F.col("low").alias("id")).distinct(), "id", "left_anti"))
        kept = stored(now.join(survivors(now.select("id").distinct(), edges(now, now), by), "id", "left_semi"))
        if done is not None:
            discard(now)
        done = kept if done is None else done.unionByName(kept)
    discard(dealt)
    return done.select("id").distinct()


def box_nms(boxes: DataFrame, iou: float = 0.5, coverage: float | None = 0.5, by: tuple[str, ...] = ("image_id",), key: str = "det_id", score: str = "score", strict: bool = False) -> DataFrame:
    """The boxes that are left. A kept box suppresses a later one if their IoU is at least ``iou`` (strict: above it)
    or at least ``coverage`` of the later one is common. Boxes without a score stay and suppress none."""
    inter, union = F.col("inter"), area("l_") + area("r_") - F.col("inter")
    hit = (inter > union * iou) if strict else (inter >= union * iou)
    if coverage is not None:
        hit = hit | (inter >= area("r_") * coverage)
    first = _before(F.col("l_score"), F.col("r_score"), F.col("l_id"), F.col("r_id"))

    def edges(a, b):
        return overlap_join(a, b, by).where(first & hit).select(*[F.col(f"l_{c}").alias(c) for c in by], F.col("l_id").alias("high"), F.col("r_id").alias("low"))

    slim = stored(boxes.where(F.col(score).isNotNull()).select(*by, F.col(key).alias("id"), F.col(score).alias("score"), "xmin", "ymin", "xmax", "ymax"))
    cuts = _cuts(slim.count(), _meetings(with_cells(slim, 256), *by, "cx", "cy"))
    kept = kept_by_prefixes(slim, slim, cuts, edges, by).select(F.col("id").alias(key))
    return boxes.where(F.col(score).isNull()).unionByName(boxes.join(kept, key, "left_semi"))


def mask_nms(objects: DataFrame, spans: DataFrame, iou: float = 0.3, key: str = "obj_id", score: str = "score", by: str = "image_id", loose: DataFrame | None = None) -> DataFrame:
    """The objects(obj_id, score) left of masks given as spans; an IoU above ``iou`` suppresses. Those without a span or a
    score stay.

    Objects that have an image (``by``), where their mask is, are finished by image; see ``operators.masks``. loose: the
    masks packed, of spans that may overlap, for which an image's task needs no table of united ones."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    if by in objects.columns and all(df.schema[c].dataType.simpleString() in numbers[: 4 + 2 * (c == score)] for df, c in ((objects, key), (objects, score), (spans, "y"), (spans, "x0"), (spans, "x1"))):
        found, big = nms_by_image(objects, packed(spans.where("x1 > x0"), by) if loose is None else loose, iou, key, score, by, loose is not None)
        if big is None:
            return found
        rest = [df.join(big, by, "left_semi") for df in (objects, spans)]
        left = mask_nms(rest[0].drop(by), rest[1], iou, key, score)
        return found.unionByName(rest[0].join(left.select(key), key, "left_semi").select(*objects.columns))
    scored = objects.where(F.col(score).isNotNull()).select(F.col(key).alias("id"), F.col(score).alias("score"))
    rows = stored(spans.where("x1 > x0").withColumnRenamed("obj_id", "id").join(scored, "id"))
    first = _before(F.col("l_id.score"), F.col("r_id.score"), F.col("l_id.id"), F.col("r_id.id"))

    def edges(a, b):
        own = [df.select(F.struct("id", "score").alias("obj_id"), "image_id", "y", "x0", "x1") for df in (a, b)]
        pairs = mask_measures(*own).where(first & (F.col("iou") > iou))
        return pairs.select(F.col("l_id.id").alias("high"), F.col("r_id.id").alias("low"))

    order = stored(rows.select("id", "score").distinct())
    cuts = _cuts(order.count(), _meetings(celled_spans(rows, 64), "image_id", "y", "c"))
    kept = kept_by_prefixes(rows, order, cuts, edges).select(F.col("id").alias(key))
    return objects.join(order.select(F.col("id").alias(key)), key, "left_anti").unionByName(objects.join(kept, key, "left_semi"))
