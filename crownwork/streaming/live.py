"""Running counts of a one-to-one matching, as predictions and ground truth land in any order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

SIDES = ["xmin", "ymin", "xmax", "ymax"]


def greedy_pairs(pred: np.ndarray, truth: np.ndarray, iou: float) -> list[tuple[int, int]]:
    """Places of pairs taken one to one, the greatest IoU first (of equal ones the first prediction, then the first truth),
    ``iou`` at least. Boxes are rows of xmin, ymin, xmax, ymax in ascending order of their ids."""
    if not len(pred) or not len(truth):
        return []
    order = np.argsort(truth[:, 0], kind="stable")
    # truth whose left side lies within a prediction's reach, by the widest truth
    widest = (truth[:, 2] - truth[:, 0]).max()
    lo = np.searchsorted(truth[order, 0], pred[:, 0] - widest, "left")
    hi = np.searchsorted(truth[order, 0], pred[:, 2], "left")
    n = np.maximum(hi - lo, 0)
    p = np.repeat(np.arange(len(pred)), n)
    g = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    a, b = pred[p], truth[g]
    w, h = (np.minimum(a[:, k + 2], b[:, k + 2]) - np.maximum(a[:, k], b[:, k]) for k in (0, 1))
    meets = (w > 0) & (h > 0)
    p, g, inter = p[meets], g[meets], (w * h)[meets]
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    value = inter / (area(pred)[p] + area(truth)[g] - inter)
    taken, used_p, used_g = [], set(), set()
    for k in np.lexsort((g, p, -value)):
        if value[k] >= iou and p[k] not in used_p and g[k] not in used_g:
            used_p.add(p[k])
            used_g.add(g[k])
            taken.append((int(p[k]), int(g[k])))
    return taken


class _Matching(StatefulProcessor):
    """Holds a tile's boxes by kind and id; when some come, matches all anew. A tile is a bounded piece of an image, and so
    are its boxes."""

    def __init__(self, iou: float, keep_ms: int | None):
        self.iou, self.keep_ms = iou, keep_ms

    def init(self, handle):
        self.handle = handle
        self.boxes = handle.getMapState("boxes", "truth boolean, id bigint", ", ".join(f"{s} double" for s in SIDES))
        self.until = handle.getValueState("until", "ms bigint")

    def _counts(self, key, closed: bool) -> pd.DataFrame:
        sides: dict[bool, list] = {True: [], False: []}
        for (truth, number), box in self.boxes.iterator():
            sides[truth].append((number, *box))
        pred, gt = (np.array(sorted(sides[k]), np.float64).reshape(-1, 5)[:, 1:] for k in (False, True))
        tp = len(greedy_pairs(pred, gt, self.iou))
        return pd.DataFrame({"tile_id": [key[0]], "n_pred": [len(pred)], "n_gt": [len(gt)], "tp": [tp], "fp": [len(pred) - tp], "fn": [len(gt) - tp], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for some in rows:
            for truth, number, *box in some[["truth", "box_id", *SIDES]].itertuples(index=False):
                self.boxes.updateValue((bool(truth), int(number)), tuple(map(float, box)))  # one that comes again takes its own place
            if self.keep_ms is not None and len(some):
                newest = int(some["event_ms"].max())
                last = newest if last is None else max(last, newest)
        if last is not None:
            old = self.until.get()[0] if self.until.exists() else None
            new = max(last + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1)
            if old is None or new > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(new)
                self.until.update((new,))
        yield self._counts(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._counts(key, True)
        self.boxes.clear()
        self.until.clear()

    def close(self):
        pass


def live_matching(stream: DataFrame, iou: float = 0.4, ts: str | None = None, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """tile_id, n_pred, n_gt, tp, fp, fn, closed: the counts of a one-to-one matching of each tile that boxes came for, after
    each batch. Whatever the order and the batches in which boxes come, a tile's last row is that of the matching of all its
    boxes (greatest IoU first, ``iou`` at least), also after a restart from the checkpoint.

    stream: tile_id, truth (true for ground truth), box_id, xmin, ymin, xmax, ymax. A box that comes again takes the place
    of the earlier one of its kind and id. Rows with a null in these columns, or without area, are left out.
    ts: the event time; then a tile gets its last row (closed) and its state goes once the watermark, ``late`` behind the
    newest event, is keep_ms past the tile's own newest event. Write in update mode. The state store has to be RocksDB
    (spark.sql.streaming.stateStore.providerClass)."""
    sides = [F.col(s).cast("double").alias(s) for s in SIDES]
    sound = stream.select(F.col("tile_id").cast("bigint").alias("tile_id"), "truth", F.col("box_id").cast("bigint").alias("box_id"), *sides, *([ts] if ts else []))
    sound = sound.dropna(subset=["tile_id", "truth", "box_id", *SIDES]).where("xmax > xmin and ymax > ymin")
    if ts:
        sound = sound.where(F.col(ts).isNotNull()).withWatermark(ts, late).withColumn("event_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    schema = "tile_id bigint, n_pred bigint, n_gt bigint, tp bigint, fp bigint, fn bigint, closed boolean"
    return sound.groupBy("tile_id").transformWithStateInPandas(_Matching(iou, keep_ms if ts else None), schema, "Update", "EventTime" if ts else "None")


def latest(rows: DataFrame, batch: str = "batch") -> DataFrame:
    """Of rows of live_matching with the number of their batch, the last of each tile."""
    return rows.groupBy("tile_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("tile_id", batch)]), batch).alias("r")).select("tile_id", "r.*")
