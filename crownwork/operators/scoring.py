"""Scoring of tiles by a function that is plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From a tile's values (height x width) to rows (xmin, ymin, xmax, ymax, score) in the tile.
Scorer = Callable[[np.ndarray], list[tuple[float, float, float, float, float]]]

SCORED = "image_id bigint, x0 bigint, y0 bigint, xmin double, ymin double, xmax double, ymax double, score double, error string"


def threshold_scorer(threshold: float = 128.0) -> Scorer:
    """One box around all values over the threshold, scored by their mean share of 255: for tests and examples."""

    def score(tile: np.ndarray):
        y, x = np.nonzero(tile > threshold)
        return [(float(x.min()), float(y.min()), float(x.max() + 1), float(y.max() + 1), float(tile[y, x].mean() / 255))] if len(y) else []

    return score


def scored(tiles: DataFrame, load: Callable[[], Scorer], least: float = 0.0, done: DataFrame | None = None) -> DataFrame:
    """Boxes of tiles(image_id, x0, y0, w, h, data array) in image coordinates, with score >= least.

    ``load`` makes the scorer, once in each task. Images in ``done`` are left out. A tile that fails gives one row with
    ``error`` and no box, and the others go on."""
    todo = tiles if done is None else tiles.join(done.select("image_id").distinct(), "image_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        names = [c.split()[0] for c in SCORED.split(", ")]
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    for x0, y0, x1, y1, s in scorer(np.asarray(r.data, dtype=float).reshape(int(r.h), int(r.w))):
                        if s >= least:
                            rows.append((r.image_id, r.x0, r.y0, r.x0 + x0, r.y0 + y0, r.x0 + x1, r.y0 + y1, s, None))
                except Exception as e:  # noqa: BLE001  the scorer is foreign code
                    rows.append((r.image_id, r.x0, r.y0, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=names)

    return todo.select("image_id", "x0", "y0", "w", "h", "data").mapInPandas(run, SCORED)


#: From a crop's values to the sine and cosine of its shadow's azimuth.
AzimuthScorer = Callable[[np.ndarray], tuple[float, float]]


def brightness_slope_scorer() -> AzimuthScorer:
    """Points from the bright to the dark half of a crop: for tests and examples."""

    def score(crop: np.ndarray):
        y, x = np.mgrid[: crop.shape[0], : crop.shape[1]]
        dark = crop.max() - crop
        total = float(dark.sum())
        if not total:
            return 0.0, 0.0
        return float((x * dark).sum() / total - x.mean()), float(y.mean() - (y * dark).sum() / total)

    return score


def scored_azimuths(crops: DataFrame, load: Callable[[], AzimuthScorer]) -> DataFrame:
    """image_id, crop_id, azimuth (degrees from north, clockwise) of crops(image_id, crop_id, h, w, data array), by a scorer
    that ``load`` makes once in each task: the rows that ``functions.circular.consensus`` takes. A scorer's vector need
    not have length 1; a crop whose vector is 0, or that fails, has no azimuth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()

        def azimuth(data, h, w):
            try:
                s, c = scorer(np.asarray(data, dtype=float).reshape(int(h), int(w)))
            except Exception:  # noqa: BLE001  the scorer is foreign code
                return None
            return float(np.degrees(np.arctan2(s, c)) % 360) if s or c else None

        for pdf in batches:
            found = [azimuth(*row) for row in zip(pdf["data"], pdf["h"], pdf["w"])]
            yield pd.DataFrame({"image_id": pdf["image_id"], "crop_id": pdf["crop_id"], "azimuth": pd.Series(found, dtype="float64", index=pdf.index)})

    return crops.select("image_id", "crop_id", "h", "w", "data").mapInPandas(run, "image_id bigint, crop_id bigint, azimuth double")


def progress(scored_rows: DataFrame) -> DataFrame:
    """By image: boxes found and tiles failed."""
    return scored_rows.groupBy("image_id").agg(F.count_if(F.col("error").isNull()).alias("boxes"), F.count("error").alias("failed"))
