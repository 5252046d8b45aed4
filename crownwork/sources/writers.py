"""Writers of detections and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def features(detections: DataFrame, *more: str) -> DataFrame:
    """image_id, tree_id (from 1, in the order of det_id) and feature (JSON) of detections(image_id, det_id, score, box,
    ring array<struct<x, y>>)."""
    tree = F.row_number().over(Window.partitionBy("image_id").orderBy("det_id"))
    box = F.array("xmin", "ymin", "xmax", "ymax")
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    props = F.struct(tree.alias("tree_id"), F.col("score").alias("deepforest_score"), area.alias("area_pixels"), box.alias("bbox"), *more)
    one = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return detections.select("image_id", tree.alias("tree_id"), one.alias("feature"))


def write_geojson(detections: DataFrame, path: str, crs: str = "EPSG:4326", lines: bool = False) -> None:
    """A FeatureCollection for each image, in folders by image_id; lines: a feature on each line, for images of any
    number of detections."""
    rows = features(detections)
    if lines:
        rows.select("image_id", F.to_json("feature").alias("value")).write.partitionBy("image_id").text(path)
        return
    every = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("tree_id", "feature"))).alias("f"))
    named = F.struct(F.lit("name").alias("type"), F.struct(F.lit(crs).alias("name")).alias("properties"))
    doc = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("f", lambda x: x["feature"]).alias("features"), named.alias("crs"))
    every.select("image_id", F.to_json(doc).alias("value")).write.partitionBy("image_id").text(path)


def write_box_csv(boxes: DataFrame, path: str) -> None:
    boxes.write.option("header", True).csv(path)


def write_tile_meta(tiles: DataFrame, path: str) -> None:
    """One JSON document for each tile, in folders by image_id."""
    kept = [c for c in tiles.columns]
    tiles.select("image_id", F.to_json(F.struct(*kept)).alias("value")).write.partitionBy("image_id").text(path)


def write_summary(metrics: DataFrame, best: DataFrame, path: str) -> None:
    """Metrics by model, with the best operating point nested."""
    own = best.select("model", F.struct(*[c for c in best.columns if c != "model"]).alias("optimum"))
    metrics.join(own, "model", "left").write.json(path)
