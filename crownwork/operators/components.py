"""Connected components of pixels, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, stored
from .percentiles import percentiles


def runs(px: DataFrame) -> DataFrame:
    """Pixels (image_id, y, x) as row runs: image_id, y, x0, x1 (half open), run_id."""
    w = Window.partitionBy("image_id", "y").orderBy("x")
    new = F.coalesce((F.col("x") - F.lag("x").over(w)) > 1, F.lit(True)).cast("int")
    numbered = px.select("image_id", "y", "x", new.alias("new")).withColumn("k", F.sum("new").over(w))
    spans = numbered.groupBy("image_id", "y", "k").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return spans.withColumn("run_id", F.xxhash64("image_id", "y", "x0")).drop("k")


def roots(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of edges(a bigint, b bigint); equal roots are one component.

    Each round every node joins its least neighbour, the edges are taken between what the nodes joined, and each round's
    tables are written; those of the round before go. Node numbers should be hashes: then a round at least halves the
    nodes that still have edges, long chains too. Nodes whose edges all lead to themselves are left out."""
    left = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, last = None, None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        moved = left.join(to.select("a", F.col("p").alias("pa")), "a").join(to.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        before, left = left, stored(moved.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        discard(before)
        if labels is None:
            labels, last = to.select(F.col("a").alias("node"), F.col("p").alias("root")), to
        else:
            labels = stored(labels.join(to.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
            discard(last, to)
            last = labels
    discard(left)
    return edges.sparkSession.createDataFrame([], "node bigint, root bigint") if labels is None else labels


def labelled(px: DataFrame) -> DataFrame:
    """Row runs of the pixels with ``label``: 8-neighbour components, named by their first run (least y, then x0)."""
    return label_spans(runs(px).drop("run_id"))


def label_spans(runs_: DataFrame, cut: bool = False) -> DataFrame:
    """Row runs (image_id, y, x0, x1) with ``label``, as labelled. cut: runs of a row may touch, as those cut at the edges of
    tiles do."""
    spans = stored(runs_.withColumn("run_id", F.xxhash64("image_id", "y", "x0")))
    below = spans.select("image_id", (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("run_id").alias("b"))
    # runs of neighbouring rows that touch, corners too, meet in cells of 64 pixels
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / 64), F.floor(hi / 64)))
    one = spans.select("image_id", "y", "x0", "x1", F.col("run_id").alias("a"), cells(F.col("x0") - 1, F.col("x1")).alias("c"))
    two = below.select("image_id", "y", "b0", "b1", "b", cells(F.col("b0"), F.col("b1") - 1).alias("c"))
    edges = one.join(two, ["image_id", "y", "c"]).where("b0 <= x1 and x0 <= b1").select("a", "b")
    if cut:
        beside = spans.select("image_id", "y", F.col("x1").alias("x0"), F.col("run_id").alias("a"))
        edges = edges.unionByName(beside.join(spans.select("image_id", "y", "x0", F.col("run_id").alias("b")), ["image_id", "y", "x0"]).select("a", "b"))
    found = spans.join(roots(edges).withColumnRenamed("node", "run_id"), "run_id", "left").withColumn("root", F.coalesce("root", "run_id"))
    first = found.groupBy("image_id", "root").agg(F.min(F.struct("y", "x0")).alias("f"))
    return found.join(first, ["image_id", "root"]).select("image_id", "y", "x0", "x1", F.concat_ws("_", F.col("f.y"), F.col("f.x0")).alias("label"))


def measured(spans: DataFrame) -> DataFrame:
    """area and bounds (inclusive) of each label."""
    return spans.groupBy("image_id", "label").agg(F.sum(F.col("x1") - F.col("x0")).alias("area"), F.min("x0").alias("xmin"), F.min("y").alias("ymin"), (F.max("x1") - 1).alias("xmax"), F.max("y").alias("ymax"))


def without_specks(px: DataFrame, least: int = 150) -> DataFrame:
    """The pixels whose component has at least ``least`` of them."""
    spans = labelled(px.select("image_id", "y", "x"))
    large = spans.join(measured(spans).where(F.col("area") >= least).select("image_id", "label"), ["image_id", "label"], "left_semi")
    kept = large.select("image_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    return px.join(kept, ["image_id", "y", "x"], "left_semi")


def instances(px: DataFrame, value: str, threshold: float = 0.5, least: int = 50) -> DataFrame:
    """Components of pixels over the threshold: label, area, score (mean value), bounds; small ones go."""
    on = px.where(F.col(value) > threshold)
    spans = labelled(on.select("image_id", "y", "x"))
    cells = spans.select("image_id", "y", "label", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    both = on.join(cells, ["image_id", "y", "x"])
    out = both.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.avg(value).alias("score"), F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))
    return out.where(F.col("area") >= least)


def crown_proposals(px: DataFrame, value: str, azimuth: Column, width: int, height: int, threshold: float = 0.35, least: int = 200, back: float = 12.0, box: int = 90, share: float = 0.1) -> DataFrame:
    """A crown box for each shadow component: the mean of the tenth (``share``) of its pixels that is nearest along the
    azimuth, moved back by ``back`` pixels, with a box of ``box`` around it, corners cut to whole numbers towards zero, within
    the image. Boxes that are empty go."""
    on = px.where(F.col(value) >= threshold)
    spans = labelled(on.select("image_id", "y", "x"))
    large = measured(spans).where(F.col("area") >= least).select("image_id", "label")
    cells = spans.join(large, ["image_id", "label"]).select("image_id", "label", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    sx, sy = F.sin(F.radians(azimuth)), -F.cos(F.radians(azimuth))
    along = stored(cells.withColumn("t", F.col("x") * sx + F.col("y") * sy))
    cut = percentiles(along, ["image_id", "label"], "t", [share]).select("image_id", "label", F.col("value").alias("cut"))
    end = along.join(cut, ["image_id", "label"]).where("t <= cut").groupBy("image_id", "label").agg((F.avg("x") - back * sx).alias("cx"), (F.avg("y") - back * sy).alias("cy"))
    half = int(box) // 2
    low = lambda c: F.greatest((F.col(c) - half).cast("bigint"), F.lit(0))
    high = lambda c, top: F.least((F.col(c) + half).cast("bigint"), F.lit(top))
    out = end.select("image_id", "label", low("cx").alias("xmin"), low("cy").alias("ymin"), high("cx", width).alias("xmax"), high("cy", height).alias("ymax"))
    return out.where("xmax > xmin and ymax > ymin")
