"""Detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import ratio
from ..functions.storage import stored


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + 1e-9)


def overlap_metrics(scored: DataFrame, truth: DataFrame, by: list[str], threshold: float = 0.4, evaluated: DataFrame | None = None) -> DataFrame:
    """By group: n_pred, n_tp (value >= threshold), n_gt, precision, recall, f1, mean_overlap over all predictions.

    scored: one row for each prediction with ``value``; truth: one row for each ground truth. Several predictions may
    count for one ground truth, so recall can be over 1. evaluated: the groups to report, such as the tiles with a
    prediction file, be it empty; without it, all that have predictions or truth. A group without predictions has zeros."""
    counts = scored.groupBy(*by).agg(F.count("*").alias("n_pred"), F.count_if(F.col("value") >= threshold).alias("n_tp"), F.avg("value").alias("mean_overlap"))
    gt = truth.groupBy(*by).agg(F.count("*").alias("n_gt"))
    if not by:
        both = counts.crossJoin(gt)  # a row each
    elif evaluated is None:
        both = counts.join(gt, by, "full")
    else:
        both = evaluated.select(*by).distinct().join(counts, by, "left").join(gt, by, "left")
    both = both.fillna(0, ["n_pred", "n_tp", "n_gt"]).fillna(0.0, ["mean_overlap"])
    both = both.withColumns({"precision": ratio(F.col("n_tp"), F.col("n_pred")), "recall": ratio(F.col("n_tp"), F.col("n_gt"))})
    return both.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def counted(predictions: DataFrame, truth: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """By group: tp, fp, fn and precision, recall, f1 of a one-to-one matching (rows of ``matched``)."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = n(predictions, "n_pred").join(n(truth, "n_gt"), by, "full").join(n(matched, "n_tp"), by, "left")
    out = both.select(*by, zero("n_tp").alias("tp"), (zero("n_pred") - zero("n_tp")).alias("fp"), (zero("n_gt") - zero("n_tp")).alias("fn"))
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _dealt(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return stored(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_part", F.spark_partition_id()))


def running_sums(df: DataFrame, by: list[str], order: list, values: dict[str, str]) -> DataFrame:
    """Running sums of values (column: new name) by group in a total order, dealt by ranges: a group may be any size.

    Rows are summed within the partition; what the partitions before hold is added."""
    part = _dealt(df, by, order)
    own = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = part.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in values])  # a row for each group and partition
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*by, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in values])
    summed = part.withColumns({f"_own_{c}": F.sum(c).over(own) for c in values}).join(shift, [*by, "_part"])
    return summed.select(*df.columns, *[(F.col(f"_own_{c}") + F.col(f"_{c}")).alias(n) for c, n in values.items()])


def max_of_rest(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The greatest value of the row and all after it, by group in the order of a column without ties: from the last row
    on, so that each row adds one to the maximum so far."""
    part = _dealt(df, by, [F.asc(order)])
    own = Window.partitionBy(*by, "_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    tops = part.groupBy(*by, "_part").agg(F.max(value).alias("_top"))
    rest = tops.select(*by, "_part", F.max("_top").over(after).alias("_rest"))
    found = part.withColumn("_own", F.max(value).over(own)).join(rest, [*by, "_part"])
    return found.select(*df.columns, F.greatest("_own", "_rest").alias(name))


def pr_curve(labelled: DataFrame, n_gt: DataFrame, by: list[str]) -> DataFrame:
    """Points of the precision-recall curve: by, pred_id, score, rank, recall, precision (the envelope: greatest from
    the point on). labelled: by, pred_id, score, tp (0 or 1); n_gt: by, n_gt."""
    order = [F.desc("score"), F.asc("pred_id")]
    ranked = running_sums(labelled.withColumn("one", F.lit(1)), by, order, {"tp": "ctp", "one": "rank"})
    points = ranked.join(n_gt, by).where("n_gt > 0")
    points = points.select(*by, "pred_id", "score", "rank", ratio(F.col("ctp"), F.col("n_gt")).alias("recall"), ratio(F.col("ctp"), F.col("rank")).alias("own"))
    return max_of_rest(points, by, "rank", "own", "precision").drop("own")


def average_precision(points: DataFrame, by: list[str]) -> DataFrame:
    """by, ap: the trapezoids under the envelope between neighbouring points; nothing before the first point.

    Only points that change recall have width, so the others' neighbours are looked up in their partition of ranks."""
    nxt = points.select(*by, (F.col("rank") + 1).alias("rank"), F.col("recall").alias("r0"), F.col("precision").alias("p0"))
    areas = points.join(nxt, [*by, "rank"], "left")
    return areas.groupBy(*by).agg(F.greatest(F.coalesce(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2), F.lit(0.0)), F.lit(0.0)).alias("ap"))


def best_f1(points: DataFrame, by: list[str]) -> DataFrame:
    """The first point of the greatest F1 on the envelope: precision, recall, f1, threshold."""
    f1 = _f1(F.col("precision"), F.col("recall"))
    top = points.withColumn("f1", f1).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("rank")).alias("less"), "precision", "recall", "score")).alias("t"))
    return top.select(*by, "t.precision", "t.recall", "t.f1", F.col("t.score").alias("threshold"))


def interpolated_precision(points: DataFrame, by: list[str], steps: int = 101) -> DataFrame:
    """by, ap: the mean of the envelope at ``steps`` evenly spaced recalls (0 beyond the last)."""
    first = points.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(F.col("recall") * (steps - 1) + 1e-9).cast("int"))))
    at = first.groupBy(*by, "step").agg(F.max("precision").alias("p"))
    return at.groupBy(*by).agg((F.sum("p") / steps).alias("ap"))


def imagewise(predictions: DataFrame, truth: DataFrame, matched: DataFrame, image: str = "image_id") -> DataFrame:
    """recall: mean over images with ground truth of matched / ground truth (0 without predictions); precision: mean
    over those of them that have predictions, NaN if none has."""
    n = lambda df, name: df.groupBy(image).agg(F.count("*").alias(name))
    both = n(truth, "n_gt").join(n(predictions, "n_pred"), image, "left").join(n(matched, "n_tp"), image, "left").fillna(0)
    return both.agg(F.avg(ratio(F.col("n_tp"), F.col("n_gt"))).alias("recall"), F.coalesce(F.avg(F.when(F.col("n_pred") > 0, ratio(F.col("n_tp"), F.col("n_pred")))), F.lit(float("nan"))).alias("precision"))
