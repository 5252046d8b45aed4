"""Statistics of directions in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def _mean(sin: str, cos: str) -> Column:
    return (F.degrees(F.atan2(F.col(sin), F.col(cos))) + 360) % 360


def consensus(df: DataFrame, by: str, azimuth: str, within: float = 45.0, reliable: float = 70.0) -> DataFrame:
    """By group: the mean direction of what lies within ``within`` degrees of the mean of all (of all, if nothing
    does), as azimuth and unit vector; how many agree, their spread (circular standard deviation), their share in
    percent, and whether that is at least ``reliable``."""
    sin, cos = F.sin(F.radians(azimuth)), F.cos(F.radians(azimuth))
    known = df.where(F.col(azimuth).isNotNull()).select(by, (F.pmod(F.col(azimuth), F.lit(360.0))).alias("a"), sin.alias("s"), cos.alias("c"))
    centre = known.groupBy(by).agg(F.avg("s").alias("ms"), F.avg("c").alias("mc")).select(by, _mean("ms", "mc").alias("centre"))
    near = known.join(centre, by).withColumn("near", distance(F.col("a"), F.col("centre")) <= within)
    some = lambda f, c: f(F.when(F.col("near"), F.col(c)))
    agg = near.groupBy(by).agg(F.count("*").alias("n"), F.count_if("near").alias("k"), some(F.avg, "s").alias("s1"), some(F.avg, "c").alias("c1"), F.avg("s").alias("s0"), F.avg("c").alias("c0"))
    agg = agg.select(by, "n", F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n")).alias("n_inliers"), F.coalesce("s1", "s0").alias("s"), F.coalesce("c1", "c0").alias("c"))
    length = F.least(F.sqrt(F.col("s") ** 2 + F.col("c") ** 2), F.lit(1.0))
    share = 100.0 * F.col("n_inliers") / F.col("n")
    mean = F.atan2("s", "c")
    return agg.select(
        by, "n", "n_inliers", (F.col("n") - F.col("n_inliers")).alias("n_outliers"), _mean("s", "c").alias("azimuth"), F.sin(mean).alias("shadow_x"), F.cos(mean).alias("shadow_y"), length.alias("length"),
        F.when(length > 0, F.degrees(F.sqrt(-2 * F.ln(F.when(length > 0, length))))).otherwise(180.0).alias("circular_std"), share.alias("consensus_pct"), (share >= reliable).alias("reliable"),
    )


def naive_summary(df: DataFrame, by: str, azimuth: str) -> DataFrame:
    """Plain statistics of the numbers, which are wrong across north; kept for comparison."""
    return df.groupBy(by).agg(F.avg(azimuth).alias("mean"), F.stddev_pop(azimuth).alias("std"), F.min(azimuth).alias("least"), F.max(azimuth).alias("greatest"))


def commonest(df: DataFrame, column: str) -> DataFrame:
    """The commonest value; of equally common ones the smallest."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)
