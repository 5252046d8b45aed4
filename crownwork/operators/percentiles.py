"""Exact percentiles of groups of any size: counted bins, narrowed in rounds to the wanted rank.

A round counts each group's values in bins between its least and greatest one, which is summed before the shuffle, so a
task sends at most ``bins`` rows a group. The bin that holds the rank is the next round's range. Bins are even on a
logarithmic scale first, so that outliers don't stretch them, and even in value from then on; a round narrows a range
about ``bins`` times. What is left of at most ``few`` rows is ordered. No task holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, stored

_MOST = 1.7976931348623157e308


def _scaled(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float], bins: int = 1024, few: int = 4096) -> DataFrame:
    """by, share, n, value: for each group the percentile at each share (0 to 1), between two values in proportion.

    Nulls and NaN don't count; infinite values count as the greatest double. A group whose key holds a null is a group.
    A group without values gives no rows. df is read a few times: store what is dear to compute."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.withColumn("_v", F.greatest(F.least("_v", F.lit(_MOST)), F.lit(-_MOST)))
    stats = stored(rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    asked = stats.select(*by, "_n", "_lo", "_hi", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    asked = asked.withColumn("_at", (F.col("_n") - 1) * F.col("share"))
    ends = F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))
    # a row for each group and rank: the rank, the range that holds it, the rows before the range and in it
    wanted = stored(asked.select(*by, F.explode(ends).alias("_rank"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_before"), F.col("_n").alias("_in")).distinct())

    def within(ranges: DataFrame) -> DataFrame:
        one, two = rows.alias("o"), ranges.alias("t")
        both = one.join(two, [F.col(f"o.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by] or None, "inner") if by else one.crossJoin(F.broadcast(two))  # a row a rank
        return both.where("_v between _lo and _hi").select(*[F.col(f"t.{c}") for c in by], "_v", "_rank", "_lo", "_hi", "_before")

    linear = False
    while True:
        is_open = (F.col("_in") > few) & (F.col("_lo") < F.col("_hi"))
        if wanted.where(is_open).isEmpty():
            break
        scale = (lambda c: c) if linear else _scaled
        # halves, as the whole distance of two doubles may be beyond them
        share = (scale(F.col("_v")) / 2 - scale(F.col("_lo")) / 2) / (scale(F.col("_hi")) / 2 - scale(F.col("_lo")) / 2)
        place = F.when(scale(F.col("_hi")) > scale(F.col("_lo")), F.least(F.floor(share * bins), F.lit(bins - 1))).otherwise(0)
        counted = within(wanted.where(is_open)).groupBy(*by, "_rank", "_before", place.alias("_bin")).agg(F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_in").over(Window.partitionBy(*by, "_rank").orderBy("_bin"))  # ``bins`` rows
        found = counted.withColumn("_before", F.col("_before") + upto - F.col("_in")).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
        old, wanted = wanted, stored(wanted.where(~is_open).unionByName(found.select(*wanted.columns)))
        discard(old)
        linear = True
    order = F.row_number().over(Window.partitionBy(*by, "_rank").orderBy("_v")) - 1 + F.col("_before")  # ``few`` rows
    exact = within(wanted.where("_lo < _hi")).withColumn("_k", order).where("_k = _rank").select(*by, "_rank", "_v")
    exact = stored(exact.unionByName(wanted.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v"))))
    low, high = (exact.select(*by, F.col("_rank").alias(r), F.col("_v").alias(n)) for r, n in (("_r0", "_v0"), ("_r1", "_v1")))
    out = asked.withColumns({"_r0": F.floor("_at"), "_r1": F.ceil("_at")})
    for side, r in ((low, "_r0"), (high, "_r1")):
        out = out.alias("o").join(side.alias("s"), [F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col(f"o.{r}") == F.col(f"s.{r}")]).select("o.*", F.col("s." + r.replace("r", "v")))
    weight = F.col("_at") - F.col("_r0")
    out = stored(out.select(*by, "share", F.col("_n").alias("n"), F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(F.col("_v0") * (1 - weight) + F.col("_v1") * weight).alias("value")))
    discard(stats, wanted, exact)
    return out
