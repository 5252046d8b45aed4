"""Order-dependent scans over a table of edges: groups that share no node are finished apart from each other.

A group (the columns ``by``, such as the image) of at most ``most`` edges is finished in one task, by a plain scan; small
groups share a task. The edges of larger groups are split into connected components, which are finished alike, and
only components that are still too large go by rounds over the whole table. Edges are written once, and once more if
their group is large.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import discard, stored
from .components import roots

MOST = 1_000_000


def _solved(edges: DataFrame, total: int, solve: Callable[[pa.Table], pa.Table], schema: str, most: int) -> DataFrame:
    """Groups of edges (``_g``) dealt to tasks of about a twentieth of ``most``."""
    tasks = max(1, 20 * total // most + 1)
    return edges.withColumn("_task", F.pmod(F.xxhash64("_g", F.lit(3)), F.lit(tasks))).groupBy("_task").applyInArrow(lambda t: solve(t.drop_columns("_task")), schema)


def _parted(edges: DataFrame, most: int) -> tuple[DataFrame, int, DataFrame | None]:
    """The edges of groups of ``most`` edges at most, how many they are, and the other edges, if any."""
    sizes = edges.groupBy("_g").agg(F.count("*").alias("n"))
    small, large = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= most, F.col("n"))), F.lit(0)), F.count_if(F.col("n") > most)).first()
    if not large:
        return edges, small, None
    big = stored(sizes.where(F.col("n") > most).select("_g"))  # total / ``most`` rows
    return edges.join(big, "_g", "left_anti"), small, edges.join(big, "_g", "left_semi")


def by_groups(edges: DataFrame, by: list[str], ends: tuple[Column, Column], solve: Callable[[pa.Table], pa.Table], schema: str, rounds: Callable[[DataFrame], DataFrame], most: int = MOST) -> DataFrame:
    """What solve makes of all edges. ends: an edge's two nodes as hashes. solve gets whole groups, several at once, with their
    number ``_g``; rounds does the same for edges of any number. Without by, components are looked for at once."""
    own = stored(edges.withColumn("_g", F.xxhash64(*by) if by else F.lit(0).cast("bigint")))
    fitting, total, rest = _parted(own, most) if by else (None, 0, own)
    found = [_solved(fitting, total, solve, schema, most)] if total else []
    if rest is not None:
        a, b = (F.xxhash64("_g", e) for e in ends)
        named = stored(rest.withColumns({"_a": a, "_b": b}))
        root = roots(named.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        apart = stored(named.withColumn("_by", F.col("_g")).join(root.withColumnRenamed("node", "_a"), "_a").withColumn("_g", F.col("root")).drop("_a", "_b", "root"))
        discard(named)
        fitting, total, giants = _parted(apart, most)
        if total:
            found.append(_solved(fitting.drop("_by"), total, solve, schema, most))
        if giants is not None:
            found.append(rounds(giants.withColumn("_g", F.col("_by")).drop("_by")))
    if not found:
        return edges.sparkSession.createDataFrame([], schema)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
