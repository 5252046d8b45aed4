"""Nearest vectors by shifted space-filling curves.

Each of ``curves`` Hilbert curves orders the vectors by their projection to ``dims`` directions of its own, shifted by an
offset of its own. Every ordering is dealt out by key ranges and cut into blocks of ``block`` rows. A query is compared
with the vectors of its block and of the neighbouring ones on either side; what the curves find is merged and ranked by
the inner product of the original vectors, in double precision.

How many blocks a window has on either side is measured: ``probes`` queries at most are held against all vectors, one
product with a few rows, and the window is the smallest that holds ``recall`` of what they have nearest on some curve.
So vectors in clusters get windows of few rows however many vectors there are, and vectors without near neighbours,
which no index can tell apart, get wide ones.

Greatest inner product is nearest distance once vectors get one more component that brings all to the same length
(data: sqrt(M^2 - |x|^2), queries: 0), so vectors of any length are found.

Equal vectors are one entry, with the k + 1 smallest ids of it, so a vector that a third of all rows hold is one point
of each curve and its rows are never paired. Directions and scales come from a bounded sample of about ``sample``
vectors; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows; coordinates below 2**bits) on the Hilbert curve. dims * bits: 62 at most.

    Axes become the curve's transposed index by undoing, from the highest bit down, the reflections and exchanges
    that each cell applies to its corners; the Gray code of the rest is the key, its bits interleaved."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            on = (x[i] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> b & 1
    return key


class Curves:
    """The curves, fitted to a sample of vectors (rows)."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, dims: int, bits: int, seed: int):
        rng, width = np.random.default_rng(seed), sample.shape[1] + 1
        dims = min(dims, width)
        self.longest, self.bits, self.turns = longest, bits, []
        lifted = self.data(sample)
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(width, dims)))[0]
            at = lifted @ turn
            self.turns.append((turn, at.mean(0), np.maximum(at.std(0), 1e-12), rng.uniform(0, 1, dims)))

    def data(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def query(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x * (self.longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))])

    def keys(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        turn, mean, scale, shift = self.turns[curve]
        cells = ((lifted @ turn - mean) / scale + shift + 4) / 9 * (1 << self.bits)
        return hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _keyed(fitted: Curves):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(2))
            if not len(x):
                continue
            gid, asked = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            data, query = fitted.data(x), fitted.query(x[asked])
            for c in range(len(fitted.turns)):
                for kind, own, lifted in ((0, gid, data), (1, gid[asked], query)):
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(fitted.keys(lifted, c)), pa.array(np.full(n, kind, np.int32)), pa.array(own)], ["curve", "key", "kind", "gid"])

    return run


def _placed(batches):
    """Adds the partition, and how many vectors of the curve stand before the row there."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        curve, kind = b.column(0).to_numpy(), b.column(2).to_numpy()
        local = np.zeros(len(curve), np.int64)
        for c in np.unique(curve).tolist():
            own = np.flatnonzero(curve == c)
            count = np.cumsum(kind[own] == 0)
            local[own] = seen.get(c, 0) + count - (kind[own] == 0)
            seen[c] = seen.get(c, 0) + int(count[-1])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.full(len(curve), part, np.int32)), pa.array(local)], ["curve", "kind", "gid", "part", "local"])


def greatest(queries: np.ndarray, data: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k greatest inner products of each query with rows of data, ties by ``least``.

    A product in blocks gives the k-th greatest; all rows that reach it, but for rounding, are scored anew, each by
    the same order of addition, so that equal vectors have equal scores wherever they stand."""
    near, n = queries @ data.T, min(k, len(data))
    bar = np.partition(near, len(data) - n, axis=1)[:, len(data) - n]
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(data, axis=1).max()
    row, col = np.nonzero(near >= (bar - slack)[:, None])
    score = np.concatenate([(queries[row[at : at + 100_000]] * data[col[at : at + 100_000]]).sum(1) for at in range(0, len(row), 100_000)])
    order = np.lexsort((least[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, np.arange(len(queries)))
    own = np.arange(len(row)) - first[row] < n
    return row[own], col[own], score[own]


def _exact(gids: np.ndarray, queries: np.ndarray, k: int):
    """The k greatest inner products of a few queries with the vectors of each batch."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(2))
            if len(x):
                row, col, score = greatest(queries, x, b.column(1).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(gids[row]), b.column(0).take(pa.array(col)), b.column(1).take(pa.array(col)), pa.array(score)], ["qgid", "gid", "least", "score"])

    return run


def _best(k: int):
    """The k nearest vectors of a block for each of its queries."""

    def run(t: pa.Table) -> pa.Table:
        kind, gid, least = (t.column(c).to_numpy() for c in ("kind", "gid", "least"))
        x = _matrix(t.column("embedding"))
        data, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        out: list = [[], [], [], []]
        for at in range(0, len(asked) if len(data) else 0, 512):
            some = asked[at : at + 512]
            row, col, score = greatest(x[some], x[data], least[data], k)
            for c, v in zip(out, (gid[some][row], gid[data][col], least[data][col], score)):
                c.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({c: pa.array(x.astype(kind)) for c, x, kind in zip(("qgid", "gid", "least", "score"), cols, kinds)})

    return run


def _reach(groups: DataFrame, ranked: DataFrame, k: int, probes: int, recall: float) -> int:
    """The blocks on either side within which some curve has ``recall`` of what a few queries have nearest."""
    some = groups.where("asked").orderBy(F.xxhash64("gid", F.lit(5)), "gid").limit(probes).select("gid", "embedding").toPandas()
    if not len(some):
        return 0
    exact = groups.select("gid", "least", "embedding").mapInArrow(_exact(some["gid"].to_numpy(), np.array(some["embedding"].tolist(), np.float64), k), "qgid bigint, gid bigint, least bigint, score double")
    top = F.row_number().over(Window.partitionBy("qgid").orderBy(F.desc("score"), "least"))
    pairs = stored(exact.withColumn("r", top).where(F.col("r") <= k).select("qgid", "gid"))  # probes * k rows
    at = ranked.join(F.broadcast(pairs), "gid").where("kind = 0").select("qgid", "gid", "curve", "own")
    asked = ranked.where("kind = 1").join(F.broadcast(pairs.select("qgid").distinct()), F.col("gid") == F.col("qgid")).select("qgid", "curve", F.col("own").alias("q_own"))
    gaps = at.join(asked, ["qgid", "curve"]).groupBy("qgid", "gid").agg(F.min(F.abs(F.col("own") - F.col("q_own"))).alias("gap"))
    counts = sorted((r["gap"], r["n"]) for r in gaps.groupBy("gap").agg(F.count("*").alias("n")).collect())  # a row a distance
    total, seen = sum(c for _, c in counts), 0
    for gap, c in counts:
        seen += c
        if seen >= recall * total:
            return int(gap)
    return 0


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, curves: int = 12, dims: int = 8, bits: int = 6, block: int = 1024, recall: float = 0.95, probes: int = 256, sample: int = 10_000, seed: int = 1
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every``, the k nearest other rows found.

    vectors: vec_id, embedding (array of float or double). Ties go to the smaller vec_id. Vectors that are null, all
    zero, of another dimension than the commonest (of equally common ones the greatest), or hold null or non-finite
    components take no part; nor does a row without vec_id. Rows that share a query's vec_id aren't among its candidates."""
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists("embedding", lambda x: x != 0))
    width = sound.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if width is None:
        return empty
    sound = sound.where(F.size("embedding") == width["w"])
    groups = stored(sound.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.max(F.col("vec_id") % every == 0).alias("asked")).select(F.xxhash64("embedding").alias("gid"), "least", "asked", "embedding"))
    n, longest = groups.agg(F.count("*"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    members = stored(sound.join(groups.select("gid", "embedding"), "embedding").select("gid", "vec_id").distinct())
    some = groups.where(F.pmod(F.xxhash64("gid"), F.lit(1 << 30)) < int(min(1, sample / n) * (1 << 30))).select("embedding").toPandas()
    if not len(some):
        some = groups.select("embedding").limit(1).toPandas()
    fitted = Curves(np.array(some["embedding"].tolist(), np.float64), float(np.sqrt(longest)), curves, dims, bits, seed)

    keyed = groups.select("gid", "asked", "embedding").mapInArrow(_keyed(fitted), "curve int, key bigint, kind int, gid bigint")
    order = ("curve", "key", "kind", "gid")
    placed = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_placed, "curve int, kind int, gid bigint, part int, local bigint"))
    totals = placed.groupBy("curve", "part").agg(F.sum((F.col("kind") == 0).cast("bigint")).alias("n"))  # curves * partitions rows
    before = totals.select("curve", "part", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    last = (n - 1) // block
    own = F.least(F.floor((F.col("before") + F.col("local")) / block), F.lit(last)).cast("bigint")
    ranked = stored(placed.join(F.broadcast(before), ["curve", "part"]).select("curve", "kind", "gid", own.alias("own")))
    reach = _reach(groups, ranked, k + 1, probes, recall) if last else 0
    blocks = F.when(F.col("kind") == 0, F.array("own")).otherwise(F.sequence(F.greatest(F.col("own") - reach, F.lit(0)), F.least(F.col("own") + reach, F.lit(last))))
    dealt = ranked.select("curve", "kind", "gid", F.explode(blocks).alias("block")).join(groups.select("gid", "least", "embedding"), "gid")
    found = dealt.groupBy("curve", "block").applyInArrow(_best(k + 1), "qgid bigint, gid bigint, least bigint, score double")

    best = found.groupBy("qgid", "gid").agg(F.min("least").alias("least"), F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("qgid").orderBy(F.desc("score"), "least", "gid"))).where(F.col("r") <= k + 1).drop("r")
    salt = members.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    for by in (["gid", "salt"], ["gid"]):
        salt = salt.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    queries = members.where(F.col("vec_id") % every == 0).select(F.col("gid").alias("qgid"), F.col("vec_id").alias("query_id"))
    pairs = best.join(salt.select("gid", "vec_id"), "gid").join(queries, "qgid").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
