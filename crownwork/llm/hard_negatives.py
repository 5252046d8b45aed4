"""Hard negatives of anchors: exact integer scores by Strassen products of tiles, kept in heaps that merge.

1. Vectors become integers, floor(scale * x). Rows are dealt at random into tiles of at most about ``TILE`` rows; a tile is
   one row of a table, its integers packed in the narrowest type that holds them.
2. Positives: tiles of anchors meet tiles of candidates of their own label. Negatives: they meet all tiles. A task gets one
   tile of anchors and a slice of the candidates' tiles (the grid is dealt by both numbers, so neither a common label
   nor many anchors make one task large), multiplies tile by tile and keeps a heap for each anchor, or for each anchor's
   positive a heap of what lies in its window.
3. Heaps of an anchor meet and merge: what they hold are the best of disjoint sets.

Products are taken modulo 2 ** 64 (sums, differences and products of int64 wrap), so a score that fits in 64 bits is
exact, whatever the sums inside Strassen's recursion.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_hint, stored

#: Rows of a tile of anchors and of a tile of candidates; fewer where vectors are long.
TILE, WIDE = 256, 1024
#: Bytes of a candidates' tile, as int64.
TILE_BYTES = 4 << 20
#: Tiles of candidates in a task's slice.
SLICE = 32
LEAF = 32

LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices by seven products of halves; odd sides get a row or column of zeros."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    even = lambda x: np.pad(x, [(0, side % 2) for side in x.shape]) if any(side % 2 for side in x.shape) else x
    a, b = even(a), even(b)
    (h, w), v = (s // 2 for s in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * v), np.int64)
    out[:h, :v], out[:h, v:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :v], out[h:, v:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """For each of ``n`` owners the k greatest (score, -id) offered so far."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.owner, self.score, self.ident, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.worst = np.full(n, LOWEST)

    def offer(self, scores: np.ndarray, allowed: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        """scores, allowed: owners x candidates; ident, row: of the candidates."""
        able = allowed & (scores >= self.worst[:, None])
        if scores.shape[1] > 4 * self.k:  # the k-th best of this tile is a bound too; equal scores stay for their ids
            masked = np.where(able, scores, LOWEST)
            able &= masked >= np.partition(masked, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
        o, c = np.nonzero(able)
        if len(o):
            self._take(o, scores[o, c], ident[c], row[c])

    def _take(self, owner, score, ident, row):
        owner, score, ident, row = (np.concatenate(x) for x in ((self.owner, owner), (self.score, score), (self.ident, ident), (self.row, row)))
        order = np.lexsort((row, ident, ~score, owner))  # ~ turns the order round and has no overflow
        owner, score, ident, row = owner[order], score[order], ident[order], row[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        own = place < self.k
        self.owner, self.score, self.ident, self.row = owner[own], score[own], ident[own], row[own]
        full = place == self.k - 1
        self.worst[owner[full]] = score[full]


def _packed(values: np.ndarray) -> tuple[str, bytes]:
    for kind in ("<i2", "<i4"):
        if not values.size or (values.min() >= np.iinfo(kind).min and values.max() <= np.iinfo(kind).max):
            return kind, values.astype(kind).tobytes()
    return "<i8", values.astype("<i8").tobytes()


_TILE = "label bigint, tile int, n int, rows array<bigint>, ids array<bigint>, labels array<bigint>, windows array<array<bigint>>, kind string, held binary"


def _tiled(width: int):
    """The rows of a tile as one row, in ascending order of vec_id."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        held = np.zeros((t.num_rows, width), np.int64)
        vectors = t.column("v").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        held[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy()
        kind, raw = _packed(held)
        first = lambda c: t.column(c)[0].as_py()
        one = {"label": first("of"), "tile": first("tile"), "n": t.num_rows, "rows": t.column("row").to_pylist(), "ids": t.column("vec_id").to_pylist(), "labels": t.column("label").to_pylist(), "windows": t.column("windows").to_pylist(), "kind": kind, "held": raw}
        kinds = {"label": pa.int64(), "tile": pa.int32(), "n": pa.int32(), "rows": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "labels": pa.list_(pa.int64()), "windows": pa.list_(pa.list_(pa.int64())), "kind": pa.string(), "held": pa.binary()}
        return pa.table({c: pa.array([one[c]], kinds[c]) for c in one})

    return run


def _matrix(t: pd.DataFrame, k: int, width: int) -> np.ndarray:
    return np.frombuffer(t["held"].iloc[k], t["kind"].iloc[k]).reshape(t["n"].iloc[k], width).astype(np.int64)


def _met(width: int, most: int, windows: bool):
    """A tile of anchors against a slice of candidates' tiles. Without windows: each anchor's best others of its label.
    With: for each window (positive's id and row, least and greatest score) of each anchor the best rows of other labels."""

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        columns = ["anchor", "slot", "ident", "row", "score"]
        if not len(own) or not len(others):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        a, rows, labels = _matrix(own, 0, width), np.asarray(own["rows"].iloc[0]), np.asarray(own["labels"].iloc[0])
        slots = 1
        if windows:
            per = own["windows"].iloc[0]
            slots = max(len(w) for w in per) // 2
            bounds = np.array([[*w, *[1, 0] * (slots - len(w) // 2)] for w in per], np.int64).reshape(len(per), slots, 2)  # what is added is empty
        heaps = [Heaps(len(a), most) for _ in range(slots)]
        for k in range(len(others)):
            ids, who = np.asarray(others["ids"].iloc[k]), np.asarray(others["rows"].iloc[k])
            scores = strassen(a, np.ascontiguousarray(_matrix(others, k, width).T))
            if windows:
                apart = labels[:, None] != np.asarray(others["labels"].iloc[k])
                for s, heap in enumerate(heaps):
                    heap.offer(scores, apart & (scores >= bounds[:, s, :1]) & (scores <= bounds[:, s, 1:]), ids, who)
            else:
                heaps[0].offer(scores, rows[:, None] != who, ids, who)
        return pd.DataFrame({"anchor": np.concatenate([rows[h.owner] for h in heaps]), "slot": np.repeat(np.arange(slots), [len(h.owner) for h in heaps]), "ident": np.concatenate([h.ident for h in heaps]), "row": np.concatenate([h.row for h in heaps]), "score": np.concatenate([h.score for h in heaps])})

    return run


def _grid(anchors: DataFrame, rows: DataFrame, width: int, most: int, windows: bool) -> DataFrame:
    """anchor, slot, ident, row, score: the best of all tiles for each anchor. anchors and rows have ``of``; tiles are made
    of rows of one ``of`` and meet those of the same."""
    wide = max(16, min(WIDE, TILE_BYTES // (8 * max(width, 1))))
    counts = lambda df, n, per: df.groupBy("of").agg(F.ceil(F.count("*") / per).cast("int").alias(n))
    sizes = stored(counts(rows, "wides", wide).join(counts(anchors, "tiles", min(TILE, wide)), "of").withColumn("slices", F.ceil(F.col("wides") / SLICE).cast("int")))
    dealt = lambda df, n: df.join(small_hint(sizes.select("of", n)), "of").withColumn("tile", F.pmod(F.xxhash64("row", F.lit(7)), F.col(n)).cast("int"))
    tiles = lambda df, n: stored(dealt(df, n).select("of", "tile", "row", "vec_id", "label", "windows", "v").groupBy("of", "tile").applyInArrow(_tiled(width), _TILE))
    own, others = tiles(anchors, "tiles"), tiles(rows, "wides")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shapes = small_hint(sizes.select(F.col("of").alias("label"), "tiles", "slices"))
    left = own.join(shapes, "label").select("label", "tile", upto("slices").alias("slice"), "n", "rows", "labels", "windows", "kind", "held")
    right = others.join(shapes, "label").select("label", upto("tiles").alias("tile"), F.pmod("tile", "slices").alias("slice"), "n", "rows", "ids", "labels", "kind", "held")
    by = ["label", "tile", "slice"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_met(width, most, windows), "anchor bigint, slot bigint, ident bigint, row bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "ident", "row"))
    out = stored(met.withColumn("place", best).where(F.col("place") <= most))
    discard(sizes, own, others)
    return out


def mined(vectors: DataFrame, positives: int = 5, negatives: int = 10, every: int = 100, least: int = 30, greatest: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, embedding, label).

    A row's score is its inner product with the anchor in whole numbers, floor(scale * x) for each component; higher ones
    come first, ties by the smaller vec_id. Anchors: rows whose vec_id is divisible by ``every``. Positives: an anchor's
    first ``positives`` other rows of its label. For each, the first ``negatives`` rows of other labels whose score is
    from least to greatest percent of the positive's.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Rows that share a vec_id
    are rows of their own: each is an anchor and a candidate, and another such row may be an anchor's positive. A vector
    shorter than the longest one ends in zeros; an empty one has scores of zero. Scores beyond 64 bits wrap. An anchor
    without positives, or a positive with nothing in its window, gives no row; nor does an empty table."""
    spark = vectors.sparkSession
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = stored(sound.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:
        width = 1  # scores of empty vectors are zero
    none = F.lit(None).cast("array<bigint>")
    own = rows.withColumn("windows", none).withColumn("of", F.col("label"))
    asked = F.col("vec_id") % every == 0
    near = _grid(own.where(asked), own, width, positives, False)
    bounds = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: F.array(_part(s["score"], least, True), _part(s["score"], greatest, False))))
    windows = near.groupBy(F.col("anchor").alias("row")).agg(bounds.alias("windows"))  # ``positives`` windows a row
    seekers = own.where(asked).drop("windows").join(windows, "row")
    found = _grid(seekers.withColumn("of", F.lit(0).cast("bigint")), own.withColumn("of", F.lit(0).cast("bigint")), width, negatives, True)
    named = near.select("anchor", (F.col("place") - 1).cast("bigint").alias("slot"), F.col("ident").alias("positive_id"), F.col("score").alias("positive_score"))
    of = rows.where(asked).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.join(named, ["anchor", "slot"]).join(of, "anchor")
    out = stored(out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("ident").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(rows, near, found)
    return out


def _part(score, percent: int, up: bool):
    """percent of a score as a whole number, rounded up or down, without overflow."""
    exact = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(4,0)")
    return (F.ceil(exact) if up else F.floor(exact)).cast("bigint")


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vectors, the label of rows whose vec_id is divisible by ``every`` moved on by one, modulo ``labels``."""
    label = F.col("label").cast("bigint")
    return vectors.select("vec_id", "embedding", F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label).alias("label"))


def oracle_sql() -> str:
    """The rows of the query in SQL: exact sums of products of whole numbers."""
    return """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from sound a join sound b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positive as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
ranked as (
  select anchor_id, positive_id, other_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as rank
  from positive join scored using (anchor_id)
  where not same and 100 * score between 30 * positive_score and 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from ranked where rank <= 10"""
