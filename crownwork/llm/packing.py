"""Best-fit packing of token sequences by minimum bin slack.

Pieces of equal length are alike, so the plan needs only how many there are of each length: at most ``width`` numbers,
whatever the size of the corpus. For each bin the longest length left is taken, then a subset-sum over the lengths
left (a bit set of the sums that can be reached, one shift for each power of two of copies) finds the fullest bin with
it. The combination is removed as many times as the counts allow, so the number of bins doesn't matter either.
Pieces then get their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored
from .tokens import encoder, slices, texts_of

#: Pieces that a worker keeps, and bytes of texts that it looks at together: in the pipeline it runs beside an executor that
#: earlier steps have filled.
KEPT, AT_ONCE = 200_000, 1_000_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def fullest(lengths: list[int], counts: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) whose sum is the most that fits into room. lengths: falling; of equal sums, long ones first."""
    reach, before, mask = 1, [], (1 << (room + 1)) - 1
    for length, count in zip(reversed(lengths), reversed(counts)):  # short first, so that long ones are read back first
        before.append((length, count, reach))
        left, copies = min(count, room // length), 1
        while left > 0:
            now = min(copies, left)
            reach |= (reach << (length * now)) & mask
            left, copies = left - now, copies * 2
        if reach >> room & 1 and length * 2 > room:
            break
    total, out = reach.bit_length() - 1, []
    for length, count, reach in reversed(before):
        n = next(k for k in range(min(count, total // length), -1, -1) if reach >> (total - k * length) & 1)
        if n:
            out.append((length, n))
            total -= n * length
    return out


def plan(histogram: dict[int, int], width: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination of (length, copies), times)], the longest length left first."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        first = lengths[0]
        left[first] -= 1
        usable = [x for x in lengths if x <= width - first and left[x] > 0]
        rest = fullest(usable, [left[x] for x in usable], width - first)
        left[first] += 1
        combination = dict(rest)
        combination[first] = combination.get(first, 0) + 1
        times = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((sorted(combination.items(), reverse=True), times))
    return out


def places(made: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: the first rank, the bin of that rank (one more for each next), the offset there."""
    ranks: dict[int, int] = {}
    runs: dict[int, list] = {}
    bin_0 = 0
    for combination, times in made:
        offset = 0
        for length, copies in combination:
            for _ in range(copies):
                rank = ranks.get(length, 0)
                runs.setdefault(length, []).append((rank, bin_0, offset))
                ranks[length] = rank + times
                offset += length
        bin_0 += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def _pieces(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, KEPT)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in slices(texts, AT_ONCE):
                flat, n = enc.ids(texts.slice(lo, hi - lo))
                raw, sizes = memoryview(np.insert(flat, np.cumsum(n), end_id).astype("<u4").tobytes()), (n + 1).tolist()
                rows, at = [], 0
                for key, size in zip(keys[lo:hi], sizes):
                    cuts = [0, *range(size % width or min(size, width), size + 1, width)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        rows.append((key, k, x, y - x, zlib.crc32(raw[4 * (at + x) : 4 * (at + y)])))
                    at += size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _assign(where: dict):
    def run(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                first, bin_0, offset = where[x]
                k = np.searchsorted(first, rank[own], side="right") - 1
                bins[own], offsets[own] = bin_0[k] + rank[own] - first[k], offset[k]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bins), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pieces(docs: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of docs(doc_id, text).

    A document of more than ``width`` ids is cut into pieces of that many, the first of which may be shorter. A null
    text is empty: one piece of the end id. Repeated rows are pieces of their own."""
    kept = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return kept.mapInArrow(_pieces(vocabulary, end_id, width), PIECES)


def pack(found: DataFrame, width: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. found: as pieces() returns it, lengths from 1 to width.

    Ranks within a length are counts of the slices before plus the place in the slice, so a length that a third of all
    pieces have isn't sorted in one task. An empty table gives an empty one."""
    sliced = found.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4096)).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # width rows at most
    where = places(plan(by_length, width))
    before = counts.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("own", F.row_number().over(own)).join(before, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_assign(where), f"{PIECES}, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, vocabulary: str, width: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places in as few sequences of ``width`` ids as this finds."""
    return pack(stored(pieces(docs, vocabulary, width, end_id)), width)
