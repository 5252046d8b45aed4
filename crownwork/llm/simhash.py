"""SimHash near-duplicates: fingerprints that differ in a few bits, found by counts of bits in segments.

1. A fingerprint for each text, in Arrow batches. Equal fingerprints are one from here on.
2. Embedding: the fingerprint's segments of two bits become their numbers of set bits, 32 numbers from 0 to 2. The
   Manhattan distance of two such vectors is at most the number of bits that differ, so it is a lower bound. A number is
   written in unary (00, 01, 11), and the distance is then the number of bits in which two written vectors differ.
3. Grid range join: the vector is cut into groups of segments. Of two vectors at most d apart, all groups but d agree. So
   each choice of all groups but d is a grid, the numbers in them are a cell, and pairs meet in a cell of some grid. A pair
   stays if the vectors are at most d apart, and then if the fingerprints are.
4. Cells with more than ``crowd`` fingerprints aren't paired. Their fingerprints go through a finer grid of segments of one
   bit in 16 groups; there a cell fixes all bits but 4 d, and so holds 2 ** (4 d) of them at most, 256 for two bits.
   Thus each fingerprint meets a bounded number of others, however many crowd together.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, discard, small_hint, stored
from .components import components

SEED = 42
#: Shingles whose bits are unpacked at a time, 64 bytes each.
AT_ONCE = 1 << 16


def shingles(raw: bytes, size: int):
    """The word n-grams of a text in UTF-8, A-Z lower-cased, words joined by one space; of fewer words all as one."""
    words = raw.lower().split()  # of bytes: A-Z only, and at 0x20 and 0x09 to 0x0D
    if not words:
        return
    size = min(size, len(words))
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    del words
    for at in range(0, len(ends) - size + 1, AT_ONCE):
        to = min(at + AT_ONCE, len(ends) - size + 1)
        yield [whole[x:y] for x, y in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())]


def prints(texts: list[bytes], size: int = 3) -> np.ndarray:
    """The fingerprints of texts: a bit is set if it is in over half of the hashes of the text's n-grams, repeats included."""
    counts, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    parts: list[list[int]] = []
    owner: list[int] = []

    def add():
        if parts:
            bits = np.unpackbits(np.array([h for p in parts for h in p], ">u8").view(np.uint8)).reshape(-1, 64)
            lengths = np.array([len(p) for p in parts])
            counts[owner] += np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64)
            total[owner] += lengths
            parts.clear()
            owner.clear()

    waiting, digest = 0, xxhash.xxh64_intdigest
    for k, raw in enumerate(texts):
        for some in shingles(raw, size):
            parts.append([digest(s, SEED) for s in some])
            owner.append(k)
            waiting += len(some)
            if waiting >= AT_ONCE:  # also after each full part of a long text, so a text has one part here
                add()
                waiting = 0
    add()
    return np.packbits(2 * counts > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _printed(size: int):
    def run(batches):
        for b in batches:
            raws = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            found = prints(raws, size) if raws else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def unary_counts(v: Column) -> Column:
    """The numbers of set bits in segments of two bits, each in unary."""
    odd = F.lit(0x5555555555555555)
    a, b = v.bitwiseAND(odd), F.shiftrightunsigned(v, 1).bitwiseAND(odd)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _masks(width: int, groups: int, apart: int) -> list[int]:
    """As signed 64-bit numbers: the segments of each choice of all but ``apart`` groups."""
    segments = 64 // width
    of = [k * groups // segments for k in range(segments)]
    out = []
    for left in combinations(range(groups), groups - apart):
        mask = sum(((1 << width) - 1) << (width * k) for k in range(segments) if of[k] in left)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _cells(prints_: DataFrame, vector: Column, masks: list[int]) -> DataFrame:
    """print, vector, grid, cell: a row for each grid."""
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("vector").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)]))
    return prints_.select("print", vector.alias("vector")).select("print", "vector", at.alias("at")).select("print", "vector", "at.grid", "at.cell")


def _met(cells: DataFrame, apart: int) -> DataFrame:
    """a, b: fingerprints of a cell at most ``apart`` bits apart; first the vectors are held against each other."""
    one, two = (cells.select("grid", "cell", F.col("print").alias(p), F.col("vector").alias(v)) for p, v in (("a", "va"), ("b", "vb")))
    near = F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= apart
    return one.join(two, ["grid", "cell"]).where(F.col("a") < F.col("b")).where(near & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= apart)).select("a", "b")


def links(prints_: DataFrame, apart: int = 2, crowd: int = 256) -> DataFrame:
    """a, b: all pairs of the fingerprints (print bigint, each once) that differ in at most ``apart`` bits, a < b; a pair may
    come several times. crowd changes the work, not the pairs."""
    groups = apart + 3
    cells = _cells(prints_, unary_counts(F.col("print")), _masks(2, groups, apart))
    crowded = stored(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("grid", "cell"))
    if crowded.isEmpty():
        return _met(cells, apart)
    few = small_hint(crowded)
    dense = stored(cells.join(few, ["grid", "cell"], "left_semi").select("print").distinct())
    fine = _cells(dense, F.col("print"), _masks(1, 16, apart))
    return _met(cells.join(few, ["grid", "cell"], "left_anti"), apart).unionByName(_met(fine, apart))


def classed(docs: DataFrame, size: int = 3, apart: int = 2, crowd: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of docs(doc_id, text): documents are linked when their
    fingerprints differ in at most ``apart`` bits; component_id is the least doc_id that links lead to, its own included.

    A text without words, or null, has the fingerprint zero, which is linked like any other. Rows of equal doc_id are
    rows of their own. A row without doc_id is linked too, but names no component: its component_id is the least doc_id
    among its links, null if none has one. Repeated rows stay repeated; an empty table gives no rows."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with batch_bytes(spark):
        rows = stored(own.mapInArrow(_printed(size), "doc_id bigint, print bigint"))
    # equal texts are one row here; xxhash64 of a number is another number for each, so nodes are no fewer than prints
    each = stored(rows.groupBy("print").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("print")))
    pairs = links(each.select("print"), apart, crowd)
    roots = components(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    joined = each.join(roots, "node", "left").select("print", "first", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(joined.join(least, "root").select("print", "component_id"))
    out = rows.join(small_hint(of), "print")
    out = stored(out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"))
    discard(rows, each, of)
    return out
