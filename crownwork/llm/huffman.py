"""Token-id files: canonical length-limited Huffman codes of ids, from global counts.

A file is a folder in the shared store with three Parquet tables, so that Spark writes and reads it in parallel:

* ``codebook``: token_id, code_length. Canonical codes follow from the lengths: shorter first, then smaller id.
* ``segments``: shard, seq, doc_ids, n_tokens, n_ids, checkpoints, payload. A segment holds whole documents, ordered
  by (shard, seq); ``payload`` is one bit string, and ``checkpoints`` has the bit offset of every BLOCK-th id, so each
  block is decoded on its own, and all blocks of a segment in step, by one table of 2**limit entries.
* ``staged``: the ids before coding, since the codes need the counts of all of them. ``read_ids`` doesn't use it.

Order: doc_id ascending, null first; documents that repeat a doc_id stand by text. A null text is an empty one. Every
document ends with ``end_id``. An empty table gives empty tables. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches
from .tokens import encoder, slices, texts_of

BLOCK = 256
STAGED = "shard int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, ids binary"
CODED = "shard int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, checkpoints array<bigint>, payload binary"


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits (package-merge); 0 where the count is 0.

    counts: one for each id of the vocabulary. A single id with a count gets 1 bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    n, levels, packed = len(order), [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([leaf, packed])
        by = np.argsort(both, kind="stable")
        levels.append(by < n)  # which of the sorted entries are leaves; the rest are packages, in order
        both = both[by][: len(by) // 2 * 2]
        packed = both[::2] + both[1::2]
    take = 2 * n - 2
    bits = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the ids, by length and then id."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible next ``limit`` bits: the id, and the length of its code."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, limit - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    total = int(spans.sum())
    ids[:total], bits[:total] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids as a bit string, first bit highest, and the bit offset of every BLOCK-th id."""
    bits = lengths[ids].astype(np.int64)
    at = np.cumsum(bits) - bits
    words = (int(bits.sum()) + 31) // 32 + 1
    both = codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)  # over two words of 32 bits
    word = at >> 5
    out = np.bincount(word, weights=(both >> np.uint64(32)).astype(np.float64), minlength=words)
    out[1:] += np.bincount(word, weights=(both & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)[: words - 1]
    return out.astype(np.uint32).astype(">u4").tobytes(), at[::BLOCK]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """The n ids of a segment: the k-th id of all blocks at once, for k from 0."""
    ids_of, bits_of = table
    raw = np.frombuffer(payload + b"\0" * 4, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.array(checkpoints, np.int64)
    out = np.zeros((BLOCK, len(at)), np.uint32)
    last = n - BLOCK * (len(at) - 1)
    mask = (1 << limit) - 1
    for k in range(min(BLOCK, n)):
        if k == last:
            at = at[:-1]
        peek = (window[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & mask
        out[k, : len(at)] = ids_of[peek]
        at = at + bits_of[peek]
    return out.T.reshape(-1)[:n]


def _stage(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, seq = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids, total = [], [], [], 0

        def full():
            flat = np.concatenate(ids).astype("<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())],
                ["shard", "seq", "doc_ids", "n_tokens", "ids"],
            )

        for b in batches:
            keys, texts = b.column(0).to_pylist(), texts_of(b.column(1))
            for lo, hi in slices(texts, most):
                flat, n = enc.ids(texts.slice(lo, hi - lo))
                ids.append(np.insert(flat, np.cumsum(n), end_id))
                sizes.append(n + 1)
                doc_ids += keys[lo:hi]
                total += len(ids[-1])
                if total >= most // 4:
                    yield full()
                    doc_ids, sizes, ids, total, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield full()

    return run


def _width(payload: bytes, n: int) -> str:
    return "<u2" if len(payload) == 2 * n else "<u4"


def _count(batches):
    counts = np.zeros(1, np.int64)
    for b in batches:
        for sizes, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            more = np.bincount(np.frombuffer(ids, _width(ids, sum(sizes))))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["token_id", "n"])


def _code(lengths: np.ndarray):
    def run(batches):
        codes = canonical(lengths)
        for b in batches:
            for row in b.to_pylist():
                n = sum(row["n_tokens"])
                payload, checkpoints = pack(np.frombuffer(row["ids"], _width(row["ids"], n)), codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int32()), pa.array([row["seq"]], pa.int32()), pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["n_tokens"]], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([checkpoints], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    ["shard", "seq", "doc_ids", "n_tokens", "n_ids", "checkpoints", "payload"],
                )

    return run


def write_ids(docs: DataFrame, vocabulary: str, out: str | None = None, end_id: int = 0, limit: int = 16, segment_bytes: int = 2_000_000) -> str:
    """Writes the ids of docs(doc_id, text) to a folder in the shared store, and returns its path.

    vocabulary: a file of the tokenizers library. limit: bits of the longest code; raised where the vocabulary needs it.
    The driver gets one count for each id of the vocabulary, whatever the size of docs."""
    spark, out = docs.sparkSession, out or shared_path(docs.sparkSession)
    kept = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ordered = kept.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ordered.mapInArrow(_stage(vocabulary, end_id, segment_bytes), STAGED).write.option("compression", "zstd").parquet(f"{out}/staged")
    staged = spark.read.schema(STAGED).parquet(f"{out}/staged")
    found = staged.select("n_tokens", "ids").mapInArrow(_count, "token_id bigint, n bigint").groupBy("token_id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["token_id"] for r in found], default=0) + 1, np.int64)
    counts[[r["token_id"] for r in found]] = [r["n"] for r in found]
    limit = max(limit, int(np.count_nonzero(counts)).bit_length())
    lengths = code_lengths(counts, limit)
    book = [(int(i), int(lengths[i]), limit) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "token_id bigint, code_length int, code_limit int").coalesce(1).write.parquet(f"{out}/codebook")
    staged.mapInArrow(_code(lengths), CODED).write.option("compression", "zstd").parquet(f"{out}/segments")
    return out


def _decode(lengths: np.ndarray, limit: int):
    def run(batches):
        table = decode_table(lengths, limit)
        for b in batches:
            for row in b.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ids = unpack(row["payload"], row["checkpoints"], row["n_ids"], table, limit).astype("<u4")
                ends, raw = np.cumsum(sizes), memoryview(ids.tobytes())
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes, pa.int64()), pa.array([bytes(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.binary())],
                    ["shard", "seq", "place", "doc_id", "n_tokens", "ids"],
                )

    return run


def _digest(run):
    """The rows of run, with the ids' checksum in their place."""

    def digested(batches):
        for b in run(batches):
            crc = pa.array([zlib.crc32(x) for x in b.column("ids").to_pylist()], pa.int64())
            yield b.set_column(b.schema.get_field_index("ids"), "ids_crc32", crc)

    return digested


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the documents of a folder that write_ids made.

    start: ids of all documents before it. digest: ids_crc32 in place of ids."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row for each id of the vocabulary at most
    limit = book[0]["code_limit"] if book else 1
    lengths = np.zeros(max([r["token_id"] for r in book], default=0) + 1, np.uint8)
    for r in book:
        lengths[r["token_id"]] = r["code_length"]
    segments, run = spark.read.schema(CODED).parquet(f"{path}/segments"), _decode(lengths, limit)
    kind = "ids_crc32 bigint" if digest else "ids binary"
    rows = segments.mapInArrow(_digest(run) if digest else run, f"shard int, seq int, place int, doc_id bigint, n_tokens bigint, {kind}")
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each partition that was written
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    own = Window.partitionBy("shard").orderBy("seq", "place")
    start = F.col("shard_start") + F.sum("n_tokens").over(own) - F.col("n_tokens")
    return rows.join(before, "shard").select("doc_id", start.alias("start"), "n_tokens", kind.split()[0])
