"""Removal of repeated byte strings by a logarithmic family of sampled suffix indexes.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or the same
document at a smaller offset). Suffixes are sampled: of every ``length`` bytes, the one whose first GRAM bytes have the
least hash is the anchor, so equal strings have equal anchors at equal places. Consecutive strings with one anchor are
a run. The suffixes that start at anchors are ordered by the hash of their first GRAM bytes (name) and that of the
bytes of the whole run (run), and these sorted arrays stand for suffix arrays: they are held per batch, merge-scanned
and merged as those would be, but their order is that of hashes, as only equality of 100 bytes matters, not which
string is less. Arrays of all suffixes were ruled out by measurement: doubling prefixes to 100 bytes in numpy takes 0.9
CPU seconds for 1 MB, so 900 a GB before any merge, against 355 for this whole operator; and an entry a byte (place and
eight bytes of order, 16 bytes) is 16 times the input in the index and in each shuffle, against 2.4 times here.

1. Each task names its anchors; of runs that it has seen in an earlier document, only the first goes on.
2. Anchors go to partitions by name, in document order. Each new batch is sorted, merge-scanned against the levels of the
   partition's index, and becomes a level; levels of equal rank merge into one of the next. A run that is there already
   repeats from end to end. A name that comes with another run repeats in part.
3. Runs that repeat in part are compared string by string, with the same family of levels over hashes of all their
   strings: those have one anchor, so they meet in one partition.
4. The repeated strings' union, by document, is cut out.

Hashes have 64 bits, names and runs together 128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, forget, small_batches, small_hint, stored
from .ngram_join import mixed

GRAM = 24
_P = 0x5851F42D4C957F2D
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACE = 24  # bits of a place in a slice of texts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, p in enumerate((_P, _P_INVERSE)):
            steps = np.full(n, p, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Prefixes:
    """Hashes of any substrings of a byte string: polynomials modulo 2**64."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[first]) * self.down[first])

    def windows(self, size: int) -> np.ndarray:
        """Those of all substrings of ``size`` bytes."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int):
    """For documents on end in raw (document k: bounds[k] to bounds[k + 1]): document, first string, strings, name and
    run of each run of strings that have one anchor."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Prefixes(raw)
    names = hashes.windows(GRAM)
    key = (names >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(names), dtype=np.uint64)
    width, best, size = length - GRAM + 1, key, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = (best & np.uint64((1 << _PLACE) - 1)).astype(np.int64)  # the anchor of the string that starts at each byte
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + length <= bounds[1:][doc])
    if not len(starts):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.concatenate([[True], (np.diff(at[starts]) != 0) | (np.diff(starts) != 1)])
    first = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    anchor = at[first]
    run = mixed(hashes.of(first, first + count - 1 + length) + (anchor - first).astype(np.uint64))
    return doc[first], first - bounds[doc[first]], count, names[anchor], run


class Levels:
    """Sorted arrays of hashes; each added one is a level of rank 0, and two of a rank merge into one of the next."""

    def __init__(self):
        self.levels: list[tuple[int, tuple[np.ndarray, ...]]] = []

    def __iter__(self):
        return (columns for _, columns in self.levels)

    def add(self, *columns: np.ndarray):
        """columns: the first is sorted by; the others go with it."""
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, other = self.levels.pop()
            both = [np.concatenate(x) for x in zip(other, columns)]
            order = np.argsort(both[0], kind="stable")
            columns, rank = tuple(x[order] for x in both), rank + 1
        self.levels.append((rank, columns))


def held(level: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(level, wanted), max(len(level) - 1, 0))
    return level[at] == wanted if len(level) else np.zeros(len(wanted), bool)


def _slices(raws: list[bytes], most: int = 1 << 18):
    at, size = 0, 0
    for k, r in enumerate(raws):
        if k > at and size + len(r) > most:
            yield at, k
            at, size = k, 0
        size += len(r)
    if at < len(raws):
        yield at, len(raws)


def _parts(raw: bytes, length: int):
    """A very long document in pieces that share length - 1 bytes, so that each string is in one piece: (offset, piece)."""
    most = 1 << 18
    if len(raw) <= most:
        return [(0, raw)]
    return [(k, raw[k : k + most]) for k in range(0, len(raw) - length + 1, most - length + 1)]


def _encoded(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


ROWS = "ord bigint, th bigint, lo bigint, n int, name bigint, run bigint, again boolean"


def _named(length: int, most: int = 1_000_000):
    def run(batches):
        forget()
        seen, held_rows = Levels(), 0
        for b in batches:
            order, th, raws = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), _encoded(b.column(2))
            pieces = [(k, at, p) for k, r in enumerate(raws) for at, p in _parts(r, length)]
            for lo, hi in _slices([p for _, _, p in pieces]):
                some = pieces[lo:hi]
                bounds = np.concatenate([[0], np.cumsum([len(p) for _, _, p in some])])
                doc, first, count, name, same = anchors(np.frombuffer(b"".join(p for _, _, p in some), np.uint8), bounds, length)
                if not len(doc):
                    continue
                of, shift = np.array([k for k, _, _ in some])[doc], np.array([at for _, at, _ in some])[doc]
                first = first + shift
                by = np.lexsort((first, th[of], order[of], same, name))
                again = np.zeros(len(by), bool)
                again[1:] = (name[by][1:] == name[by][:-1]) & (same[by][1:] == same[by][:-1])
                both, own = mixed(name[by] + mixed(same[by])), order[of][by]
                for hashes, documents in seen:  # a run that a great part of the documents has goes on once for a task
                    at = np.minimum(np.searchsorted(hashes, both), len(hashes) - 1)
                    again |= (hashes[at] == both) & (documents[at] < own)
                fresh = np.flatnonzero(~again)
                fresh = fresh[np.argsort(both[fresh], kind="stable")]
                if held_rows > most:
                    seen, held_rows = Levels(), 0
                if len(fresh):
                    seen.add(both[fresh], own[fresh])
                    held_rows += len(fresh)
                cols = (order[of][by], th[of][by], first[by], count[by].astype(np.int32), name[by].view(np.int64), same[by].view(np.int64), again)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in ROWS.split(", ")])

    return run


VERDICTS = "ord bigint, th bigint, lo bigint, n int, name bigint, whole boolean"


def _scanned(batches):
    """Anchors of a partition in document order: those whose run was there before (whole), and those whose name comes
    with more than one run (not whole), each at least once."""
    forget()
    index, runs = Levels(), Levels()

    def rows(cols, name, pick, whole):
        arrays = [pa.array(c[pick]) for c in cols] + [pa.array(name[pick].view(np.int64)), pa.array(np.full(len(pick), whole))]
        return pa.RecordBatch.from_arrays(arrays, ["ord", "th", "lo", "n", "name", "whole"])

    for b in batches:
        cols = [b.column(c).to_numpy() for c in ("ord", "th", "lo", "n")]
        name, same = (b.column(c).to_numpy().view(np.uint64) for c in ("name", "run"))
        if not len(name):
            continue
        both = mixed(name + mixed(same))
        first = np.zeros(len(both), bool)
        first[np.unique(both, return_index=True)[1]] = True
        whole = ~first
        for (level,) in runs:
            whole |= held(level, both)
        yield rows(cols, name, np.flatnonzero(whole), True)
        fresh = np.flatnonzero(~whole)
        fresh = fresh[np.argsort(name[fresh], kind="stable")]
        own = name[fresh]
        told = np.zeros(len(fresh), bool)
        told[1:] |= own[1:] == own[:-1]
        told[:-1] |= own[1:] == own[:-1]
        for level in index:
            lo, hi = np.searchsorted(level[0], own), np.searchsorted(level[0], own, side="right")
            told |= hi > lo
            near = np.unique(np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
            near = near[~level[5][near]]
            if len(near):
                level[5][near] = True
                yield rows(level[1:5], level[0], near, False)
        if told.any():
            yield rows(cols, name, fresh[told], False)
        if len(fresh):
            index.add(own, *[c[fresh] for c in cols], told)
            runs.add(np.sort(both[fresh]))


def _contexts(length: int):
    """The bytes of a document's runs that repeat in part."""

    def run(batches):
        for b in batches:
            order, th, raws = b.column(0).to_pylist(), b.column(1).to_pylist(), _encoded(b.column(2))
            out: list = [[], [], [], [], []]
            for o, t, raw, runs in zip(order, th, raws, b.column(3).to_pylist()):
                for r in runs:
                    for c, x in zip(out, (r["name"], o, t, r["lo"], raw[r["lo"] : r["lo"] + r["n"] - 1 + length])):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["name", "ord", "th", "lo", "held"])

    return run


def _compared(length: int):
    """Runs of a partition in document order: their strings that were there before, as (lo, n)."""

    def run(batches):
        forget()
        seen = Levels()
        for b in (b.slice(at, 2500) for b in batches for at in range(0, b.num_rows, 2500)):
            order, th, lo, raws = b.column("ord").to_numpy(), b.column("th").to_numpy(), b.column("lo").to_numpy(), b.column("held").to_pylist()
            if not raws:
                continue
            sizes = np.array([len(r) for r in raws])
            bounds, counts = np.cumsum(sizes) - sizes, sizes - length + 1
            of = np.repeat(np.arange(len(raws)), counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            first = bounds[of] + within
            strings = Prefixes(np.frombuffer(b"".join(raws), np.uint8)).of(first, first + length)
            values, at = np.unique(strings, return_index=True)
            old = np.zeros(len(values), bool)
            for (level,) in seen:
                old |= held(level, values)
            again = np.ones(len(strings), bool)
            again[at[~old]] = False
            seen.add(values[~old])
            hit = np.flatnonzero(again)
            if len(hit):
                new = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)])
                start, n = hit[new], np.diff(np.append(np.flatnonzero(new), len(hit)))
                yield pa.RecordBatch.from_arrays([pa.array(order[of[start]]), pa.array(th[of[start]]), pa.array(lo[of[start]] + within[start]), pa.array(n.astype(np.int32))], ["ord", "th", "lo", "n"])

    return run


def _united(length: int):
    """The union of a document's repeated strings, as [first byte, end) pairs."""

    def run(batches):
        for b in batches:
            out = []
            for runs in b.column(2).to_pylist():
                spans = sorted((r["lo"], r["lo"] + r["n"] - 1 + length) for r in runs)
                one = [list(spans[0])]
                for x, y in spans[1:]:
                    if x <= one[-1][1]:
                        one[-1][1] = max(y, one[-1][1])
                    else:
                        one.append([x, y])
                out.append([x for s in one for x in s])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["ord", "th", "spans"])

    return run


def _identity(text, seed: int):
    return F.xxhash64(F.lit(seed), text)


def repeated_spans(docs: DataFrame, length: int = 100) -> tuple[DataFrame, DataFrame]:
    """ord and th (a document's key), kept (a struct of all columns but text) and text; and the spans by ord and th:
    first bytes and ends, on end.

    ord: doc_id, null the least. Rows of equal doc_id stand in the order of th, a hash of the text; those of equal
    doc_id and text are one document. Where two texts of a doc_id share a hash, all are hashed anew with another seed;
    that is seen by a second hash, so texts are told apart by 128 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"])
    most, clash, seed = 0, True, -1
    while clash:
        seed += 1
        th = _identity(text, seed)
        of = docs.select(order.alias("ord"), th.alias("th"), F.xxhash64(F.lit(-1), text).alias("other")).groupBy("ord", "th")
        most, clash = of.agg(F.count("*").alias("n"), (F.min("other") != F.max("other")).alias("clash")).agg(F.max("n"), F.max("clash")).first()
    keyed = small_batches(docs.select(order.alias("ord"), th.alias("th"), others.alias("kept"), F.col("text").cast("string").alias("text")))
    # rows of equal doc_id and text would be seen as repeats of themselves
    texts = keyed.select("ord", "th", "text")
    texts = texts.dropDuplicates(["ord", "th"]) if (most or 0) > 1 else texts
    runs = stored(texts.mapInArrow(_named(length), ROWS))
    order = ("ord", "th", "lo")
    fresh = runs.where("not again").select("ord", "th", "lo", "n", "name", "run")
    verdicts = stored(fresh.repartition("name").sortWithinPartitions(*order).mapInArrow(_scanned, VERDICTS))
    partial = verdicts.where("not whole").groupBy("ord", "th").agg(F.collect_list(F.struct("lo", "n", "name")).alias("runs"))
    held_runs = texts.join(partial, ["ord", "th"]).select("ord", "th", "text", "runs").mapInArrow(_contexts(length), "name bigint, ord bigint, th bigint, lo bigint, held binary")
    compared = held_runs.repartition("name").sortWithinPartitions(*order).mapInArrow(_compared(length), "ord bigint, th bigint, lo bigint, n int")
    columns = ("ord", "th", "lo", "n")
    strings = runs.where("again").select(*columns).unionByName(verdicts.where("whole").select(*columns)).unionByName(compared)
    by_doc = strings.groupBy("ord", "th").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    spans = stored(by_doc.mapInArrow(_united(length), "ord bigint, th bigint, spans array<bigint>"))
    discard(runs, verdicts)
    return keyed, spans


def _cut(digest: bool):
    """Adds to each row its text without the spans, and the counts."""

    def run(batches):
        for b in batches:
            kept, sizes, gone, number = [], [], [], []
            for raw, spans in zip(_encoded(b.column(1)), b.column(2).to_pylist()):
                edges = [0, *(spans or []), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2])))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                number.append(len(spans or []) // 2)
            if digest:
                last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())
            else:
                last = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(number, pa.int64()), last], ["kept", "n_bytes", "n_removed", "n_spans", "left"])

    return run


def deduplicated(docs: DataFrame, length: int = 100, digest: bool = False, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs(doc_id, text, ...) as column ``kept`` (a struct of all columns but text), with n_bytes,
    n_removed, n_spans and ``left``: the text without repeated strings (digest: the SHA-256 of its bytes).

    A null text is an empty one. A cut may fall inside a character; ``left`` is then without that character's rest."""
    keyed, spans = repeated_spans(docs, length)
    joined = keyed.join(small_hint(spans, broadcast_bytes), ["ord", "th"], "left").select("kept", "text", "spans")
    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return joined.mapInArrow(_cut(digest), T.StructType([joined.schema["kept"], *numbers, T.StructField("left", T.StringType())]))
