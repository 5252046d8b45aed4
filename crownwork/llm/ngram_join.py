"""N-gram Jaccard join by a blocked sparse product of the documents' n-gram incidence.

Sets of n-grams are held as 64-bit hashes. The rows of the product are distinct sets: documents of equal sets are one
row, however many they are. Three steps, none of which loses a link of Jaccard similarity >= percent / 100:

1. Bounds. A set of n n-grams shares ceil(n * percent / 100) of them with each linked one, whatever that one's size. So
   if all n-grams stand in one order, linked sets have a common one among their first n - ceil(n * percent / 100) + 1.
   The order puts n-grams that many documents hold last (``levels_of``), so that a passage or line that is in many
   texts brings none of them together. Of some more leading n-grams they share as many more, so texts that have no more
   than an n-gram in common, whose number grows with the square of the documents, aren't looked at (``SHARED``). Of two
   sets that share so many, bit strings of some bits for each n-gram
   tell how many n-grams differ at least, and the sizes how many may; what differs in more is discarded. Of an n-gram
   that leads in more than ``crowd`` sets no pairs are made: sets of a part of them are put to leaders whose bits
   differ little, and leaders are chained if their bits differ in no more than three such steps allow (a linked pair's
   leaders do). Rows so chained are a family.
2. Product. A family's incidence matrix is multiplied by its transpose, some columns at a time, and overlap counts
   accumulate: dense products for columns that many rows hold, pairs for the others. Links follow from counts and sizes.
3. A family too large for one task is first compared with a few of its rows, its leaders. Rows linked to one leader are
   one component already, and a row linked to several makes theirs one. The rows of the largest of these components need
   no further comparison among themselves. All others are multiplied by the whole family, block of rows by block of rows,
   each its own task, and each block gives only a spanning forest of its links.

The table of frequent n-grams only orders them: it comes from counts within batches, and no result depends on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, forget, small_batches, small_hint, stored
from .components import components

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64(0xFFFFFFFF)
#: So many leading n-grams linked sets share, or one that leads in a crowd.
SHARED = 3
_SLOTS = 22  # bits of an n-gram's hash that find its place in the table of frequent ones


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[0]
    return x ^ (x >> np.uint64(32))


def word_sets(texts: pa.Array | list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, on end, and how many each has. A-Z are lower-cased,
    words are what is between the six white-space bytes. None for texts without words; of fewer words than ``size``, one
    for the whole sequence."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds, words = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    named = pc.binary_length(words.dictionary).to_numpy() > 0
    at = words.indices.to_numpy()
    real = named[at] if len(at) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]  # white space at either end gives words of no length
    flat = hashes[at[real]]
    whole = np.full(max(len(flat) - size + 1, 0), size, np.uint64)
    for j in range(size):
        whole = mixed(whole * _K[1] + flat[j : j + len(whole)])
    out, counts = [], np.zeros(len(texts), np.int64)
    for k, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        if hi - lo >= size:
            grams = np.sort(whole[lo : hi - size + 1])
            out.append(grams[np.append(True, grams[1:] != grams[:-1])])
        elif hi > lo:
            one = np.full(1, hi - lo, np.uint64)
            for h in flat[lo:hi]:
                one = mixed(one * _K[1] + h)
            out.append(one)
        else:
            continue
        counts[k] = len(out[-1])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def node_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A number for each set, equal for equal sets."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return _digest(owner, hashes, len(counts), counts.astype(np.uint64))


def _digest(key: np.ndarray, hashes: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
    """For each key below n, a hash of the hashes that have it, whatever their order."""
    high = np.bincount(key, weights=(hashes >> np.uint64(32)).astype(np.float64), minlength=n)  # whole numbers below 2**53
    low = np.bincount(key, weights=(hashes & _LOW).astype(np.float64), minlength=n)
    return mixed(mixed(high.astype(np.uint64) * _K[0] + salt) + low.astype(np.uint64) * _K[2])


def leading_grams(hashes: np.ndarray, counts: np.ndarray, percent: int, level: np.ndarray, shared: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The first n-grams of each set, on end, of which linked sets share ``shared``, or all that the larger one must have in
    common, if those are fewer; and how many each has. level: by a hash's first bits, how many documents hold it, in powers
    of two."""
    first = np.minimum(counts - (counts * percent + 99) // 100 + shared, counts)
    rank = level[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | mixed(hashes) >> np.uint64(6)
    ends, out = np.cumsum(counts), []
    for n, end, k in zip(counts.tolist(), ends.tolist(), first.tolist()):
        own = hashes[end - n : end]
        out.append(own[np.argpartition(rank[end - n : end], k - 1)[:k]] if k < n else own)
    return (np.concatenate(out) if out else hashes[:0]), first


def _parts(batches, columns: int, most: int = 2_000_000):
    """The rows of the batches in slices of about ``most`` bytes of text (the last column)."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def parities(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A bit string for each set, of a power of two of at least four bits for each n-gram: whether an odd number of them
    falls on each bit. As many bits of two sets differ as n-grams at most."""
    bits = np.left_shift(1, np.ceil(np.log2(np.maximum(4 * counts, 64))).astype(np.int64))
    at = np.cumsum(bits) - bits
    own = np.repeat(np.arange(len(counts)), counts)
    place = at[own] + (mixed(hashes + _K[2]) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(place, minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8)).tobytes()
    return [raw[x // 8 : (x + n) // 8] for x, n in zip(at.tolist(), bits.tolist())]


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Bit strings (rows of bytes) brought to ``size`` bytes, halves added bit by bit: those of fewer bits for the same sets."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def differing(left: np.ndarray, right: np.ndarray, folds: int = 0) -> np.ndarray:
    """How many bits of bit strings (rows of bytes) differ, at the shorter one's length, or that halved ``folds`` times (64
    bits at least)."""
    size = max(min(left.shape[1], right.shape[1]) >> folds, 8)
    return np.bitwise_count(folded(left, size) ^ folded(right, size)).sum(1, dtype=np.int64)


def near(n: np.ndarray, bits: list[bytes], i: int, others: np.ndarray, percent: int, steps: int = 1) -> np.ndarray:
    """Which of the others may be linked to set i, by sizes and bits. steps 3: which may lead a set that is linked to one
    that i leads; the sets between may have shorter bit strings, so it goes by those."""
    reach, room, folds = 100 / percent, (100 - percent) / (100 + percent), 0
    if steps == 3:
        reach, room, folds = reach**3, room * (1 + 200 / percent), int(np.ceil(np.log2(reach)))
    own = others[(np.maximum(n[others], n[i]) <= reach * np.minimum(n[others], n[i]) + 1e-9)]
    out = []
    sizes = np.array([len(bits[k]) for k in own.tolist()], np.int64)
    for size in np.unique(sizes).tolist():
        some = own[sizes == size]
        rows = np.frombuffer(b"".join(bits[k] for k in some.tolist()), np.uint8).reshape(-1, size)
        mine = np.frombuffer(bits[i], np.uint8)[None]
        out.append(some[differing(mine, rows, folds) <= room * (n[some] + n[i]) + 1e-9])
    return np.concatenate(out) if out else own


def led(n: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """The leader of each set: the first set that may be linked to it of those that no earlier one leads, or itself."""
    lead = np.full(len(n), -1)
    for i in range(len(n)):
        if lead[i] < 0:
            lead[i] = i
            left = np.flatnonzero(lead < 0)
            lead[near(n, bits, i, left, percent)] = i
    return lead


def _sets(size: int, least: int = 2, held: int = 2_000_000):
    """A row for each document with its bit string, and one for each n-gram that ``least`` of the documents hold that the
    task has seen since it last told, every ``held`` n-grams."""

    def common(some):
        gram, times = np.unique(np.concatenate(some), return_counts=True)
        gram, times = gram[times >= least], times[times >= least]
        nothing = [pa.nulls(len(gram), kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*nothing, pa.array(gram.view(np.int64)), pa.array(times)], names)

    names = ["doc_id", "n", "node", "bits", "gram", "times"]

    def run(batches):
        forget()
        some: list[np.ndarray] = []
        for b in _parts(batches, 2):
            hashes, counts = word_sets(b.column(1), size)
            n = len(counts)
            cols = [b.column(0), pa.array(counts), pa.array(node_of(hashes, counts).view(np.int64)), pa.array(parities(hashes, counts), pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names)
            some.append(hashes)
            if sum(map(len, some)) > held:
                yield common(some)
                some = []
        if some:
            yield common(some)

    return run


def levels_of(counted: DataFrame, least: int = 8, most: int = 500_000) -> np.ndarray:
    """The table of frequent n-grams of counted(gram, times), one byte for each slot: the ``most`` commonest have a level."""
    every = counted.groupBy("gram").agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    top = every.orderBy(F.desc("times"), "gram").limit(most).toPandas()
    level = np.zeros(1 << _SLOTS, np.uint8)
    np.maximum.at(level, (top["gram"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - _SLOTS)).astype(np.int64), np.minimum(np.log2(np.maximum(top["times"].to_numpy(np.int64), 1)), 60).astype(np.uint8))
    return level


#: Kinds of rows about an n-gram: a pair of sets, to be looked at; a pair to be chained; a set of a crowd; a leader in one.
OPEN, SURE, CROWDED, LEADER = range(4)


def _keyed(size: int, percent: int, sent, crowd: int):
    """The n-grams that lead in a set, with its node: key, a. Of one that leads in more than ``crowd`` sets of a batch
    only leaders go on, and the pairs of the others with them: a, b.

    A set of so few n-grams that one linked to it need not share ``SHARED`` has each of them under so many keys, those
    beyond the first for such sets alone."""

    def run(batches):
        forget()
        for b in _parts(batches, 1):
            hashes, counts = word_sets(b.column(0), size)
            keys, first = leading_grams(hashes, counts, percent, sent.value, SHARED)
            nodes = node_of(hashes, counts).view(np.int64)
            nodes, row = np.unique(nodes, return_index=True)  # equal sets are one
            held = np.zeros(len(counts), bool)
            held[row] = True
            key, own = keys.view(np.int64)[np.repeat(held, first)], np.repeat(np.searchsorted(nodes, node_of(hashes, counts).view(np.int64)[held]), first[held])
            few = ((counts[row] * percent + 99) // 100 < SHARED)[own]
            more = [mixed(key[few].view(np.uint64) + _K[k % 4] + np.uint64(k)).view(np.int64) for k in range(1, SHARED)]
            key, own = np.concatenate([key, *more]), np.concatenate([own, *[own[few]] * len(more)])
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(key)))
            kind = np.full(len(key), OPEN)
            pairs = np.zeros((0, 2), np.int64)
            if (times > crowd).any():
                n, bits = counts[row], [None] * len(nodes)
                every = parities(hashes, counts)
                bits = [every[k] for k in row.tolist()]
                for at, m in zip(starts[times > crowd].tolist(), times[times > crowd].tolist()):
                    some = own[at : at + m]
                    lead = led(n[some], [bits[k] for k in some.tolist()], percent)
                    kind[at : at + m] = np.where(lead == np.arange(m), LEADER, -1)
                    pairs = np.unique(np.concatenate([pairs, np.stack([nodes[some[lead]], nodes[some]], 1)[lead != np.arange(m)]]), axis=0)
            send, m = kind >= 0, len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(key[send]), pa.array(nodes[own[send]]), pa.nulls(int(send.sum()), pa.int64()), pa.array(kind[send].astype(np.int32))], ["key", "a", "b", "kind"])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.full(m, SURE, np.int32))], ["key", "a", "b", "kind"])

    return run


def _paired(crowd: int):
    """Rows ordered by key, leaders first: the pairs of the nodes of a key (a, b), and of how many keys. Of more than
    ``crowd`` nodes, or where a batch had more, each with the key (a, b: the key)."""

    def told(a, b, kind, times=1):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(np.broadcast_to(np.asarray(c, np.int32), len(a))) for c in (kind, times)]], ["a", "b", "kind", "times"])

    def solved(key, node, kind, full):
        """full: a key that is known to be crowded."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(starts, len(key)))
        crowded = (times > crowd) | (kind[starts] == LEADER) | (key[starts] == full if full is not None else False)
        many = np.repeat(crowded, times)
        yield told(node[many], key[many], np.where(kind[many] == LEADER, LEADER, CROWDED))
        for size in np.unique(times[~crowded & (times > 1)]).tolist():
            rows = node[starts[~crowded & (times == size)][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            step = max(1, 500_000 // len(i))
            for at in range(0, len(rows), step):
                pairs = np.stack([rows[at : at + step, i].ravel(), rows[at : at + step, j].ravel()], 1)
                pairs, n = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0, return_counts=True)
                yield told(pairs[:, 0], pairs[:, 1], OPEN, n)

    def run(batches):
        key, node, kind, full = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for b in batches:
            ready = b.column(3).to_numpy() == SURE
            some = b.filter(pa.array(ready))
            if some.num_rows:
                yield told(some.column(1).to_numpy(), some.column(2).to_numpy(), SURE)
            more = [b.column(k).to_numpy()[~ready] for k in (0, 1, 3)] if not ready.all() else [key[:0]] * 3
            key, node, kind = (np.concatenate(x) for x in zip((key, node, kind), more))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                yield from solved(key[:last], node[:last], kind[:last], full)
                key, node, kind, full = key[last:], node[last:], kind[last:], full if full == key[-1] else None
            if len(key) > crowd or full is not None:  # known to be crowded
                full = int(key[0])
                yield from solved(key, node, kind, full)
                key, node, kind = key[:0], node[:0], kind[:0]
        if len(key):
            yield from solved(key, node, kind, full)

    return run


def _leading_sets(percent: int):
    """Of a part of a crowd (key, a, n, bits): the pairs of sets with their leaders, and the leaders (b: the key)."""

    def run(t: pa.Table) -> pa.Table:
        node, n, bits = t.column("a").to_numpy(), t.column("n").to_numpy(), t.column("bits").to_pylist()
        lead = led(n, bits, percent)
        own = lead == np.arange(len(lead))
        key = np.full(int(own.sum()), t.column("key")[0].as_py(), np.int64)
        kind = np.repeat(np.array([SURE, LEADER], np.int32), [int((~own).sum()), int(own.sum())])
        return pa.table({"a": np.concatenate([node[lead[~own]], node[own]]), "b": np.concatenate([node[~own], key]), "kind": kind})

    return run


def _leaders_chained(percent: int):
    """A spanning forest of the pairs of leaders of a crowd (a, n, bits) that may lead linked sets."""

    def run(t: pa.Table) -> pa.Table:
        node, n, bits = t.column("a").to_numpy(), t.column("n").to_numpy(), t.column("bits").to_pylist()
        left, todo, a, b = np.arange(len(n)), [], [node[:0]], [node[:0]]
        while todo or len(left):
            if not todo:
                todo, left = [int(left[0])], left[1:]
            i = todo.pop()
            found = near(n, bits, i, left, percent, 3)
            a.append(np.full(len(found), node[i]))
            b.append(node[found])
            left = np.setdiff1d(left, found, assume_unique=True)
            todo += found.tolist()
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _possible(percent: int):
    """The pairs whose sizes and bit strings let them be linked."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            left, right = b.column(3).to_pylist(), b.column(5).to_pylist()
            lengths = np.array([(len(x), len(y)) for x, y in zip(left, right)])
            good = np.maximum(n, m) * percent <= 100 * np.minimum(n, m)
            for x, y in np.unique(lengths[good], axis=0).tolist():
                own = np.flatnonzero(good & (lengths[:, 0] == x) & (lengths[:, 1] == y))
                one = np.frombuffer(b"".join(left[k] for k in own), np.uint8).reshape(-1, x)
                two = np.frombuffer(b"".join(right[k] for k in own), np.uint8).reshape(-1, y)
                good[own] = differing(one, two) * (100 + percent) <= (n[own] + m[own]) * (100 - percent)
            kept = b.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], dense_from: int = 24, columns: int = 512) -> np.ndarray:
    """Sizes of the intersections of sorted sets: the product of their incidence matrices."""
    n, m = len(left), len(right)
    sizes = [len(x) for x in (*left, *right)]
    _, col, held = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n + m), sizes)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((n, m), np.float32)
    few = held[col] < dense_from
    r, c = row[few], col[few]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(r)))
    for size in np.unique(lengths[lengths > 1]).tolist():  # columns of equally many rows at once
        own, (i, j) = starts[lengths == size], np.triu_indices(size, 1)
        step = max(1, 500_000 // len(i))
        for at in range(0, len(own), step):
            block = r[own[at : at + step][:, None] + np.arange(size)]  # the rows of a column rise, so left ones come first
            x, y = block[:, i].ravel(), block[:, j].ravel()
            ok = (x < n) & (y >= n)
            cell, times = np.unique(x[ok] * m + y[ok] - n, return_counts=True)
            out.reshape(-1)[cell] += times
    col, row = col[~few], row[~few]
    names, col = np.unique(col, return_inverse=True)
    for at in range(0, len(names), columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        some = np.zeros((n + m, columns), np.float32)
        some[row[lo:hi], col[lo:hi] - at] = 1
        out += some[:n] @ some[n:].T
    return out


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    common = common.astype(np.int64)
    return (100 * common >= percent * (n[:, None] + m[None, :] - common)) & (common > 0)


def roots(links: np.ndarray) -> np.ndarray:
    """The least row of each row's component, by a symmetric matrix of links."""
    root = np.full(len(links), -1)
    for k in range(len(links)):
        if root[k] < 0:
            root[k], todo = k, [k]
            while todo:
                near = np.flatnonzero(links[todo].any(0) & (root < 0))
                root[near] = k
                todo = near.tolist()
    return root


def _group_sets(t: pa.Table, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes and sets of a table with node, text; each node once."""
    hashes, counts = word_sets(t.column("text").combine_chunks(), size)
    sets, found = np.split(hashes, np.cumsum(counts)[:-1]), node_of(hashes, counts).view(np.int64)
    node = t.column("node").to_numpy()
    first = {int(x): k for k, x in reversed(list(enumerate(node))) if found[k] == x}  # a repeated doc_id may bring another text
    return np.array(list(first)), [sets[k] for k in first.values()]


def _solved(size: int, percent: int):
    """Links of a small family, as a tree for each component."""

    def run(t: pa.Table) -> pa.Table:
        node, sets = _group_sets(t, size)
        root = np.arange(len(node))
        if len(node) > 1:
            n = np.array([len(s) for s in sets])
            root = roots(linked(overlaps(sets, sets), n, n, percent))
        keep = root != np.arange(len(node))
        return pa.table({"a": pa.array(node[root[keep]].astype(np.int64)), "b": pa.array(node[keep].astype(np.int64))})

    return run


def _leading(size: int, percent: int, most: int):
    """Of some rows of a large family, a few that most of them are linked to."""

    def run(t: pa.Table) -> pa.Table:
        node, sets = _group_sets(t, size)
        n = np.array([len(s) for s in sets])
        links = linked(overlaps(sets, sets), n, n, percent)
        left, chosen = np.ones(len(node), bool), []
        while left.any() and len(chosen) < most:
            best = int((links & left).sum(1).argmax())
            chosen.append(best)
            left &= ~links[best]
            left[best] = False
        return pa.table({"family": pa.array([t.column("family")[0].as_py()] * len(chosen), pa.int64()), "leader": pa.array(node[chosen].astype(np.int64)), "held": pa.array([sets[k].tobytes() for k in chosen], pa.binary())})

    return run


def _to_leaders(size: int, percent: int):
    """Each row of a large family with all leaders that it is linked to, in ascending order."""

    def run(batches):
        for b in batches:
            hashes, counts = word_sets(b.column("text"), size)
            sets, found = np.split(hashes, np.cumsum(counts)[:-1]), node_of(hashes, counts).view(np.int64)
            node, out = b.column("node").to_numpy(), []
            for k, leaders in enumerate(b.column("leaders").to_pylist()):
                if found[k] != node[k]:
                    continue
                near = []
                for x in leaders:
                    other = np.frombuffer(x["held"], np.uint64)
                    if x["leader"] == node[k] or linked(np.array([[len(np.intersect1d(sets[k], other, assume_unique=True))]]), np.array([len(sets[k])]), np.array([len(other)]), percent)[0, 0]:
                        near.append(x["leader"])
                out.append((b.column("family")[k].as_py(), int(node[k]), sorted(near), sets[k].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["family", "node", "leaders", "held"])

    return run


def _largest(t: pa.Table) -> pa.Table:
    """Of a family's sets of leaders that a row is linked to, with the number of rows: the leaders of the component with
    the most rows."""
    groups: list[tuple[set, int]] = []
    for some, rows in zip(t.column("leaders").to_pylist(), t.column("rows").to_pylist()):
        own = set(some)
        for g in [g for g in groups if g[0] & own]:
            groups.remove(g)
            own, rows = own | g[0], rows + g[1]
        groups.append((own, rows))
    best = max(groups, key=lambda g: (g[1], -min(g[0])))[0]
    return pa.table({"family": pa.array([t.column("family")[0].as_py()], pa.int64()), "main": pa.array([sorted(best)], pa.list_(pa.int64()))})


def _block_links(percent: int):
    """A spanning forest of the links between the two sides of a block."""

    def run(t: pa.Table) -> pa.Table:
        side, node = t.column("side").to_numpy(), t.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("held").to_pylist()]
        l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [], []
        if len(l) and len(r):
            ls, rs = [sets[k] for k in l], [sets[k] for k in r]
            links = linked(overlaps(ls, rs), np.array([len(s) for s in ls]), np.array([len(s) for s in rs]), percent)
            every = np.zeros((len(l) + len(r),) * 2, bool)
            every[: len(l), len(l) :] = links
            root, nodes = roots(every | every.T), np.concatenate([node[l], node[r]])
            keep = root != np.arange(len(root))
            a, b = nodes[root[keep]], nodes[keep]
        return pa.table({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64))})

    return run


def classed(docs: DataFrame, size: int = 3, percent: int = 90, family_docs: int = 1500, family_grams: int = 3_000_000, leaders: int = 8, crowd: int = 32, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id of docs(doc_id, text): two documents are linked when the Jaccard similarity of
    their sets of word n-grams is percent / 100 or more.

    component_id: the least doc_id that links lead to, its own included. A text of fewer than ``size`` words has one
    n-gram; one without words, or null, none and no links. Rows of equal doc_id are rows of their own; if their texts
    differ, they aren't linked by the id alone. A row without doc_id takes no part: its component_id is null.
    family_docs, family_grams: beyond them a family is dealt out to many tasks; crowd: beyond so many sets, an n-gram
    that leads in them is looked at by leaders instead of pairs. None of them changes the result."""
    spark = docs.sparkSession
    own = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = stored(own.mapInArrow(_sets(size), "doc_id bigint, n bigint, node bigint, bits binary, gram bigint, times bigint"))
    rows = found.where("n is not null").select("doc_id", "n", "node")
    known = found.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("bits").alias("bits"))
    known = stored(known)
    nodes = known.select("node", "first", "n")
    sent = spark.sparkContext.broadcast(levels_of(found.where("gram is not null").select("gram", "times")))  # a byte a slot
    keyed = own.where("doc_id is not null").select("text").mapInArrow(_keyed(size, percent, sent, crowd), "key bigint, a bigint, b bigint, kind int")
    paired = keyed.repartition("key").sortWithinPartitions("key", F.desc("kind"), "a").mapInArrow(_paired(crowd), "a bigint, b bigint, kind int, times int")
    counted = paired.groupBy("a", "b", "kind").agg(F.sum("times").alias("times"))
    pairs = stored(counted.where((F.col("kind") != OPEN) | (F.col("times") >= SHARED)).drop("times"))
    sent.destroy()
    sides = [known.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab"]
    open_pairs = pairs.where(F.col("kind") == OPEN).select("a", "b").join(small_hint(sides[0], broadcast_bytes), "a").join(small_hint(sides[1], broadcast_bytes), "b")
    fitting = open_pairs.where(F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100)
    for c in "ab":
        fitting = fitting.join(known.select(F.col("node").alias(c), F.col("bits").alias(f"bits_{c}")), c)
    chained = fitting.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(_possible(percent), "a bigint, b bigint").unionByName(pairs.where(F.col("kind") == SURE).select("a", "b"))
    crowds = pairs.where(F.col("kind") >= CROWDED).select("a", F.col("b").alias("key"), "kind")
    if not crowds.isEmpty():
        # a crowd is dealt out in parts of about 1000 sets; each part gives its leaders
        parts = crowds.where(F.col("kind") == CROWDED).groupBy("key").agg((F.floor(F.count("*") / 1000) + 1).alias("parts"))
        apart = crowds.where(F.col("kind") == CROWDED).join(small_hint(parts, broadcast_bytes), "key").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
        bits = known.select(F.col("node").alias("a"), "n", "bits")
        led_sets = stored(apart.join(bits, "a").select("key", "part", "a", "n", "bits").groupBy("key", "part").applyInArrow(_leading_sets(percent), "a bigint, b bigint, kind int"))
        leading = led_sets.where(F.col("kind") == LEADER).select("a", F.col("b").alias("key")).unionByName(crowds.where(F.col("kind") == LEADER).select("a", "key")).distinct()
        across = leading.join(bits, "a").select("key", "a", "n", "bits").groupBy("key").applyInArrow(_leaders_chained(percent), "a bigint, b bigint")
        chained = chained.unionByName(led_sets.where(F.col("kind") == SURE).select("a", "b")).unionByName(across)
    families = components(chained)
    members = stored(families.join(nodes, "node").select("node", F.col("root").alias("family"), F.col("first").alias("doc_id"), "n"))
    sizes = stored(members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n").alias("grams")))
    large = (F.col("docs") > family_docs) | (F.col("grams") > family_grams)
    members = members.join(small_hint(sizes.select("family", "docs", large.alias("large")), broadcast_bytes), "family")
    texts = own.join(small_hint(members.select("node", "family", "docs", "large", "doc_id"), broadcast_bytes), "doc_id").select("node", "family", "docs", "large", "text")
    small = texts.where("not large").groupBy("family").applyInArrow(_solved(size, percent), "a bigint, b bigint")
    edges = small
    if not sizes.where(large).isEmpty():
        some = texts.where("large").where(F.pmod(F.xxhash64("node"), F.col("docs")) < 64)
        led = some.groupBy("family").applyInArrow(_leading(size, percent, leaders), "family bigint, leader bigint, held binary")
        led = stored(led.groupBy("family").agg(F.collect_list(F.struct("leader", "held")).alias("leaders")))  # ``leaders`` rows a family
        near = texts.where("large").join(led, "family", "left").withColumn("leaders", F.coalesce("leaders", F.array().cast(led.schema["leaders"].dataType)))
        near = stored(near.select("family", "node", "leaders", "text").mapInArrow(_to_leaders(size, percent), "family bigint, node bigint, leaders array<bigint>, held binary"))
        patterns = near.where("size(leaders) > 0").groupBy("family", "leaders").agg(F.count("*").alias("rows"))  # 2 ** ``leaders`` rows a family at most
        main = stored(patterns.groupBy("family").applyInArrow(_largest, "family bigint, main array<bigint>"))
        near = near.join(small_hint(main, broadcast_bytes), "family", "left").withColumn("rest", ~F.coalesce(F.arrays_overlap("leaders", "main"), F.lit(False)))
        counts = near.groupBy("family").agg(F.count("*").alias("all"), F.count_if("rest").alias("rest")).where("rest > 0")
        cuts = counts.select("family", F.ceil(F.col("rest") / 512).cast("int").alias("left_cuts"), F.ceil(F.col("all") / 2048).cast("int").alias("right_cuts"))
        both = near.drop("main").join(small_hint(cuts, broadcast_bytes), "family")
        cut = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        left = both.where("rest").select("family", cut("left_cuts").alias("l"), F.explode(upto("right_cuts")).alias("r"), F.lit(0).alias("side"), "node", "held")
        right = both.select("family", F.explode(upto("left_cuts")).alias("l"), cut("right_cuts").alias("r"), F.lit(1).alias("side"), "node", "held")
        rest = left.unionByName(right).groupBy("family", "l", "r").applyInArrow(_block_links(percent), "a bigint, b bigint")
        edges = edges.unionByName(near.select(F.explode("leaders").alias("a"), F.col("node").alias("b"))).unionByName(rest)
    linked_nodes = components(edges)
    labels = linked_nodes.join(nodes, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    of = linked_nodes.join(labels, "root").select("node", "component_id")
    of = nodes.join(of, "node", "left").select("node", F.coalesce("component_id", "first").alias("of_node"))
    out = rows.select("doc_id", "n", "node").join(of, "node", "left")
    out = stored(out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("of_node")).otherwise(F.col("doc_id")).alias("component_id")))
    discard(found, known, pairs, families, sizes, linked_nodes)
    return out
