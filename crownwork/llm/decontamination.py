"""Benchmark decontamination by the q-gram lemma.

A document is contaminated by an item where some ``window`` characters of the item can be made into a part of the
document by ``budget`` edits at most (inserted, deleted or other characters). Both are compared in normal form: lower
case, white space as single spaces. An edit spoils q of the window - q + 1 q-grams, so the two share
window - q + 1 - q * budget of them, and those lie on diagonals (item place - document place) that differ by
``budget`` at most. Steps, for each document:

1. places whose q-gram some item has are counted over spans that a window can cover; few spans have enough of them;
2. there, the q-grams' pairs of places are counted by window of the item, in bands of 2 (budget + 1) diagonals that
   overlap by half, so that one of them holds all diagonals of an alignment;
3. windows with enough are verified by alignment within the band, widened by the budget.

An item of n < ``window`` characters is one window of its own length, with budget * n // window edits (fewer where the
lemma would ask for no q-gram). Where that allows none (under 20 characters by default), it is found unchanged and as
whole words: no letter or digit of the text may stand beside a letter or digit at its edge, scripts that write without
spaces (from U+0E00 on) aside. The benchmark goes to the tasks in parts of about
``part_chars`` characters, each of which is held against all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches
from .ngram_join import mixed

Q = 8
_BITS = 22
PIECE = 20_000
_P = 0x9E3779B97F4A7C15


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of the Q-grams that start at each place."""
    h, p, n = codes.astype(np.uint64) + np.uint64(1), _P, 1
    while n < Q:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % (1 << 64), 2 * n
    return h


def aligned(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edits between each pattern (rows of w) and a part of its text (rows of w + band - 1) along the band; and
    the place of that part's end."""
    n, w = patterns.shape
    band = texts.shape[1] - w + 1
    steps = np.arange(band)
    cost = np.zeros((n, band), np.int32)
    for i in range(w):
        now = cost + (texts[:, i : i + band] != patterns[:, i, None])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - steps, axis=1) + steps
    return cost.min(1), cost.argmin(1) + w


def _inside_word(text: str, at: int) -> bool:
    """Whether a word goes on across the place."""
    return 0 < at < len(text) and all(c.isalnum() and c < "\u0e00" for c in text[at - 1 : at + 1])


class Index:
    """Items of at least ``window`` characters, by their q-grams. whole: each item is one window, and ``window`` is the
    longest's length."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int, whole: bool = False):
        self.window, self.budget, self.whole = window, budget, whole
        texts = [(i, normal(t)) for i, t in items]
        self.least = min([len(t) for _, t in texts] if whole else [window]) - Q + 1 - Q * budget
        if self.least < 1:
            raise ValueError("the budget is too large for the window")
        long = [(i, t) for i, t in texts if whole or len(t) >= window]
        self.ids = [i for i, _ in long]
        sizes = np.array([len(t) for _, t in long], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # one character of no text between items
        self.size = sizes
        self.codes = np.concatenate([np.append(_codes(t), np.uint32(0x7FFFFFFF)) for _, t in long]) if long else np.zeros(0, np.uint32)
        if long:
            h = grams(self.codes)
            inside = np.concatenate([np.arange(a, a + s - Q + 1) for a, s in zip(self.first, sizes)])
            order = inside[np.argsort(h[inside], kind="stable")]
            self.names, self.starts = np.unique(h[order], return_index=True)
            self.starts, self.places = np.append(self.starts, len(order)), order
            self.table = np.zeros(1 << _BITS, bool)
            self.table[(mixed(self.names) >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def found(self, texts: list[str]) -> list[tuple]:
        """(text's number, item_id, doc_start, doc_end, item_start, item_end, edits) for texts in normal form."""
        out = []
        if not len(self.codes):
            return out
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        codes = _codes("\n".join(texts) + "\n")
        if len(codes) < Q:
            return out
        h = grams(codes)
        hit = self.table[(mixed(h) >> np.uint64(64 - _BITS)).view(np.int64)]
        span = self.window + self.budget - Q + 1
        count = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        ends = np.minimum(np.arange(len(hit)) + span, len(hit))
        full = np.flatnonzero((count[ends] - count[:-1] >= self.least) & hit)
        if not len(full):
            return out
        cut = np.flatnonzero(np.diff(full) > span) + 1  # spans that touch are looked at together
        regions: dict[tuple[int, int], list] = {}
        for some in np.split(full, cut):
            for lo in range(int(some[0]), int(some[-1]) + 1, PIECE):  # pieces of very long spans share a span
                hi = min(lo + PIECE + span, int(some[-1]) + span, len(hit))
                at = np.arange(lo, hi)[hit[lo:hi]]
                for k in range(np.searchsorted(bounds, lo, side="right") - 1, np.searchsorted(bounds, hi - 1, side="right")):
                    own = at[(at >= bounds[k]) & (at + Q <= bounds[k + 1] - 1)]
                    if len(own) >= self.least:
                        for item, *r in self._windows(codes, h, own, int(bounds[k]), int(bounds[k + 1]) - 1):
                            regions.setdefault((k, item), []).append(r)
        for (k, item), rows in regions.items():
            rows.sort()
            one = rows[0]
            for a, b, c, d, e in rows[1:]:
                if a <= one[1]:
                    one = [one[0], max(one[1], b), min(one[2], c), max(one[3], d), min(one[4], e)]
                else:
                    out.append((k, self.ids[item], *one))
                    one = [a, b, c, d, e]
            out.append((k, self.ids[item], *one))
        return out

    def _windows(self, codes, h, at, doc_lo, doc_hi):
        """(item's number, doc start, end, item start, end, edits) of the windows that q-grams at the places ``at`` verify."""
        where = np.minimum(np.searchsorted(self.names, h[at]), len(self.names) - 1)
        ok = self.names[where] == h[at]
        at, where = at[ok], where[ok]
        times = self.starts[where + 1] - self.starts[where]
        doc = np.repeat(at, times)
        item = self.places[np.repeat(self.starts[where], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        if not len(item):
            return []
        step, of = self.budget + 1, np.searchsorted(self.first, item, side="right") - 1
        band = (item - doc) // step
        of, item, doc, band = (np.concatenate(x) for x in ((of, of), (item, item), (doc, doc), (band, band - 1)))
        order = np.lexsort((item, band, of))
        of, item, band = of[order], item[order], band[order]
        new = np.concatenate([[True], (np.diff(of) != 0) | (np.diff(band) != 0)])
        starts = np.append(np.flatnonzero(new), len(of))
        out = []
        for x, y in zip(starts, starts[1:]):
            if y - x >= self.least:
                k = int(of[x])
                out += [(k, *r) for r in self._verified(codes, np.unique(item[x:y]), k, int(band[x]) * step, doc_lo, doc_hi)]
        return out

    def _verified(self, codes, places, k, low, doc_lo, doc_hi):
        """Windows of item k that the band of diagonals from ``low`` on aligns: (doc start, end, item start, end, edits)."""
        e, first = self.budget, int(self.first[k])
        w = int(self.size[k]) if self.whole else self.window
        y = np.arange(first, first + int(self.size[k]) - w + 1)
        have = np.searchsorted(places, y + w - Q, side="right") - np.searchsorted(places, y)
        y = y[have >= w - Q + 1 - Q * e]
        if not len(y):
            return []
        # the text that the band reaches from each window; beyond the document no character equals any other
        start = y - (low + 2 * e + 1) - e
        places_ = start[:, None] + np.arange(w + 4 * e + 1)
        texts = np.where((places_ >= doc_lo) & (places_ < doc_hi), codes[np.clip(places_, 0, len(codes) - 1)], np.uint32(0xFFFFFFFF))
        edits, end = aligned(self.codes[y[:, None] + np.arange(w)], texts)
        good = edits <= e
        return [
            (max(int(s) + int(x) - w - doc_lo, 0), min(int(s) + int(x), doc_hi) - doc_lo, int(a) - first, int(a) - first + w, int(n))
            for s, x, a, n in zip(start[good], end[good], y[good], edits[good])
        ]


class Benchmark:
    """Items of any length: those of ``window`` characters and more, shorter ones with fewer edits, and tiny ones."""

    def __init__(self, items: list[tuple[int, str]], window: int, budget: int):
        texts = [(i, normal(t)) for i, t in items]
        by_edits: dict[int, list] = {}
        for i, t in texts:
            if 0 < len(t) < window:
                by_edits.setdefault(max(min(budget * len(t) // window, (len(t) - Q) // Q), 0), []).append((i, t))
        tiny = by_edits.pop(0, [])
        self.indexes = [Index(texts, window, budget)] + [Index(some, max(len(t) for _, t in some), e, whole=True) for e, some in sorted(by_edits.items())]
        self.automaton = None
        if tiny:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            by_text: dict[str, list] = {}
            for i, t in tiny:
                by_text.setdefault(t, []).append(i)
            for t, ids in by_text.items():
                self.automaton.add_word(t, (len(t), ids))
            self.automaton.make_automaton()

    def found(self, texts: list[str]) -> list[tuple]:
        """As Index.found, for all items."""
        out = [r for index in self.indexes for r in index.found(texts)]
        if self.automaton is not None:
            for k, t in enumerate(texts):
                for end, (size, ids) in self.automaton.iter(t):
                    if not _inside_word(t, end + 1 - size) and not _inside_word(t, end + 1):
                        out += [(k, i, end + 1 - size, end + 1, 0, size, 0) for i in ids]
        return out


REGIONS = "doc_id bigint, item_id bigint, doc_start bigint, doc_end bigint, item_start bigint, item_end bigint, edits int"


def _scan(items, window: int, budget: int, most: int = 2_000_000):
    def run(batches):
        forget()
        index = Benchmark(items, window, budget)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [normal(t) for t in b.column(1).to_pylist()]
            rows, at, chars = [], 0, 0
            for k, t in enumerate(texts):
                chars += len(t)
                if chars >= most or k == len(texts) - 1:
                    rows += [(ids[at + r[0]], *r[1:]) for r in index.found(texts[at : k + 1])]
                    at, chars = k + 1, 0
            kinds = (*[pa.int64()] * 6, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], [c.split()[0] for c in REGIONS.split(", ")])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 80, budget: int = 4, part_chars: int = 4_000_000) -> DataFrame:
    """Regions of docs(doc_id, text) that hold parts of items of benchmark(item_id, text), by places in normal form.

    doc_start and doc_end are right to within the budget. Windows of an item whose parts of the document touch are one
    region; edits: the least of its windows. Null and empty texts hold nothing, and null or empty items are nowhere.
    Rows that repeat are reported for each; with an empty benchmark there are no regions."""
    own = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = chars // part_chars + 1
    out = None
    for k in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        found = own.mapInArrow(_scan([(r["item_id"], r["text"]) for r in some.toLocalIterator()], window, budget), REGIONS)  # about part_chars
        out = found if out is None else out.unionByName(found)
    return out
