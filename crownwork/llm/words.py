"""Words of texts, and words as numbers: tables of rows for words, filled as words turn up, for scoring many texts with
numpy."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np

_LATIN = re.compile("[^\\W\\d_\u00b2\u00b3\u00b9\u00bc\u00bd\u00be]+")  # up to U+00FF there are no marks

_HIGH = re.compile("[\U00010000-\U0010ffff]")


@cache
def _any(end: int) -> re.Pattern:
    """A letter, and letters and marks after it, of code points below ``end``."""
    runs: dict[str, list] = {"L": [], "M": []}
    last = ""
    for c in range(end):
        kind = unicodedata.category(chr(c))[0]
        if kind in runs:
            if kind == last:
                runs[kind][-1][1] = c
            else:
                runs[kind].append([c, c])
        last = kind
    letters, marks = ("".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in runs[k]) for k in "LM")
    return re.compile(f"[{letters}][{letters}{marks}]*")


def words_of(text: str | None) -> list[str]:
    """The words of a text: letters, each with the letters and combining marks that follow it."""
    if not text:
        return []
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _any(sys.maxunicode + 1 if _HIGH.search(text) else 0x10000).findall(text)
    return _LATIN.findall(text)


class _Memo(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordRows:
    """A row of ``width`` numbers for each word, by ``rows_of(words)``; once it holds ``most`` words, those that only one
    run of texts had go."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, most: int = 300_000):
        self.rows_of, self.width, self.most = rows_of, width, most
        self._reset()

    def _reset(self):
        self.memo, self.table, self.n = _Memo(), np.zeros((1 << 12, self.width), np.float32), 0
        self.runs = np.zeros(1 << 12, np.int32)

    def _trim(self):
        """Keeps the words that several runs of texts had, half of ``most`` at the utmost."""
        often, least = self.runs[: self.n], 2
        while (often >= least).sum() > self.most // 2:
            least *= 2
        stay, names, table = np.flatnonzero(often >= least), list(self.memo), self.table
        self._reset()
        for k in stay.tolist():
            self.memo[names[k]] = len(self.memo)
        self.table, self.runs, self.n = table[stay], np.zeros(len(stay), np.int32), len(stay)

    def sums(self, texts: list[str | None], most_words: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of the texts, in order: the number of words of each text, and the sum of its words' rows."""
        at, rows, total = 0, [], 0
        for k, t in enumerate(texts):
            words = words_of(t.lower()) if t else ()
            rows.append(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)))
            total += len(words)
            if total >= most_words or k == len(texts) - 1:
                yield self._sum(rows)
                at, rows, total = k + 1, [], 0

    def _sum(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if new := self.memo.new:
            self.memo.new = []
            if self.n + len(new) > len(self.table):
                size = max(2 * len(self.table), self.n + len(new))
                self.table, self.runs = np.resize(self.table, (size, self.width)), np.append(self.runs, np.zeros(size - len(self.runs), np.int32))
            self.table[self.n : self.n + len(new)] = self.rows_of(new)
            self.n += len(new)
        counts = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows)
        self.runs[flat] += 1  # once for each word, as repeated places are set to the same
        out = np.zeros((len(rows), self.width))
        full = np.flatnonzero(counts)
        if len(full):
            firsts = (np.cumsum(counts) - counts)[full]
            for j in range(self.width):  # a column at a time keeps the gathered copy small
                out[full, j] = np.add.reduceat(self.table[flat, j].astype(np.float64), firsts)
        if len(self.memo) > self.most:
            self._trim()
        return counts, out
