"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE splits a text at fixed places before it merges, so pieces between two such places can be encoded
apart. Texts are cut before spaces, line feeds, commas and full stops; the ids of a piece are kept, since pieces
recur. A cut is used only where the vocabulary's pattern always splits:

* before a space or line feed that follows a character other than white space,
* before a comma or full stop that follows a letter or digit.

Elsewhere the two pieces stay together. Texts that hold an added token of the vocabulary, such as <|endoftext|>, are
encoded whole. ``PieceEncoder.ids`` is tested against plain calls on arbitrary strings.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

_MARK, _CUTS = "\x1f", (" ", ",", ".", "\n")


def encoder(path: str, most: int = 500_000) -> "PieceEncoder":
    """One encoder for each worker process and vocabulary file, with ``most`` pieces kept."""
    return kept(("pieces", path, most), lambda: PieceEncoder(path, most))


class _Memo(dict):
    """Number of a piece; new pieces get the next number and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece):
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class PieceEncoder:
    """ids of texts; once it keeps ``most`` pieces, those that only one batch of texts had go."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # a character of a token stands for a byte
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self.most = most
        self._reset()

    def _reset(self):
        self.memo, self.ids_kept, self.n_ids = _Memo(), np.zeros(1 << 16, np.uint32), 0
        self.start, self.count, self.batches = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.ends, self.begins = np.zeros(1 << 14, np.uint8), np.zeros(1 << 14, np.uint8)
        self.n, self.chars = 0, 0

    def _trim(self):
        """Keeps the pieces that several batches had, half of ``most`` at the utmost."""
        often = self.batches[: self.n]
        least = 2
        while (often >= least).sum() > self.most // 2:
            least *= 2
        stay = np.flatnonzero(often >= least)
        names, old = list(self.memo), {k: getattr(self, k) for k in ("start", "count", "ends", "begins", "batches", "ids_kept")}
        self._reset()
        self._room(len(stay))
        for at in stay.tolist():
            self.memo[names[at]] = len(self.memo)
            self.chars += len(names[at])
        counts = old["count"][stay].astype(np.int64)
        at = np.repeat(old["start"][stay] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self._keep(np.arange(len(stay)), old["ids_kept"][at], counts)
        self.n = len(stay)
        for k in ("ends", "begins"):
            getattr(self, k)[: self.n] = old[k][stay]

    def _room(self, more: int):
        if self.n + more > len(self.start):
            size = max(2 * len(self.start), self.n + more)
            for k in ("start", "count", "ends", "begins", "batches"):
                kept = getattr(self, k)
                grown = np.zeros(size, kept.dtype)
                grown[: len(kept)] = kept
                setattr(self, k, grown)

    def _learn(self):
        """Encodes the pieces that wait."""
        new, memo = self.memo.new, self.memo
        if not new:
            return
        memo.new = []
        self._room(len(new))
        n, joined, rest = self.n, [], []
        for i, p in enumerate(new):  # these may stand on end: each begins where the pattern splits
            (joined if p[:1] in (" ", "\n") and len(p) < 64 and p[-1].isalnum() else rest).append(i)
        self.ends[n : n + len(new)] = self.begins[n : n + len(new)] = 0
        for at in range(0, len(joined), 20_000):
            some = joined[at : at + 20_000]
            pieces = [new[i] for i in some]
            found = self.tokenizer.encode_batch_fast(["".join(pieces[k : k + 200]) for k in range(0, len(pieces), 200)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
            ends, cuts = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(pa.array(pieces, pa.string())).to_numpy())
            before = np.searchsorted(ends, cuts, side="right")
            if (ends[before - 1] == cuts).all():
                self._keep(n + np.array(some), ids, np.diff(before, prepend=0))
            else:  # a vocabulary that changes characters
                rest += some
        if rest:
            some = [[new[i] for i in rest[at : at + 5000]] for at in range(0, len(rest), 5000)]
            parts = [e.ids for x in some for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False)]
            flat = np.array([x for ids in parts for x in ids], np.uint32)
            self._keep(n + np.array(rest), flat, np.array([len(x) for x in parts], np.int64))
            last = [new[i][-1:] for i in rest]
            self.ends[n + np.array(rest)] = [0 if not c or c.isalnum() else 1 if c.isspace() else 2 for c in last]
            self.begins[n + np.array(rest)] = [new[i][:1] in (",", ".") for i in rest]
        self.n, self.chars = n + len(new), self.chars + sum(map(len, new))

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        if self.n_ids + len(ids) > len(self.ids_kept):
            self.ids_kept = np.resize(self.ids_kept, max(2 * len(self.ids_kept), self.n_ids + len(ids)))
        self.ids_kept[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[numbers] = self.n_ids + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.n_ids += len(ids)

    def ids(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, and how many each has. An empty text has none.

        Arrow cuts the texts and numbers the distinct pieces; only those are looked up one by one."""
        if len(self.memo) > self.most or self.chars > 32 * self.most:
            self._trim()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring(texts, _MARK)
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        whole = {int(k): self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        marked = pc.if_else(odd, "", texts) if whole else texts
        for c in _CUTS:
            marked = pc.replace_substring(marked, c, _MARK + c)
        cut = pc.split_pattern(marked, _MARK)
        sizes, pieces = np.diff(cut.offsets.to_numpy()).astype(np.int64), cut.flatten().dictionary_encode()
        number = self.memo.__getitem__
        own = np.array([number(p) for p in pieces.dictionary.to_pylist()], np.int64)
        self._learn()
        self.batches[own] += 1
        flat = own[pieces.indices.to_numpy()]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        end, begin = self.ends[flat], self.begins[flat]
        bad = np.where(begin[1:] == 1, end[:-1] != 0, end[:-1] == 1) & (owner[1:] == owner[:-1])
        if bad.any():
            rows = np.split(flat, np.cumsum(sizes)[:-1])
            for k in np.unique(owner[1:][bad]).tolist():
                rows[k] = self._together(texts[k].as_py())
            self._learn()
            sizes = np.array([len(r) for r in rows], np.int64)
            flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        counts = self.count[flat].astype(np.int64)
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        out = self.ids_kept[np.repeat(self.start[flat] - before, counts) + np.arange(total)]
        lengths = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
        if whole:
            parts = np.split(out, np.cumsum(lengths)[:-1])
            for k, ids in whole.items():
                parts[k], lengths[k] = np.array(ids, np.uint32), len(ids)
            out = np.concatenate(parts)
        return out, lengths

    def _together(self, text: str) -> np.ndarray:
        """Numbers of the pieces of a text in which some cuts may not be used."""
        for c in _CUTS:
            text = text.replace(c, _MARK + c)
        out: list[list[str]] = []
        last = ""
        for p in text.split(_MARK):
            if out and last and (not last.isalnum() if p[:1] in (",", ".") else last.isspace()):
                out[-1].append(p)
            else:
                out.append([p])
            last = p[-1:] or last
        pieces = ["".join(x) for x in out]
        return np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))


def texts_of(column: pa.Array) -> pa.Array:
    """A column of texts, null ones empty."""
    return pc.fill_null(column, "")


def slices(texts: pa.Array, most_bytes: int = 2_000_000):
    """Ranges of the texts of about most_bytes at most, or one text."""
    at, size = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if k > at and size + n > most_bytes:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
