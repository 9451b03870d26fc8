"""Substring deduplication by compressed FM-indexes.

Segments of recurring windows are dealt to shards by content (see ``_windows``). A shard
indexes its segments' words: Burrows-Wheeler transform of contexts up to ``k`` words, stored
as a wavelet matrix of packed bits with a rank directory. Documents' segments stream through
it from right to left; backward search keeps, for each of them at once, the interval of rows
that match the longest stretch of at most ``k`` words (matching statistics). A stretch of k words is a
window; the smallest document among its rows tells whether it also starts earlier.

Defined results: a null text has no words; a null ``doc_id`` is the last document; of rows
that share a ``doc_id``, or have none, none is earlier than the other, and each is judged by its own
text; texts shorter than a window are kept whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import U, documents, word_hashes, words
from ._windows import Scheme, buffers, covered, flagged_runs, marked_windows, with_marks, with_rows
from .scratch import tidy


class WaveletMatrix:
    """A sequence of small integers as bit planes, with rank in a step a plane."""

    def __init__(self, values: np.ndarray):
        self.n = n = len(values)
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level) & 1
            packed = np.packbits(np.append(bits, np.zeros(-n % 64 + 64, bits.dtype)).astype(bool), bitorder="little").view(U)
            self.words.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]).astype(np.int32))
            self.zeros.append(n - int(bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``at``, plus the constant that :meth:`base` has."""
        for k in range(self.levels):
            block = at >> 6
            below = (U(1) << (at & 63).astype(U)) - U(1)
            ones = self.ones[k][block] + np.bitwise_count(self.words[k][block] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def base(self, symbols: np.ndarray) -> np.ndarray:
        return self.rank(symbols, np.zeros(len(symbols), np.int64))


class FMIndex:
    """An index of sequences of integers (1 and up) for stretches of at most ``k``."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, k: int):
        """``text``: the sequences one after the other; ``bounds``: where each begins, and the end."""
        m = len(bounds) - 1
        sizes = np.diff(bounds)
        # a 0 closes each sequence
        flat = np.zeros(len(text) + m, np.int32)
        flat[np.arange(len(text)) + np.repeat(np.arange(m), sizes)] = text
        self.k, self.n = k, len(flat)
        rank, length = flat, 1
        # rows that share k symbols may stand in any order: intervals hold all of them or none
        self.order = np.argsort(flat)
        while length < k:
            step = min(length, k - length)
            # what follows a sequence's end is not part of it
            pair = np.zeros(self.n, np.int64)
            pair[: max(0, self.n - step)] = rank[step:]
            pair[self._ends(flat, length)] = 0
            pair += rank.astype(np.int64) * (int(rank.max(initial=0)) + 1)
            self.order = np.argsort(pair)
            rank = _ranks(pair, self.order)
            length += step
        self.flat = flat
        before = flat[self.order - 1]  # the first sequence follows the last end
        self.bwt = WaveletMatrix(before)
        self.sigma = int(flat.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=self.sigma))])
        self.shift = self.bwt.base(np.arange(self.sigma))
        common = np.zeros(self.n, np.int8)
        at, a, b = np.arange(1, self.n), self.order[:-1], self.order[1:]
        for i in range(k):
            inside = (a + i < self.n) & (b + i < self.n)
            x, y = flat[np.minimum(a + i, self.n - 1)], flat[np.minimum(b + i, self.n - 1)]
            more = np.flatnonzero((x == y) & (x != 0) & inside)
            if not len(more):
                break
            at, a, b = at[more], a[more], b[more]
            common[at] = i + 1
        self.common = common
        self._bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _ends(flat: np.ndarray, length: int) -> np.ndarray:
        """Whether one of the ``length`` symbols from each place is a closing 0."""
        zero = np.append(0, np.cumsum(flat == 0))
        return zero[np.minimum(np.arange(len(flat)) + length, len(flat))] > zero[:-1]

    def widest(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row, the rows that share its first ``length`` symbols."""
        if length not in self._bounds:
            new = self.common < length
            new[0] = True
            rows = np.arange(self.n)
            starts = np.maximum.accumulate(np.where(new, rows, 0))
            edge = np.append(np.flatnonzero(new)[1:], self.n)
            self._bounds[length] = starts, np.repeat(edge, np.diff(np.append(np.flatnonzero(new), self.n)))
        return self._bounds[length]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that begin with ``symbol`` and go on as rows lo..hi do."""
        move = self.first[symbol] - self.shift[symbol]
        return self.bwt.rank(symbol, lo) + move, self.bwt.rank(symbol, hi) + move

    def matching_statistics(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of streamed sequences: the length of the longest match, up to k, and its rows.

        All sequences move one symbol to the left at a time. A symbol that the index doesn't
        have (``sigma`` or more) matches nothing.
        """
        sizes = np.diff(bounds)
        length, low, high = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.full(len(text), self.n)
        who = np.argsort(-sizes, kind="stable")
        live = np.searchsorted(-sizes[who], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        lo, hi, now = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        for t, n in enumerate(live.tolist()):
            at = bounds[who[:n] + 1] - 1 - t
            symbol = text[at]
            full = now[:n] == self.k
            if full.any():
                starts, ends = self.widest(self.k - 1)
                hi[:n][full], lo[:n][full] = ends[lo[:n][full]], starts[lo[:n][full]]
                now[:n][full] -= 1
            todo = np.arange(n)
            while len(todo):
                known = symbol[todo] < self.sigma
                a, b = self.extend(np.where(known, symbol[todo], 0), lo[todo], hi[todo])
                good = known & (a < b)
                won = todo[good]
                lo[won], hi[won] = a[good], b[good]
                now[won] += 1
                todo = todo[~good]
                # shorten what doesn't go on to the left; without anything left, begin anew
                over = now[todo] == 0
                lo[todo[over]], hi[todo[over]] = 0, self.n
                todo = todo[~over]
                now[todo] -= 1
                for size in np.unique(now[todo]):
                    some = todo[now[todo] == size]
                    if size:
                        starts, ends = self.widest(int(size))
                        hi[some], lo[some] = ends[lo[some]], starts[lo[some]]
                    else:
                        lo[some], hi[some] = 0, self.n
            length[at], low[at], high[at] = now[:n], lo[:n], hi[:n]
        return length, low, high


def _ids(hashes: np.ndarray) -> np.ndarray:
    """1, 2, ... for each distinct word."""
    return _ranks(hashes, np.argsort(hashes)) + 1


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each place's rank among the distinct keys, ``order`` being their sorted order."""
    ordered = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.append(np.zeros(min(1, len(keys)), np.int32), np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32))
    return out


def _compare(k: int):
    def run(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, sizes = [], []
        for data, offsets in buffers(contents):
            starts, ends, bounds = words(data, offsets)
            hashes.append(word_hashes(data, starts, ends))
            sizes.append(np.diff(bounds))
        bounds = np.append(0, np.cumsum(np.concatenate(sizes)))
        text = _ids(np.concatenate(hashes))
        del hashes
        index = FMIndex(text, bounds, k)
        length, low, _ = index.matching_statistics(text, bounds)
        # the smallest document among the rows of each stretch of k
        owner = np.repeat(doc, np.diff(bounds) + 1)[index.order]
        new = index.common < k
        least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
        mine = np.repeat(doc, np.diff(bounds))
        whole = np.flatnonzero(length == k)
        earlier = np.zeros(len(length), bool)
        earlier[whole] = least[low[whole]] < mine[whole]
        return flagged_runs(earlier, bounds)

    return run


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """Runs of windows (doc_id, row, start, n; in words) that also start in a document of smaller id; ``docs`` as from ``with_rows``."""
    return marked_windows(docs, Scheme(window, max(1, window // 3), True, False), _compare(window))


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by blanks) and, if asked for, kept."""
    names = [x.split()[0] for x in OUT.split(", ")] + ["kept"] * texts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in documents([batch]):
                marks = batch.column("marks").slice(at, len(ids)).to_pylist()
                at += len(ids)
                starts, ends, bounds = words(data, offsets)
                raw, rows = data.tobytes(), []
                for doc, a, b, m in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), marks, strict=True):
                    keep = ~covered(m, b - a, window)
                    s, e = starts[a:b][keep].tolist(), ends[a:b][keep].tolist()
                    kept = b" ".join([raw[x:y] for x, y in zip(s, e, strict=True)])
                    rows.append((doc, b - a, b - a - len(s), hashlib.sha256(kept).hexdigest(), *[kept] * texts))
                types = [pa.int64()] * 3 + [pa.string()] * (1 + texts)
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() if isinstance(x, bytes) else x for x in c], t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    docs = with_rows(docs)
    return with_marks(docs, repeated_windows(docs, window)).mapInArrow(tidy(run), OUT + ", kept string" * texts)
