"""Suffix-array deduplication by column-wise construction of a collection's BWT.

Segments of recurring windows are dealt to shards by content (see ``_windows``). A shard
builds the Burrows-Wheeler transform of its segments and the common prefixes of neighbouring
suffixes column by column: each round inserts one symbol of every segment, from right to left.
The rows of a round lie in files, one for each first symbol, that are written and read
sequentially in blocks; a block is dealt out by its transform symbols, and the least common
prefix since a symbol's last row carries over from block to block. ``CollectionBWT.rows`` is the
whole construction. Deduplication uses ``classes``: segments line up at the key they share, so
equal windows are inserted in the same round, rows of earlier rounds need not stay in the
files, and a segment that can no longer reach the threshold is finished.

Neighbouring rows whose common prefixes reach the threshold form classes of equal windows, and all
but the first start of a class (document, then place) are marked.

Defined results: a null text is empty; a null ``doc_id`` is the last document; of rows that
share a ``doc_id`` none is earlier than the other at the same place, and what is marked in one is
marked in all that are long enough; texts shorter than a window are kept whole.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import BYTE, U, documents
from ._windows import Scheme, buffers, covered, flagged_runs, marked_windows, segments, with_marks, with_rows
from .scratch import tidy

#: Rows of a block; bytes of a file that stay in memory before it goes to disk.
BLOCK, IN_MEMORY = 1 << 17, 1 << 18
#: Longest common prefix that is told apart from longer ones.
MOST = 254


def _range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first : last + 1]) for each pair, by a sparse table."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        a, half = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(a[: len(a) - half], a[half:]))
    level = np.log2(last - first + 1).astype(np.int64)
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][first[at]], table[k][last[at] - (1 << int(k)) + 1])
    return out


class Rows:
    """Suffixes in order, a 64-bit word each: sequence, length, common prefix with the row before."""

    def __init__(self) -> None:
        self.file, self.n = tempfile.SpooledTemporaryFile(IN_MEMORY), 0

    def write(self, rows: np.ndarray) -> None:
        self.file.write(rows.tobytes())
        self.n += len(rows)

    def blocks(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while got := self.file.read(8 * BLOCK):
            yield np.frombuffer(got, U)
        self.file.close()


def _blocks(piles: dict[int, Rows]) -> Iterator[np.ndarray]:
    """The rows of all files in order of their symbols, a block at a time."""
    held, n = [], 0
    for key in sorted(piles):
        for x in piles[key].blocks():
            held.append(x)
            n += len(x)
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


class Classes:
    """Neighbouring rows whose common prefixes reach a threshold, taken from blocks in order."""

    def __init__(self, threshold: int):
        self.threshold, self.rows, self.first, self.carry = threshold, [], [], None

    def see(self, x: np.ndarray) -> None:
        if self.carry is not None:
            x = np.append(self.carry, x)
        same = (x & U(0xFF)) >= U(self.threshold)
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[-1] = False
        self.rows.append(x[keep])
        self.first.append(~same[keep])
        self.carry = x[-1:]

    def end(self) -> None:
        """No row of the next round belongs to the last class."""
        if self.carry is not None and int(self.carry[0] & U(0xFF)) >= self.threshold:
            self.rows.append(self.carry)
            self.first.append(np.zeros(1, bool))
        self.carry = None

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, sequence and length of each row."""
        x, first = np.concatenate([np.zeros(0, U), *self.rows]), np.concatenate([np.zeros(0, bool), *self.first])
        return np.cumsum(first), (x >> U(32)).astype(np.int64), ((x >> U(8)) & U(0xFFFF)).astype(np.int64)


class CollectionBWT:
    """Suffixes of a collection of byte strings in order, built column by column."""

    def __init__(self, strings: list[bytes], delay: np.ndarray | None = None):
        """``delay``: the round after which a string begins."""
        self.delay = np.zeros(len(strings), np.int64) if delay is None else delay
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        self.start = np.append(0, np.cumsum(self.sizes))
        if self.sizes.max(initial=0) > 0xFFFF:
            raise ValueError("strings of more than 65,535 bytes")

    def _begin(self) -> tuple[np.ndarray, dict[int, Rows], int]:
        piles = {-1: Rows()}
        piles[-1].write(np.arange(len(self.sizes), dtype=U) << U(32))
        return np.ones(len(self.sizes), bool), piles, int((self.delay + self.sizes).max(initial=0))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, length and common prefix (``MOST`` at most) of each suffix in order."""
        alive, piles, last = self._begin()
        for done in range(1, last + 1):
            piles, _ = self._insert(piles, alive, done, None)
        x = np.concatenate([np.zeros(0, U), *_blocks(piles)])
        return (x >> U(32)).astype(np.int64), ((x >> U(8)) & U(0xFFFF)).astype(np.int64), (x & U(0xFF)).astype(np.int64)

    def classes(self, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, sequence and length of suffixes that share ``threshold`` symbols with another of their round.

        Delays line up the matches that are wanted, so a round's suffixes are compared with each
        other only: those of the rounds before don't stay in the files, and strings go that can't reach the
        threshold any more.
        """
        alive, piles, last = self._begin()
        found = Classes(threshold)
        for done in range(1, last + 2):
            piles, best = self._insert(piles, alive, done, found)
            found.end()
            size = done - self.delay
            alive = (size <= 0) | ((self.sizes > size) & (best + self.sizes - size >= threshold))
        return found.result()

    @staticmethod
    def _closed(common: np.ndarray, keep: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """Without the rows that go; a common prefix is then the least since the row before."""
        at = np.flatnonzero(keep)
        if not len(at):
            return common[:0], *(c[:0] for c in columns)
        return np.minimum.reduceat(common[: at[-1] + 1], np.append(0, at[:-1] + 1)), *(c[at] for c in columns)

    def _insert(self, piles: dict[int, Rows], alive: np.ndarray, done: int, found: Classes | None) -> tuple[dict[int, Rows], np.ndarray]:
        """Round ``done``: every row is dealt out by the symbol before it, which inserts a suffix of each string under way.

        Returns the new files, and for each sequence the longest common prefix of its new suffix.
        With ``found``, the rows of the round before are looked through and only new ones stay.
        """
        out = {-1: Rows()}
        best = np.zeros(len(alive), np.int64)
        floor = np.full(256, 255, np.uint8)  # least common prefix since the last row of each symbol
        last = np.full(256, -1, np.int64)  # sequence of the last row of each file, if that is a new suffix
        pending = 255  # least common prefix of rows that went since the last one that stays
        for x in _blocks(piles):
            if found:
                found.see(x)
            common = (x & U(0xFF)).astype(np.uint8)
            keep = alive[(x >> U(32)).astype(np.int64)]
            if not keep.all():
                if not keep.any():
                    pending = min(pending, int(common.min()))
                    continue
                tail = common[int(np.flatnonzero(keep)[-1]) + 1 :]
                common, x = self._closed(common, keep, x)
                common[0] = min(int(common[0]), pending)
                pending = int(tail.min()) if len(tail) else 255
            else:
                common[0] = min(int(common[0]), pending)
                pending = 255
            self._deal(out, x, common, floor, last, best, done, found is not None)
        return out, best

    def _deal(self, out: dict[int, Rows], x: np.ndarray, common: np.ndarray, floor: np.ndarray, last: np.ndarray, best: np.ndarray, done: int, newest: bool) -> None:
        seq, length = (x >> U(32)).astype(np.int64), ((x >> U(8)) & U(0xFFFF)).astype(np.int64)
        n_empty = int(np.searchsorted(length > 0, True)) if not length[0] else 0
        if n_empty:  # suffixes of length 0 come first, and stay
            waiting = x[:n_empty][self.delay[seq[:n_empty]] >= done] if newest else x[:n_empty]
            if len(waiting):
                out[-1].write(waiting)
        more = np.flatnonzero((length < self.sizes[seq]) & (self.delay[seq] < done))
        if not len(more):
            np.minimum(floor, common.min(), out=floor)
            return
        symbol = self.text[self.start[seq[more] + 1] - 1 - length[more]]
        order = np.argsort(symbol, kind="stable")
        by, at = symbol[order], more[order]
        first = np.ones(len(at), bool)
        first[1:] = by[1:] != by[:-1]
        cut, inner = np.flatnonzero(first), np.flatnonzero(~first)
        value = np.empty(len(at), np.uint8)
        value[inner] = _range_minima(common, at[inner - 1] + 1, at[inner])
        since = np.minimum.accumulate(common)
        until = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        value[cut] = np.minimum(floor[by[cut]], since[at[cut]])
        value = np.minimum(value, MOST - 1) + np.uint8(1)
        ends = np.append(cut[1:], len(at))
        np.minimum(floor, since[-1], out=floor)
        floor[by[cut]] = until[at[ends - 1] + 1]
        for a in cut.tolist():
            if int(by[a]) not in out:
                out[int(by[a])] = Rows()
                value[a] = 0
        s, size = seq[at], length[at] + 1
        rows = (s.astype(U) << U(32)) | (size.astype(U) << U(8)) | value.astype(U)
        after = np.zeros(len(value), np.uint8)
        after[:-1] = np.where(first[1:], 0, value[1:])
        new = size == done - self.delay[s]
        best[s[new]] = np.maximum(value, after)[new]
        # neighbours across blocks
        before = last[by[cut]]
        there = before >= 0
        best[before[there]] = np.maximum(best[before[there]], value[cut[there]])
        last[by[cut]] = np.where(new[ends - 1], s[ends - 1], -1)
        for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
            out[int(by[a])].write(rows[a:b])


def _compare(k: int, m: int):
    def run(doc: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # equal windows have their key at the same place, so segments line up by it
        place = [segments(BYTE[data], offsets, k, m)["place"] for data, offsets in buffers(contents)]
        right = np.array([len(c) for c in contents]) - np.concatenate(place)
        bwt = CollectionBWT(contents, right.max() - right)
        group, seq, length = bwt.classes(k)
        place = bwt.sizes[seq] - length
        bounds = np.append(0, np.cumsum(n))
        flags = np.zeros(bounds[-1], bool)
        if len(seq):
            # the first start of each class stays, in each row of its document
            order = np.lexsort((start[seq] + place, row[seq], doc[seq], group))
            group, seq, place = group[order], seq[order], place[order]
            begin, at = start[seq] + place, np.arange(len(group))
            first = np.append(True, group[1:] != group[:-1])
            here = first | np.append(True, (doc[seq[1:]] != doc[seq[:-1]]) | (row[seq[1:]] != row[seq[:-1]]))
            head, own = (np.maximum.accumulate(np.where(x, at, 0)) for x in (first, here))
            later = (doc[seq] > doc[seq[head]]) | (begin > begin[own])
            flags[bounds[seq[later]] + place[later]] = True
        return flagged_runs(flags, bounds)

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(docs: DataFrame, window: int = 100) -> DataFrame:
    """Runs of windows (doc_id, row, start, n; in bytes) that also start earlier; ``docs`` as from ``with_rows``."""
    key = max(1, window // 6)
    return marked_windows(docs, Scheme(window, key, False, True), _compare(window, key))


def remove_repeats(docs: DataFrame, window: int = 100, spans: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary)."""
    names = [x.split()[0] for x in OUT.split(", ")] + ["kept"] * spans

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in documents([batch]):
                marks = batch.column("marks").slice(at, len(ids)).to_pylist()
                at += len(ids)
                rows = []
                for doc, a, b, m in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), marks, strict=True):
                    gone = covered(m, b - a, window)
                    kept = data[a:b][~gone].tobytes()
                    n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    rows.append((doc, b - a, b - a - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), *[kept] * spans))
                types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * spans
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    docs = with_rows(docs)
    return with_marks(docs, repeated_bytes(docs, window)).mapInArrow(tidy(run), OUT + ", kept binary" * spans)
