"""Vectorised text kernels over the UTF-8 bytes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte, and odd bases of the two polynomial hashes.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE, BASE2 = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            x = np.full(size, b, U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[int(base)] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(values: np.ndarray, base: U) -> np.ndarray:
    """Prefix sums of values[i] * base**i; see :func:`range_hash`."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: U) -> np.ndarray:
    """A hash of values[start:end] that doesn't depend on where they stand."""
    return mix((prefix[end] - prefix[start]) * powers(base, len(prefix))[1][start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def documents(batches: Iterable[pa.RecordBatch], at_once: int = 1 << 19, most: int = 1 << 30) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, bytes, offsets) of runs of at most ``most`` documents of about ``at_once`` bytes; a null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column("text"), "").cast(pa.large_binary())
        ids = batch.column("doc_id").to_pylist()
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = text.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(ids):
            j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + at_once, "right")) - 1), i + most)
            yield ids[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at document bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cut - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each document, the index of its first word (one more at the end).

    Words are the runs without ``[\\x20\\x09-\\x0D]``.
    """
    starts, ends = runs(~IS_WHITE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(BYTE[data], BASE), starts, ends, BASE)


def code_points(data: np.ndarray) -> np.ndarray:
    """The number of code points that begin before each byte (one more at the end)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
