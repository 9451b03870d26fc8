"""Windows of k symbols that recur, found by content-chosen segments.

A document's windows are cut into segments: maximal runs of windows whose smallest m-gram (by
hash, the leftmost of equals) is the same one. Equal windows have the same smallest m-gram at
the same offset, so segments that share a window share that key, and a segment whose key
occurs once has no window that recurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BASE, BASE2, BYTE, U, documents, mix, prefix_hash, range_hash, runs, word_hashes, words
from ._tables import told_apart
from .scratch import materialize, partitions, tidy

LOW32 = U(0xFFFFFFFF)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(a)
    size = -(-n // w) * w
    blocks = np.full(size, ~U(0), U)
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments(values: np.ndarray, bounds: np.ndarray, k: int, m: int) -> dict[str, np.ndarray]:
    """The segments of all documents in a buffer of symbols.

    ``values``: a 64-bit value of each symbol; ``bounds``: each document's first symbol, and the
    end. Returns key, digest, doc (index), start (of the first window, in its document), n (windows)
    and place (of the key, from start).
    """
    n, empty = len(values), np.zeros(0, np.int64)
    none = {"key": empty.astype(U), "digest": empty.astype(U), "doc": empty, "start": empty, "n": empty, "place": empty}
    sizes = np.diff(bounds)
    if n < k or not (sizes >= k).any():
        return none
    prefix = prefix_hash(values, BASE)
    at = np.arange(n - m + 1)
    gram = range_hash(prefix, at, at + m, BASE)
    low = sliding_min((gram & ~LOW32) | at.astype(U), k - m + 1) & LOW32
    left = np.repeat(bounds[1:], sizes)[: n - k + 1] - np.arange(n - k + 1)
    starts = np.flatnonzero(left >= k)
    place = low[starts].astype(np.int64)
    new = np.empty(len(place), bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    first = np.flatnonzero(new)
    start, place = starts[first], place[first]
    count = np.diff(np.append(first, len(starts)))
    end = start + count + k - 1
    other = prefix_hash(mix(values), BASE2)
    digest = mix(range_hash(other, start, end, BASE2) + (place - start).astype(U) * U(0x9FB21C651E98DF25))
    doc = np.searchsorted(bounds, start, "right") - 1
    # the last of equal bounds, so that empty documents are passed over
    return {"key": gram[place], "digest": digest, "doc": doc, "start": start - bounds[doc], "n": count, "place": place - start}


class Scheme:
    """What the symbols of a text are, and how long windows (k) and keys (m) are."""

    def __init__(self, k: int, m: int, of_words: bool, same_document: bool):
        self.k, self.m, self.of_words, self.same_document = k, m, of_words, same_document
        self.crowded = CROWDED

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Values, document bounds, and where each symbol begins and ends (None: itself a byte)."""
        if not self.of_words:
            return BYTE[data], offsets, None, None
        starts, ends, bounds = words(data, offsets)
        return word_hashes(data, starts, ends), bounds, starts, ends


SCHEMA = "part int, blob binary"
#: Segments that a scan task gathers before it sends them on.
GATHERED = 400_000
#: Distinct segments of a key beyond which each of their windows becomes a key of its own.
CROWDED = 20_000
NO_ID = (1 << 63) - 1


def _planes(a: np.ndarray, n: int = 8) -> bytes:
    return np.ascontiguousarray(a.astype(U).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplane(b: bytes, at: int, count: int, n: int = 8) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8, count * n, at).reshape(n, count).T
    return out.view(U).ravel()


def _pack(e: dict[str, np.ndarray]) -> bytes:
    """Byte planes, compressed: key (48 bits), digest (64), document (differences), start, n and flag, row."""
    step = np.diff(e["doc"], prepend=0)
    zigzag = (step.astype(np.int64) << 1) ^ (step.astype(np.int64) >> 63)
    raw = _planes(e["key"], 6) + _planes(e["digest"]) + _planes(zigzag.view(U)) + _planes(e["start"], 5) + _planes(e["n"], 4) + _planes(e["row"].view(U))
    return len(e["key"]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(b: bytes) -> dict[str, np.ndarray]:
    n, raw = int.from_bytes(b[:8], "little"), zstandard.ZstdDecompressor().decompress(b[8:])
    at, out = 0, []
    for size in (6, 8, 8, 5, 4, 8):
        out.append(_unplane(raw, at, n, size))
        at += n * size
    z = out[2]
    step = ((z >> U(1)) ^ (U(0) - (z & U(1)))).view(np.int64)
    return {"key": out[0], "digest": out[1], "doc": np.cumsum(step), "start": out[3].view(np.int64), "n": out[4].view(np.int64), "row": out[5].view(np.int64)}


def _order(e: dict[str, np.ndarray]) -> np.ndarray:
    return np.lexsort((e["start"], e["row"], e["doc"], e["digest"], e["key"]))


def _split(e: dict[str, np.ndarray], scheme: Scheme) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """``e`` sorted, which rows own their content (the first; of words, all in its document), and which are merely later."""
    e = {k: v[o] for o in [_order(e)] for k, v in e.items()}
    new = np.ones(len(e["key"]), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["digest"][1:] != e["digest"][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = e["doc"] > e["doc"][first]
    if scheme.same_document:
        here = new.copy()
        here[1:] |= (e["doc"][1:] != e["doc"][:-1]) | (e["row"][1:] != e["row"][:-1])
        later |= e["start"] > e["start"][np.maximum.accumulate(np.where(here, np.arange(len(here)), 0))]
    return e, ~later, new


def _scan(scheme: Scheme, parts: int):
    """Segments of a scan task, dealt by key; of equal ones only the first leaves it, the others are marked at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            e = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            held.clear()
            e["key"] >>= U(16)
            e, own, new = _split(e, scheme)
            more = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
            e["n"] = (e["n"] << 1) | more
            part = np.where(own, (e["key"] % U(parts)).astype(np.int64), parts + e["doc"] % parts)
            order = np.lexsort((e["start"], e["doc"], part))
            e, part = {k: v[order] for k, v in e.items()}, part[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            ids, blobs = [], []
            for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
                ids.append(int(part[a]))
                blobs.append(_pack({k: v[a:b] for k, v in e.items()}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

        gathered = 0
        for batch in batches:
            rows, at = batch.column("row").to_numpy(), 0
            for ids, data, offsets in documents([batch]):
                values, bounds, _, _ = scheme.symbols(data, offsets)
                e = segments(values, bounds, scheme.k, scheme.m)
                if len(e["key"]):
                    del e["place"]
                    e["row"] = rows[at : at + len(ids)][e["doc"]]
                    e["doc"] = np.array([NO_ID if x is None else x for x in ids], np.int64)[e["doc"]]
                    held.append(e)
                    gathered += len(e["key"])
                    if gathered >= GATHERED:
                        yield from flush()
                        gathered = 0
                at += len(ids)
        if held:
            yield from flush()

    return run


FOUND = "doc_id long, row long, start long, n long, key long, kind int"
LATER, CONTENT, WINDOWS = 0, 1, 2


def _group(scheme: Scheme, parts: int):
    """Of all segments of some keys: those merely later (whole), and those whose content has to be compared."""

    def send(e: dict[str, np.ndarray], kind: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(kind), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(e["doc"][s]), pa.array(e["row"][s]), pa.array(e["start"][s]), pa.array(e["n"][s] >> 1), pa.array(e["key"][s].view(np.int64)), pa.array(kind[s].astype(np.int32))], ["doc_id", "row", "start", "n", "key", "kind"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                e = _unpack(blob.as_py())
                if part >= parts:
                    yield from send(e, np.full(len(e["key"]), LATER))
                else:
                    held.append(e)
        if not held:
            return
        e, own, new = _split({k: np.concatenate([h[k] for h in held]) for k in held[0]}, scheme)
        held.clear()
        other = np.append(True, e["key"][1:] != e["key"][:-1])
        group = np.cumsum(other) - 1
        recurs = (np.bincount(group) > 1) | (np.bincount(group, e["n"] & 1) > 0)
        crowded = np.bincount(group, new) > scheme.crowded
        kind = np.where(own, np.where(crowded[group], WINDOWS, CONTENT), LATER)
        keep = recurs[group]
        yield from send({k: v[keep] for k, v in e.items()}, kind[keep])

    return run


CONTENTS = "key long, doc_id long, row long, start long, n long, content binary"


def _cut(scheme: Scheme):
    """The contents of the segments to compare, from their documents.

    Windows of crowded keys leave the task once each; the later ones are marked at once, which a
    null content says.
    """

    def send(rows: list) -> pa.RecordBatch:
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "doc_id", "row", "start", "n", "content"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        single: dict[int, tuple] = {}
        for batch in batches:
            at = 0
            for ids, data, offsets in documents([batch]):
                wanted = batch.column("wanted").slice(at, len(ids)).to_pylist()
                row_of = batch.column("row").slice(at, len(ids)).to_pylist()
                at += len(ids)
                values, bounds, starts, ends = scheme.symbols(data, offsets)
                raw, prefix = data.tobytes(), None

                def text(b: int, m: int) -> bytes:
                    end = b + m + scheme.k - 1  # noqa: B023
                    return raw[b:end] if starts is None else raw[starts[b] : ends[end - 1]]  # noqa: B023

                for doc, row, base, of in zip(ids, row_of, bounds[:-1].tolist(), wanted, strict=True):
                    for x in of:
                        a, n = base + x["start"], x["n"]
                        if x["kind"] == CONTENT:
                            rows.append((x["key"], doc, row, x["start"], n, text(a, n)))
                            continue
                        prefix = prefix_hash(values, BASE) if prefix is None else prefix
                        w = np.arange(a, a + n)
                        for h, b in zip(range_hash(prefix, w, w + scheme.k, BASE).view(np.int64).tolist(), w.tolist(), strict=True):
                            this = (doc, row, b - base, text(b, 1))
                            old = single.setdefault(h, this)
                            if old is not this:
                                first, other = (this, old) if this < old else (old, this)
                                single[h] = first
                                later = first[3] == other[3] and (first[0] < other[0] or scheme.same_document and first[1] == other[1] and first[2] < other[2])
                                rows.append((other[0] * 31 + other[2] & 0x7FFFFFFF if later else h, *other[:3], 1, None if later else other[3]))
                    if len(single) > 100_000:
                        rows += [(h, *x[:3], 1, x[3]) for h, x in single.items()]
                        single.clear()
                    if len(rows) > 20_000:
                        yield send(rows)
                        rows = []
        rows += [(h, *x[:3], 1, x[3]) for h, x in single.items()]
        if rows:
            yield send(rows)

    return run


MARKED = "doc_id long, row long, start long, n long"


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id (null: ``NO_ID``), text, and ``row``, which tells rows of one doc_id apart by their text; 0 if ids are unique."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", told_apart(docs).alias("row"))


def marked_windows(docs: DataFrame, scheme: Scheme, compare: Callable) -> DataFrame:
    """Windows (doc_id, row, start, n: a run of n) that also start earlier; ``docs`` as from :func:`with_rows`.

    ``compare`` gets the distinct segments of a shard of keys (documents, rows, starts, window counts,
    contents) and returns runs of windows (segment, first window, count) that start earlier in
    another of them.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    dealt = docs.mapInArrow(tidy(_scan(scheme, parts)), SCHEMA)
    found = materialize(dealt.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).mapInArrow(tidy(_group(scheme, parts)), FOUND), "segments")
    wanted = found.filter(F.col("kind") != LATER).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "n", "key", "kind")).alias("wanted"))
    texts = docs.join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r"))).select("doc_id", "row", "text", "wanted")
    contents = texts.mapInArrow(tidy(_cut(scheme)), CONTENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, contents = [[], [], [], []], []
        for batch in batches:
            there = batch.column("content").is_valid()
            done, batch = batch.filter(pc.invert(there)), batch.filter(there)
            if done.num_rows:
                yield done.select(["doc_id", "row", "start", "n"])
            for held, name in zip(numbers, ("doc_id", "row", "start", "n"), strict=True):
                held.append(batch.column(name).to_numpy())
            contents += batch.column("content").to_pylist()
        if contents:
            doc, row, start, n = (np.concatenate(c) for c in numbers)
            at, first, count = compare(doc, row, start, n, contents)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(row[at]), pa.array(start[at] + first), pa.array(count)], ["doc_id", "row", "start", "n"])

    later = found.filter(F.col("kind") == LATER).select("doc_id", "row", "start", "n")
    return later.unionAll(contents.repartition(parts, "key").mapInArrow(tidy(run), MARKED))


def buffers(contents: list[bytes], at_once: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The contents as bytes and offsets, some at a time: hashing takes many times their size."""
    held: list[bytes] = []
    size = 0
    for c in contents:
        held.append(c)
        size += len(c)
        if size >= at_once:
            yield np.frombuffer(b"".join(held), np.uint8), np.append(0, np.cumsum([len(x) for x in held]))
            held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.append(0, np.cumsum([len(x) for x in held]))


def flagged_runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True in each piece of ``flags``: piece, first place in it, length."""
    starts, ends = runs(flags, bounds)
    at = np.searchsorted(bounds, starts, "right") - 1
    return at, starts - bounds[at], ends - starts


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``marks`` (a list of runs, or null) of every row of :func:`with_rows`."""
    by = marks.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "n")).alias("marks"))
    found = docs.join(by, (F.col("doc_id") == F.col("d")) & (F.col("row") == F.col("r")), "left")
    return found.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "marks")


def covered(marks: list | None, size: int, k: int) -> np.ndarray:
    """Which of ``size`` symbols a marked window covers."""
    out = np.zeros(size + 1, np.int64)
    for x in marks or ():
        a, b = x["start"], x["start"] + x["n"] + k - 1
        if b <= size:  # rows that share a doc_id may be shorter
            out[a] += 1
            out[b] -= 1
    return np.cumsum(out[:-1]) > 0
