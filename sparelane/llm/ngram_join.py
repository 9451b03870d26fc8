"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word shingles; documents of equal sets are one node. Shingles
have one order for the whole corpus, by the number of nodes that hold them, so those of a single
node come first. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of
either.

* Shingles are dealt by hash once, with their nodes. Those of a single node end there; the others go
  back to their nodes with their counts. A node whose shared shingles are less than t n links with
  nothing; the others keep their shared shingles, which is all that a comparison needs.
* Nodes of equal prefix and size are one group. Groups that share a prefix shingle are candidates
  if they fit in size, if the smaller one has it in its index part (of which the first 14 hundredths
  suffice at 75) and if enough shingles follow it in both (group filter).
* Candidates expand to nodes and are verified on their whole sets, in rounds: first each
  node with the group that most of its lists point to, then with one node of the largest
  component in each list, and in the end every pair of a list that still is in two
  components. So clusters cost their size, not its square, and no link that joins two
  components is missed.

Shingles that a sample of documents shows to be very frequent (``HOT``) skip the deal by hash: their
count is taken from the sample and broadcast, at most ``1 / HOT`` of a partition's worth of them. A wrong count
only changes the order. Lists of more than ``BLOCK`` groups are split.

Links between copies aren't expanded: the result is a class per document.

Defined results: texts without words have an empty set and no links; fewer words than a
shingle has are one shingle; a null ``doc_id`` is the last; rows that share a ``doc_id`` are
compared each for itself; other columns are ignored, whatever their names, unless asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import BASE, LOWER, U, documents, mix, prefix_hash, range_hash, word_hashes, words
from ._windows import NO_ID, _planes, _unplane
from .components import components
from .scratch import compact, drop, materialize, partitions, tidy

#: Members of one node that are verified in one task at a time, and members of a list that are paired in one.
TOGETHER, BLOCK = 256, 20_000
#: Shingles that a task gathers before it sends them on.
GATHERED = 1_000_000
#: A shingle is hot if its nodes are this share of a partition; one in ``SAMPLED`` nodes tells.
HOT, SAMPLED = 0.05, 16
#: Members of a list that others are paired with at first.
HUBS = 4
#: Bits of a shingle's hash; the others tell the documents of a buffer apart.
BITS = 56
MOST = 255
MASK = U((1 << BITS) - 1)
#: Bytes of sets in a batch of rows.
BATCH = 8 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and each document's bounds among them."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    counts = np.diff(bounds)
    prefix = prefix_hash(word_hashes(data, starts, ends), BASE)
    at = np.arange(len(starts))
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = (np.repeat(bounds[1:], counts) - at) >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    h = np.concatenate([range_hash(prefix, at[whole], at[whole] + size, BASE), range_hash(prefix, bounds[short], bounds[short + 1], BASE)])
    doc = np.concatenate([doc[whole], short])
    # document and hash in one number, so that one plain sort does
    packed = np.unique((doc.astype(U) << U(BITS)) | (h >> U(64 - BITS)))
    return packed & MASK, np.searchsorted(packed, np.arange(len(counts) + 1, dtype=U) << U(BITS))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(U(0), np.cumsum(values, dtype=U))
    return total[bounds[1:]] - total[bounds[:-1]]


def node_hashes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each whole set; with its size, the node."""
    return mix(_sums(mix(h ^ U(0x5851F42D4C957F2D)), bounds))


def node_keys(a: np.ndarray, n: np.ndarray) -> pa.Array:
    """Hash and size as 12 bytes."""
    both = np.empty(len(a), np.dtype([("a", ">u8"), ("n", ">u4")]))
    both["a"], both["n"] = a, n
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(12), len(a), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def index_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two similar sets, the smaller one has the first shingle they share among this many."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _sets(size: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in documents([batch], most=MOST):
                part = batch.slice(at, len(ids))
                at += len(ids)
                h, bounds = shingles(data, offsets, size)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([pa.array([NO_ID if x is None else x for x in ids], pa.int64()), pa.array(n), node_keys(node_hashes(h, bounds), n), *(part.column(c) for c in names)], ["doc_id", "n", "node", *names])

    return run


def _frequent(size: int):
    """Shingles that several sampled documents of a task hold, and how many do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold(least: int) -> tuple[np.ndarray, np.ndarray]:
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)
            return h[n >= least], n[n >= least]

        for _, data, offsets in documents(batches, most=MOST):
            h = shingles(data, offsets, size)[0]
            held.append((h, np.ones(len(h), np.int64)))
            if sum(len(x) for x, _ in held) > GATHERED:
                held = [fold(2)]
        if held:
            h, n = fold(3)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def hot_shingles(docs: DataFrame, size: int, nodes: int, shingled: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and estimated counts of shingles that ``HOT`` of a partition's shingles or more would be."""
    least = max(64, HOT * shingled / partitions(docs.sparkSession))
    if nodes < least:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("doc_id", "text")
    got = sample.mapInArrow(tidy(_frequent(size)), "h long, n long").groupBy("h").agg((F.sum("n") * SAMPLED).alias("n")).filter(F.col("n") >= least).orderBy("h").toArrow()
    return got.column("h").to_numpy().astype(np.int64).view(U), got.column("n").to_numpy().astype(np.int64)


DEALT = "part int, blob binary"


def _code(df: np.ndarray) -> np.ndarray:
    """A count in 16 bits: a float that was cut."""
    return (df.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def _send(part: np.ndarray, a: np.ndarray, n: np.ndarray, h: np.ndarray, code: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (node, shingle) by part, rows of a node together; each node once in a blob."""
    if not len(part):
        return
    part = part.astype(np.uint16 if int(part.max(initial=0)) < 1 << 16 else np.uint32)  # 16 bits sort by radix
    order = np.argsort(part, kind="stable")
    part, a, n, h = part[order], a[order], n[order], h[order]
    code = code[order] if code is not None else None
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    z = zstandard.ZstdCompressor(level=1)
    ids, blobs = [], []
    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
        new = np.ones(y - x, bool)
        new[1:] = (a[x + 1 : y] != a[x : y - 1]) | (n[x + 1 : y] != n[x : y - 1])
        first = np.flatnonzero(new)
        raw = _planes(a[x:y][first]) + _planes(n[x:y][first], 4) + _planes(np.diff(np.append(first, y - x)), 4) + _planes(h[x:y], 7)
        raw += code[x:y].tobytes() if code is not None else b""
        ids.append(int(part[x]))
        blobs.append(len(first).to_bytes(4, "little") + (y - x).to_bytes(4, "little") + z.compress(raw))
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _receive(batches: Iterable[pa.RecordBatch], coded: bool) -> tuple[np.ndarray, ...] | None:
    held = []
    for batch in batches:
        for b in batch.column("blob"):
            b = b.as_py()
            k, count, raw = int.from_bytes(b[:4], "little"), int.from_bytes(b[4:8], "little"), zstandard.ZstdDecompressor().decompress(b[8:])
            times = _unplane(raw, 12 * k, k, 4).view(np.int64)
            a, n, h = _unplane(raw, 0, k), _unplane(raw, 8 * k, k, 4).astype(np.uint32), _unplane(raw, 16 * k, count, 7)
            code = np.frombuffer(raw, np.uint16, count, 16 * k + 7 * count) if coded else np.zeros(0, np.uint16)
            held.append((np.repeat(a, times), np.repeat(n, times), h, code))
    return tuple(np.concatenate(c) for c in zip(*held, strict=True)) if held else None


def _entries(size: int, parts: int, hot):
    """(node, shingle) dealt by shingle, hot ones by node; a node leaves a task once at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[int] = set()
        total = 0
        often, counts = hot.value

        def flush() -> Iterator[pa.RecordBatch]:
            a, n, h = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            if len(often):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                known = often[at] == h
                if known.any():
                    yield from _send(U(parts) + a[known] % U(parts), a[known], n[known], h[known], _code(counts[at[known]]))
                    a, n, h = a[~known], n[~known], h[~known]
            yield from _send(h % U(parts), a, n, h, None)

        for _, data, offsets in documents(batches, most=MOST):
            h, bounds = shingles(data, offsets, size)
            a, n = node_hashes(h, bounds), np.diff(bounds)
            fresh = np.zeros(len(a), bool)
            for i, x in enumerate(a.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            keep = np.repeat(fresh, n)
            held.append((np.repeat(a[fresh], n[fresh]), np.repeat(n[fresh], n[fresh]).astype(np.uint32), h[keep]))
            total += int(keep.sum())
            if len(seen) > 200_000:
                seen.clear()
            if total > GATHERED:
                yield from flush()
                total = 0
        if total:
            yield from flush()

    return run


def _shared(parts: int):
    """Shingles of several nodes back to these, with their number; hot ones are passed on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = np.array(batch.column("part").to_numpy()) < parts
                if not own.all():
                    done = batch.filter(pa.array(~own))
                    passed.append(pa.RecordBatch.from_arrays([pa.array((done.column("part").to_numpy() - parts).astype(np.int32)), done.column("blob")], ["part", "blob"]))
                yield batch.filter(pa.array(own))

        passed: list[pa.RecordBatch] = []
        got = _receive(plain(), False)
        yield from passed
        if got is None:
            return
        a, n, h, _ = got
        del got
        order = np.argsort(h)
        by = h[order]
        same = by[1:] == by[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        order = order[keep]
        a, n, h = a[order], n[order], h[order]
        # copies of a node come from several tasks
        order = np.lexsort((n, a, h))
        a, n, h = a[order], n[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (n[1:] != n[:-1])
        a, n, h = a[new], n[new], h[new]
        group = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1 if len(h) else np.zeros(0, np.int64)
        df = np.bincount(group)[group] if len(h) else group
        keep = df > 1
        a, n, h, df = a[keep], n[keep], h[keep], df[keep]
        order = np.lexsort((n, a))
        a, n, h, df = a[order], n[order], h[order], df[order]
        yield from _send(a % U(parts), a, n, h, _code(df))

    return run


LINKABLE = "node binary, n long, gid long, skipped long, shared binary, prefix binary"


def _linkable(percent: int):
    """Nodes that hold enough shared shingles: these in order of hash, and those of the prefix in corpus order after ``skipped`` others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _receive(batches, True)
        if got is None:
            return
        a, n, h, code = got
        del got
        order = np.lexsort((h, n, a))
        a, n, h, code = a[order], n[order], h[order], code[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1]) | (n[1:] != n[:-1])
        a, n, h, code = a[new], n[new], h[new], code[new]
        edge = np.ones(len(a), bool)
        edge[1:] = (a[1:] != a[:-1]) | (n[1:] != n[:-1])
        first = np.flatnonzero(edge)
        cut = np.append(first, len(a))
        rows, held = [], 0
        size = n[first].astype(np.int64)
        m = np.diff(cut)
        for i in np.flatnonzero(m >= -(-size * percent // 100)).tolist():
            x, y, k = int(cut[i]), int(cut[i + 1]), int(size[i])
            skipped = k - int(m[i])
            head = h[x:y][np.lexsort((h[x:y], code[x:y]))[: max(0, int(prefix_size(size[i], percent)) - skipped)]]
            # with a shingle of its own among the first, a node is a group of its own
            mine = a[x : x + 1] if skipped else _sums(mix(head), np.array([0, len(head)]))
            gid = mix(mine + size[i : i + 1].astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)[0]
            rows.append((int(a[x]), k, int(gid), skipped, h[x:y].tobytes(), head.tobytes()))
            held += len(rows[-1][4]) + len(rows[-1][5])
            if held > BATCH:
                yield _rows(rows)
                rows, held = [], 0
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list) -> pa.RecordBatch:
    a, n, gid, skipped, shared, prefix = zip(*rows, strict=True)
    keys = node_keys(np.array(a, U), np.array(n))
    return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(gid, pa.int64()), pa.array(skipped, pa.int64()), pa.array(shared, pa.binary()), pa.array(prefix, pa.binary())], ["node", "n", "gid", "skipped", "shared", "prefix"])


ENTRIES = "list long, gid long, n long, place long, skipped long"


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix shingles of groups, each with its place in the group's sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            some = batch.slice(i, 1000)
            heads = [np.frombuffer(x, np.int64) for x in some.column("prefix").to_pylist()]
            times = np.array([len(x) for x in heads])
            if not times.sum():
                continue
            gid, n, skipped = (np.repeat(some.column(c).to_numpy(), times) for c in ("gid", "n", "skipped"))
            place = skipped + np.arange(len(n)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(gid), pa.array(n), pa.array(place), pa.array(skipped)], ["list", "gid", "n", "place", "skipped"])


def _fit(n: np.ndarray, place: np.ndarray, i: int, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the groups of row i and of rows j may be similar if this is the first shingle they share."""
    small, large = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
    near = 100 * small >= percent * large
    need = -(-percent * (small + large) // (100 + percent))
    near &= np.minimum(n[j] - place[j], n[i] - place[i]) >= need
    early = place < index_size(n, percent)
    return near & (((n[i] <= n[j]) & early[i]) | ((n[j] <= n[i]) & early[j]))


def _lists(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """The rows of each list and block (sorted by these)."""
    kept: list[list] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("list").to_numpy(), batch.column("block").to_numpy()], 1)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True):
            mine = (tuple(key[x]), [v[x:y] for v in values])
            if kept and kept[-1][0] != mine[0]:
                yield [np.concatenate(c) for c in zip(*(k[1] for k in kept), strict=True)]
                kept = []
            kept.append(mine)
    if kept:
        yield [np.concatenate(c) for c in zip(*(k[1] for k in kept), strict=True)]


def _leaders(percent: int):
    """Each group with the one of its list that has the fewest shingles of its own, of those that it may be similar to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        for gid, n, place, skipped in _lists(batches, ("gid", "n", "place", "skipped")):
            if len(gid) < 2:
                continue
            rest = np.lexsort((gid, skipped / n))
            for _ in range(HUBS):
                fit = _fit(n, place, rest[0], rest[1:], percent)
                found.append((gid[rest[1:][fit]], np.full(int(fit.sum()), gid[rest[0]])))
                total += len(found[-1][0])
                rest = rest[1:][~fit]
                if len(rest) < 2:
                    break
            if total > 100_000:
                yield _voted(found)
                found, total = [], 0
        if total:
            yield _voted(found)

    return run


def _voted(found: list) -> pa.RecordBatch:
    pairs, votes = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], 1), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(votes)], ["gid", "leader", "votes"])


def _verify(percent: int):
    """Pairs whose sets are similar; rows come sorted by node, the node's own set first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, size = None, np.zeros(0, U), 0
        for batch in batches:
            found = []
            for node, member, n, shared in zip(*(batch.column(c).to_pylist() for c in ("node", "member", "n", "shared")), strict=True):
                mine = np.frombuffer(shared, U)
                if member is None:
                    now, own, size = node, mine, n
                    continue
                if node != now or not len(own) or not len(mine):
                    continue
                both = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
                if 100 * both >= percent * (size + n - both):
                    found.append((member, node))
            if found:
                yield _batch(found)

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose whole sets are similar. A node of many pairs is split over tasks."""
    parts = partitions(pairs.sparkSession)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts"))
    mine = sets.join(salts, F.col("node") == F.col("b")).select("node", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("member"), "n", "shared")
    other = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")).join(sets, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "salt", F.col("a").alias("member"), "n", "shared")
    rows = mine.unionAll(other).repartition(parts, "node", "salt").sortWithinPartitions("node", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(tidy(_verify(percent)), "a binary, b binary")


def _foreign(percent: int, any_of: bool = False):
    """Each member with one of the list's largest component that it isn't in and that fits.

    The one with the fewest shingles of its own; with ``any_of`` another one in each list.
    """

    def pairs(n: np.ndarray, place: np.ndarray, label: np.ndarray, top: np.ndarray, skipped: np.ndarray) -> Iterator[tuple]:
        inside = np.flatnonzero(top)
        inside = np.random.default_rng(int(place.sum())).permutation(inside) if any_of else inside[np.argsort((skipped / n)[inside], kind="stable")]
        for i in np.flatnonzero(~top).tolist():
            fit = _fit(n, place, i, inside, percent)
            if fit.any():
                yield i, inside[fit.argmax()]

    return pairs


def _all_foreign(percent: int):
    """All pairs in different components that may be similar; members of the largest one need no pairs among themselves."""

    def pairs(n: np.ndarray, place: np.ndarray, label: np.ndarray, top: np.ndarray, skipped: np.ndarray) -> Iterator[tuple]:
        out = np.flatnonzero(~top)
        rest = np.concatenate([out, np.flatnonzero(top)])
        for k, i in enumerate(out.tolist()):
            after = rest[k + 1 :]
            for j in after[(label[after] != label[i]) & _fit(n, place, i, after, percent)].tolist():
                yield i, j

    return pairs


PAIRS = "a binary, b binary, votes long"


def _pairs(choose):
    """Rows of lists (sorted by list and block) to pairs of nodes, and how many lists of the task say so."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for nodes, n, place, skipped, label, top in _lists(batches, ("node", "n", "place", "skipped", "label", "top")):
            codes = np.unique(label, return_inverse=True)[1]
            out.update((nodes[i], nodes[j]) for i, j in choose(n, place, codes, top.astype(bool), skipped))
            if len(out) > 50_000:
                yield _batch(out, list(out.values()))
                out.clear()
        if out:
            yield _batch(out, list(out.values()))

    return run


def _batch(pairs: Iterable, votes: list[int] | None = None) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    both = [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
    return pa.RecordBatch.from_arrays(both, ["a", "b"]) if votes is None else pa.RecordBatch.from_arrays([*both, pa.array(votes, pa.int64())], ["a", "b", "votes"])


def _opened(expanded: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of lists in several components, in blocks: the largest component is dealt out, others go to each block."""
    of = labels.withColumnRenamed("node", "m")
    named = expanded.join(of, F.col("node") == F.col("m"), "left").select("list", "node", "n", "place", "skipped", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("list", "label").agg(F.count("*").alias("k"))
    tops = counts.groupBy("list").agg(F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    tops = tops.select("list", F.col("most.label").alias("first"), F.ceil(F.col("most.k") / BLOCK).cast("int").alias("blocks"))
    rows = named.join(tops, "list").withColumn("top", F.col("label") == F.col("first"))
    block = F.when(F.col("top"), F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    return rows.select("list", F.explode(block).alias("block"), "node", "n", "place", "skipped", "label", "top")


def linked_nodes(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """``node`` and ``label`` (the smallest node that links reach) of the nodes with links."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select("doc_id", "text")
    total = sets.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    hot = spark.sparkContext.broadcast(hot_shingles(docs, size, total.rows, total.n or 0))
    part = F.pmod("part", F.lit(parts)).cast("int")
    dealt = docs.mapInArrow(tidy(_entries(size, parts, hot)), DEALT).repartitionById(parts, part)
    back = dealt.mapInArrow(tidy(_shared(parts)), DEALT).repartitionById(parts, F.col("part"))
    nodes = materialize(back.mapInArrow(tidy(_linkable(percent)), LINKABLE), "linkable")
    hot.unpersist()
    compact(spark)
    whole = nodes.select("node", "n", "shared")
    groups = nodes.select("gid", "n", "skipped", "prefix").dropDuplicates(["gid"])
    posted = groups.mapInArrow(tidy(_postings), ENTRIES)
    counts = posted.groupBy("list").agg(F.count("*").alias("k")).filter("k > 1").select("list", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"))
    lists = materialize(posted.join(counts, "list").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")).drop("blocks"), "lists")
    ordered = lists.repartition(parts, "list", "block").sortWithinPartitions("list", "block")
    votes = ordered.mapInArrow(tidy(_leaders(percent)), "gid long, leader long, votes long").groupBy("gid", "leader").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("gid").agg(F.max_by("leader", F.struct("votes", "leader")).alias("leader"))
    first = nodes.groupBy("gid").agg(F.min("node").alias("first"), F.count("*").alias("k"))
    inner = nodes.select("gid", "node").join(first.filter("k > 1"), "gid").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    heads = first.select(F.col("gid").alias("g"), F.col("first").alias("b"))
    outer = best.join(first.select("gid", F.col("first").alias("a")), "gid").join(heads, F.col("leader") == F.col("g")).select("a", "b")
    tried = materialize(inner.unionAll(outer), "tried")
    links = materialize(verified(tried, whole, percent), "links")

    # groups of several nodes are lists as well, at place 0
    several = nodes.select("gid", "node", "n").join(first.filter("k > 1").select("gid"), "gid", "left_semi")
    expanded = lists.select("list", "gid", "place", "skipped").join(nodes.select("gid", "node", "n"), "gid").select("list", "node", "n", "place", "skipped")
    expanded = materialize(expanded.unionAll(several.select(F.col("gid").alias("list"), "node", "n", F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("skipped"))), "expanded")
    labels = components(links)
    for choose, one in ((_foreign(percent), True), (_foreign(percent, any_of=True), True), (_all_foreign(percent), False)):
        compact(spark)  # dozens of small jobs each, in JVMs that would else keep all the heap they may have
        todo = _opened(expanded, labels).repartition(parts, "list", "block").sortWithinPartitions("list", "block")
        both = todo.mapInArrow(tidy(_pairs(choose)), PAIRS).groupBy("a", "b").agg(F.sum("votes").alias("votes"))
        done = tried.select("a", "b").unionAll(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.join(done, ["a", "b"], "left_anti")
        if one:
            # one pair for each node: the one that most lists say
            both = both.groupBy("a").agg(F.max_by("b", F.struct("votes", "b")).alias("b"))
        fresh = materialize(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "fresh")
        more = materialize(verified(fresh, whole, percent), "more")
        if more.limit(1).count():
            links = links.unionAll(more)
            labels = components(links)
        tried = tried.unionAll(fresh)
    labels = materialize(labels, "linked")
    drop(nodes, lists, expanded)
    return labels


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, row: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id that links reach); with ``row``, an expression of ``docs``, also ``row`` and ``class``.

    ``class`` is a key of the component, null for an empty set: it also tells apart components without any id.
    """
    names = [] if row is None else ["row"]
    given = docs.select("doc_id", "text", *([] if row is None else [row.alias("row")]))
    kinds = "".join(f", {c} {given.schema[c].dataType.simpleString()}" for c in names)
    sets = materialize(given.mapInArrow(tidy(_sets(size, names)), "doc_id long, n long, node binary" + kinds), "sets")
    nodes = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    labels = linked_nodes(docs, sets.select("n"), size, percent).withColumnRenamed("node", "m")
    # the smallest document of each component; copies are in one node
    classes = materialize(nodes.join(labels, F.col("node") == F.col("m"), "left").select("node", "rep", F.coalesce("label", "node").alias("label")), "classes")
    least = classes.groupBy("label").agg(F.min("rep").alias("component"))
    named = classes.join(least, "label").select("node", "component", "label")
    out = sets.join(named, "node", "left")
    known = lambda c: F.when(c != NO_ID, c)
    more = [] if row is None else ["row", F.col("label").alias("class")]
    return out.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component", "doc_id")).alias("component_id"), *more)
