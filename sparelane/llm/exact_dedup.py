"""Exact deduplication by Patricia-trie owners.

Each scan task folds its rows into a compressed radix trie first, so a text that
fills a third of the corpus leaves a task once. What is left goes to owner
partitions by (length, content hash); an owner inserts whole byte strings into its
own trie, whose terminal nodes hold the group's count and the row that stays. When a
trie outgrows its memory, its largest subtree goes to a temporary file of the task
and is worked off afterwards.

Defined results: a null text counts as empty; a null ``doc_id`` is the last choice as
the row that stays; rows that repeat a ``doc_id`` and text all count towards
``group_size``; columns of the input besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import partitions, tidy

WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of labels that a trie holds before it spills (owners) or is emptied (scan tasks).
TRIE_BYTES = 48 << 20
FOLDED = "nbytes long, h long, key binary, digest string, n long, best_len long, best_id long"
OWNERS = "digest string, keep_id long, keep_len long, group_size long"


def _better(a: list, b: list) -> bool:
    """Whether ``b`` (count, length, id, digest) is to stay rather than ``a``."""
    if b[1] != a[1]:
        return b[1] > a[1]
    return b[2] is not None and (a[2] is None or b[2] < a[2])


class Node:
    __slots__ = ("label", "children", "value", "spill")

    def __init__(self, label: bytes, value: list | None = None):
        self.label, self.value, self.children, self.spill = label, value, {}, None


def _common(label: bytes, key: bytes, pos: int) -> int:
    """Length of the longest common prefix of ``label`` and ``key[pos:]``."""
    lo, hi = 0, min(len(label), len(key) - pos)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[pos + lo : pos + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Byte strings to (count, length, id, digest), the better row winning."""

    def __init__(self, budget: int | None = None):
        self.root, self.held, self.budget = Node(b""), 0, budget

    def insert(self, key: bytes, value: list) -> None:
        node, pos = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[pos:], value), node.spill)
                return
            if pos == len(key):
                self._put(node, value)
                return
            child = node.children.get(key[pos])
            if child is None:
                node.children[key[pos]] = Node(key[pos:], value)
                self.held += len(key) - pos + 200
                break
            if key.startswith(child.label, pos):
                node, pos = child, pos + len(child.label)
                continue
            cut = _common(child.label, key, pos)
            middle = Node(child.label[:cut])
            node.children[key[pos]] = middle
            child.label = child.label[cut:]
            middle.children[child.label[0]] = child
            node, pos = middle, pos + cut
            self.held += 200
        while self.budget and self.held > self.budget and self._spill():
            pass

    @staticmethod
    def _put(node: Node, value: list) -> None:
        old = node.value
        if old is None:
            node.value = value
        elif _better(old, value):
            node.value = [old[0] + value[0], *value[1:]]
        else:
            old[0] += value[0]

    @staticmethod
    def _below(node: Node) -> Iterator[tuple[bytes, list]]:
        stack = [(node, b"")]
        while stack:
            at, prefix = stack.pop()
            if at.value is not None:
                yield prefix, at.value
            stack += [(x, prefix + x.label) for x in at.children.values() if x.spill is None]

    @staticmethod
    def _size(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            at = stack.pop()
            total += len(at.label) + 200
            stack += at.children.values()
        return total

    @staticmethod
    def _whole(node: Node) -> bool:
        """Whether nothing of this subtree is in a file."""
        stack = [node]
        while stack:
            at = stack.pop()
            if at.spill is not None:
                return False
            stack += at.children.values()
        return True

    def _spill(self) -> bool:
        node = self.root
        while len(node.children) == 1 and node.value is None and node.spill is None:
            node = next(iter(node.children.values()))
        free = [x for x in node.children.values() if self._whole(x)]
        if not free:
            return False
        child = max(free, key=self._size)
        self.held -= self._size(child)
        head, rest = child.label[:1], child.label[1:]
        child.spill = tempfile.TemporaryFile()
        for key, value in self._below(child):
            pickle.dump((rest + key, value), child.spill)
        child.label, child.children, child.value = head, {}, None
        return True

    def values(self) -> Iterator[list]:
        """All terminal nodes' values; spilled subtrees one after the other."""
        stack = [self.root]
        while stack:
            at = stack.pop()
            if at.spill is not None:
                at.spill.seek(0)
                sub = PatriciaTrie(self.budget)
                with at.spill as f:
                    while True:
                        try:
                            sub.insert(*pickle.load(f))
                        except EOFError:
                            break
                yield from sub.values()
                continue
            if at.value is not None:
                yield at.value
            stack += at.children.values()

    def items(self) -> Iterator[tuple[bytes, list]]:
        return self._below(self.root)


def _rows(batch: pa.RecordBatch) -> Iterable[tuple]:
    """(id, normalised bytes, code points of the original) of each row."""
    text = pc.fill_null(batch.column("text"), "")
    lengths = pc.utf8_length(text).to_pylist()
    for doc, t, n in zip(batch.column("doc_id").to_pylist(), text.cast(pa.binary()), lengths, strict=True):
        yield doc, t.as_py().translate(None, WHITE), n


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOLDED.split(", ")]

    def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size = 0
        for key, (n, best_len, best_id, digest) in trie.items():
            rows.append((len(key), int(digest[:15], 16), key, digest, n, best_len, best_id))
            size += len(key)
            if size > 4 << 20:
                yield _batch(rows, names)
                rows, size = [], 0
        if rows:
            yield _batch(rows, names)

    trie = PatriciaTrie()
    for batch in batches:
        for doc, key, n in _rows(batch):
            trie.insert(key, [1, n, doc, hashlib.sha256(key).hexdigest()])
            if trie.held > TRIE_BYTES:
                yield from flush(trie)
                trie = PatriciaTrie()
    yield from flush(trie)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    types = {"key": pa.binary(), "digest": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie(TRIE_BYTES)
    for batch in batches:
        columns = [batch.column(k) for k in ("key", "n", "best_len", "best_id", "digest")]
        for key, *value in zip(*columns, strict=True):
            trie.insert(key.as_py(), [x.as_py() for x in value])
    names = [x.split()[0] for x in OWNERS.split(", ")]
    rows: list = []
    for n, best_len, best_id, digest in trie.values():
        rows.append((digest, best_id, best_len, n))
        if len(rows) == 50_000:
            yield _batch(rows, names)
            rows = []
    if rows:
        yield _batch(rows, names)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc, hashlib.sha256(key).hexdigest(), n) for doc, key, n in _rows(batch)]
        if rows:
            yield _batch(rows, ["doc_id", "digest", "n_points"])


def trie_owners(docs: DataFrame) -> DataFrame:
    """One row per distinct normalised text: digest, keep_id, keep_len, group_size."""
    folded = docs.select("doc_id", "text").mapInArrow(tidy(_fold), FOLDED)
    return folded.repartition(partitions(docs.sparkSession), "nbytes", "h").mapInArrow(tidy(_own), OWNERS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical without ``[\\x20\\x09-\\x0D]``; the row with the most code points
    stays, then the smallest doc_id.
    """
    # ids join to owners by content digest; adaptive execution splits a digest that many rows share
    rows = docs.select("doc_id", "text").mapInArrow(tidy(_digests), "doc_id long, digest string, n_points long")
    joined = rows.join(trie_owners(docs).hint("merge"), "digest")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_len"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
