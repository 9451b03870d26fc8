"""Quality classification by importance resampling.

Target and raw text each get a generative model of hashed n-grams: byte n-grams inside a
document, and bigrams of word shapes with whether a word repeats a recent one. A document's
log weight sums log(target / raw) over its n-grams where that falls below ``-CUT`` (truncated
weights: plain text is neutral, and only what the target lacks counts), per ``SCALE`` n-grams.
Keys are log weight plus a Gumbel variable drawn from a hash of doc_id and text, and the k largest
keys are the sample (Gumbel top-k: sampling without replacement by weight).

Both models are fitted on labelled rows, at most ``max_labelled`` of them, those of smallest
hash: raw on all of these, target on the good ones. k is the number of documents whose log
weight reaches a threshold; the threshold parts good from bad labelled rows held out, keeping
``keep`` of the good ones at least. So k follows the corpus. The k-th largest key is found by
refining a histogram, never by a global sort.

Defined results: a null text is empty; a document without n-grams has log weight 0; without
labelled rows of both kinds every document has weight 0 and is kept; a null ``doc_id`` is a
document like any other; rows equal in doc_id and text have equal keys and stay or go together, also
where that makes more than k; a null label is not good; a doc_id labelled twice is good only if both
say so; input columns named log_weight, key or kept give way, __weight and __draw are taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BASE2, BYTE2, IS_WHITE, documents, mix, prefix_hash, range_hash, word_hashes, words
from .scratch import materialize, tidy

BUCKETS = 1 << 20
GRAM = 5
#: Pseudo-counts that draw the ratio of a rare n-gram to one.
PRIOR = 0.5
CUT, SCALE = 1.5, 1000.0
RECENT = 8
#: Columns that :func:`resample` adds; an input column of such a name gives way.
WEIGHT, KEY, KEPT = "log_weight", "key", "kept"
CLASS = np.zeros(256, np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58], CLASS[128:] = 1, 2, 3, 2
CLASS[33:48] = CLASS[58:65] = CLASS[91:97] = CLASS[123:127] = 4


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, and each document's bounds among them."""
    n = len(data)
    parts, where = [], []
    if n >= GRAM:
        at = np.arange(n - GRAM + 1)
        h = (range_hash(prefix_hash(BYTE2[data], BASE2), at, at + GRAM, BASE2) % np.uint64(BUCKETS)).astype(np.int32)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        inside = doc[: n - GRAM + 1] == doc[GRAM - 1 :]
        parts.append(h[inside])
        where.append(doc[: n - GRAM + 1][inside])
    starts, ends, bounds = words(data, offsets)
    if len(starts):
        w = word_hashes(data, starts, ends)
        first, second, last = CLASS[data[starts]], CLASS[data[np.minimum(starts + 1, ends - 1)]], CLASS[data[ends - 1]]
        shape = ((first * 8 + second) * 8 + last).astype(np.uint64) * np.uint64(16) + np.minimum(ends - starts, 15).astype(np.uint64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        same = np.zeros(len(w), np.uint64)
        for k in range(RECENT, 0, -1):
            hit = (w[k:] == w[:-k]) & (doc[k:] == doc[:-k])
            same[k:][hit] = k
        h = mix(shape * np.uint64(64) + same * np.uint64(4) + np.uint64(1))
        before = np.zeros_like(h)
        before[1:] = np.where(doc[1:] == doc[:-1], h[:-1], np.uint64(0))
        parts.append((mix(h + before * np.uint64(3)) % np.uint64(BUCKETS)).astype(np.int32))
        where.append(doc)
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(where)


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id, text, good, held (kept for the threshold) of the rows to fit on."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    rows = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("good"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h", "doc_id").limit(max_labelled)
    # bounded by max_labelled, so this join may broadcast
    chosen = materialize(rows.select("doc_id", "good", (F.pmod("h", F.lit(10)) < 3).alias("held")), "labelled")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse counts of a task's documents: bucket, n in all and in good ones."""
    total, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        flags, at = np.array(batch.column("good").to_pylist(), bool), 0
        for ids, data, offsets in documents([batch]):
            b, w = grams(data, offsets)
            total += np.bincount(b, minlength=BUCKETS)
            good += np.bincount(b[flags[at : at + len(ids)][w]], minlength=BUCKETS)
            at += len(ids)
    hit = np.flatnonzero(total)
    for i in range(0, len(hit), 100_000):
        k = hit[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k]), pa.array(good[k])], ["bucket", "n", "good"])


def score(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    b, w = grams(data, offsets)
    n = len(offsets) - 1
    return np.bincount(w, table[b], n) * SCALE / (np.bincount(w, minlength=n) + SCALE)


def _scored(docs: DataFrame, table: np.ndarray, columns: list[str]) -> DataFrame:
    names = columns
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", __weight double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, data, offsets in documents([batch]):
                part = batch.slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(score(shared.value, data, offsets))], [*names, "__weight"])

    return docs.select(*dict.fromkeys([*names, "doc_id", "text"])).mapInArrow(tidy(run), schema)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, keep: float = 0.99) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold of the log weight."""
    rows = _labelled(docs, labels, max_labelled)
    counts = rows.filter("not held").mapInArrow(tidy(_count), "bucket int, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("n").to_numpy(), counts.column("good").to_numpy()
    if not target.any() or target.sum() == raw.sum():
        return np.zeros(BUCKETS, np.float32), -np.inf
    ratio = np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))
    table = np.where(ratio < -CUT, ratio, 0).astype(np.float32)
    held = _scored(rows.filter("held"), table, ["good"]).toArrow()
    good, weight = held.column("good").to_numpy(zero_copy_only=False), held.column("__weight").to_numpy()
    return table, threshold(weight[good], weight[~good], keep)


def threshold(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """Between the two kinds where least of either is on the wrong side, keeping ``keep`` of the good ones."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    error = np.where(lost <= 1 - keep, lost + 1 - np.searchsorted(bad, cuts) / len(bad), np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(cuts[best].mean())


#: A column of the scan that the operator adds for itself, beside ``__weight``.
DRAW = "__draw"


def gumbel() -> F.Column:
    u = (F.pmod(F.col(DRAW), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, few: int = 5000, bins: int = 2000) -> float:
    """The k-th largest of the column ``key``: a histogram refined until few values are left to sort."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        if low == high:
            return low
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).alias("at")
        found = sorted(((r.at, r.n, r.low, r.high) for r in inside.groupBy(at).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()), reverse=True)
        for _, n, low, high in found:  # noqa: B007
            if above + n >= k:
                break
            above += n
        if n <= few:
            left = sorted((r.key for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
            return left[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000, keep: float = 0.99, seed: int = 17, columns: list[str] | None = None) -> DataFrame:
    """Every row with doc_id, log_weight, key and kept; ``columns`` of the input go along."""
    table, least = fit(docs, labels, max_labelled, keep)
    names = list(dict.fromkeys(["doc_id", *(c for c in columns or [] if c not in (WEIGHT, KEY, KEPT))]))
    docs = docs.withColumn(DRAW, F.xxhash64("doc_id", "text", F.lit(seed)))
    key = (F.col("__weight") + gumbel()).alias(KEY)
    keys = materialize(_scored(docs, table, ["doc_id", DRAW]).select("doc_id", F.col("__weight").alias(WEIGHT), key), "keys")
    k = keys.filter(F.col(WEIGHT) >= least).count()
    edge = kth_largest(keys, k) if k else np.inf
    # columns are scored once more rather than joined: no shuffle of texts
    rows = keys if names == ["doc_id"] else _scored(docs, table, [*names, DRAW]).select(*names, F.col("__weight").alias(WEIGHT), key)
    return rows.withColumn(KEPT, F.col(KEY) >= F.lit(float(edge)))
