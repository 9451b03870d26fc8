"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy.

The network predicts every token from the ``WINDOW`` tokens on either side of it: their
embeddings, scaled by position, are added and squashed. The probability is a product along a Huffman
tree of the vocabulary: a softmax over the ``TOP`` subtrees below its top, then a logistic choice at each
node on the way to the word. It sums to one over the vocabulary, and a token's cost grows with the
entropy of the words, not with their number. A document's score is the sum of these conditional
log-probabilities over its tokens (pseudo-log-likelihood), and its mean.

Word counts over all documents make the vocabulary: every word that occurs ``MIN_COUNT`` times,
and of a small corpus the most frequent words; hash buckets for the others. It grows with the
corpus. Ids are looked up once and kept as a table. Training goes over every document once,
in ``ROUNDS`` rounds by a hash of the row; in each, parts of about ``PART`` documents (by hash too,
in order of it) are trained on from the shared parameters, and what they changed is averaged by tokens in
pieces, in trees of tasks; a part sends only the parameters that its words moved: scores don't depend on how the input is laid out. Only the
vocabulary and one set of parameters reach the driver.

Defined results: a null or empty text has no tokens and score 0, mean null; a neighbour
beyond the text is a padding token; a null ``doc_id`` is scored like any other, and rows that repeat
one each for themselves, equal texts alike; other columns are ignored, whatever their names; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, documents, word_hashes, words
from .scratch import materialize, tidy

#: Ids at least.
VOCABULARY = 4096
#: Occurrences from which a word has an id of its own in any corpus.
MIN_COUNT = 50
#: Hash buckets among the ids at least, for words without their own, and words for each bucket more.
BUCKETS, WORDS_PER_BUCKET = 256, 32
#: Subtrees below the top of the tree.
TOP = 64
WINDOW, DIM = 2, 24
OFFSETS = [o for o in range(-WINDOW, WINDOW + 1) if o]
#: The last row of the embeddings.
PAD = -1
ROUNDS, BATCH, RATE = 2, 8192, 0.01
#: Documents of a training part: some 100 MB of text, as in other tasks, since every part sends the parameters of its words.
PART = 1 << 16
#: Parameters in a row of a table.
PIECE = 1 << 18
#: Rows of a product of matrices in scores come to a multiple of this.
TILE = 256
#: Rows that the optimiser moves at once, which stay in the cache.
SOME = 512
#: Logits are cut to this size, so that their exponentials need no maximum taken off.
BOUND = 40.0


def shapes(size: int) -> dict[str, tuple[int, ...]]:
    return {"E": (size + 1, DIM), "A": (len(OFFSETS), DIM), "b": (DIM,), "C": (DIM, TOP), "c": (TOP,), "N": (size - 1, DIM + 1)}


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and each document's bounds among them."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    return word_hashes(data, starts, ends).view(np.int64) if len(starts) else np.zeros(0, np.int64), bounds


class Tree:
    """Huffman tree of the ids: the subtree of each, and the nodes from there to it.

    ``nodes[starts[i]:starts[i + 1]]`` are those of id i, as twice the node plus the branch.
    """

    def __init__(self, weights: np.ndarray):
        size = len(weights)
        order = np.argsort(weights, kind="stable")
        leaves, made, parent, branch = weights[order].tolist(), [], np.zeros(2 * size - 1, np.int64), np.zeros(2 * size - 1, np.int64)
        i = j = 0
        pairs = []
        for _ in range(size - 1):  # the two lightest of the leaves and nodes left, both in order of weight
            both = []
            for _ in range(2):
                if j >= len(made) or i < size and leaves[i] <= made[j]:
                    both.append((leaves[i], i))
                    i += 1
                else:
                    both.append((made[j], size + j))
                    j += 1
            made.append(both[0][0] + both[1][0])
            pairs.append((both[0][1], both[1][1]))
        pairs = np.array(pairs)
        name = np.concatenate([order, np.arange(size, 2 * size - 1)])
        for k in (0, 1):
            parent[name[pairs[:, k]]] = np.arange(size, 2 * size - 1)
            branch[name[pairs[:, k]]] = k
        top = 2 * size - TOP  # the last TOP - 1 nodes hang together at the root
        parent[-1] = 2 * size
        below = np.flatnonzero((parent >= top) & (np.arange(2 * size - 1) < top))
        now, at, steps = np.arange(size), np.arange(size), []
        while len(now):
            inside = parent[now] < top
            now, at = now[inside], at[inside]
            steps.append((at, 2 * (parent[now] - size) + branch[now]))
            now = parent[now]
        leaf, node = (np.concatenate(x) for x in zip(*steps, strict=True))
        by = np.argsort(leaf, kind="stable")
        leaf, node = leaf[by], node[by]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=size))])
        self.depth = np.diff(self.starts).astype(np.uint16)
        end = np.arange(size)
        for at, _ in steps:
            end[at] = parent[end[at]]
        self.subtree = np.searchsorted(below, end).astype(np.uint8)
        # nodes of a subtree have neighbouring numbers, from cuts[subtree] on; those of the top are the last
        of = np.full(size - 1, TOP)
        of[node >> 1] = self.subtree[leaf]
        number = np.empty(size - 1, np.int64)
        number[np.argsort(of, kind="stable")] = np.arange(size - 1)
        self.cuts = np.searchsorted(np.sort(of), np.arange(TOP + 1))
        self.nodes = (2 * number[node >> 1] + (node & 1)).astype(np.int32)


class Vocabulary:
    """Word hashes in order of their ids; other words share the ids after them, ``BUCKETS`` at least."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray | None = None, rest: int = 0):
        self.order, self.n = np.argsort(hashes.view(np.uint64)), len(hashes)
        self.sorted = hashes[self.order]
        # where hashes with the same leading bits begin; there are a few of each at most
        self.shift = np.uint64(63 - max(8, self.n.bit_length()))
        lead = (self.sorted.view(np.uint64) >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(lead, np.arange((1 << 64 - int(self.shift)) + 1)).astype(np.int32)
        self.size = max(VOCABULARY, self.n + BUCKETS + max(0, self.n + BUCKETS - VOCABULARY) // WORDS_PER_BUCKET)
        buckets = self.size - self.n
        counts = np.ones(self.n, np.int64) if counts is None else counts
        self.tree = Tree(np.concatenate([counts, np.full(buckets, max(1, rest // buckets))]))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        other = self.n + (hashes.view(np.uint64) % np.uint64(self.size - self.n)).astype(np.int64)
        lead = (hashes.view(np.uint64) >> self.shift).astype(np.int64)
        at, end, left = self.begin[lead], self.begin[lead + 1], np.arange(len(hashes))
        while len(left):
            more = at < end
            at, end, left = at[more], end[more], left[more]
            same = self.sorted[at] == hashes[left]
            other[left[same]] = self.order[at[same]]
            at, end, left = at[~same] + 1, end[~same], left[~same]
        return other


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def send(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000]), pa.array(n[i : i + 100_000])], ["h", "n"])

    for _, data, offsets in documents(batches):
        held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
        if len(held) == 32:
            held = [fold()]
            if len(held[0][0]) > 1_000_000:
                yield from send(*held.pop())
    if held:
        yield from send(*fold())


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The words of all documents that occur ``MIN_COUNT`` times; the most frequent if those are few."""
    counts = materialize(docs.select("doc_id", "text").mapInArrow(tidy(_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    top = counts.filter(F.col("n") >= MIN_COUNT).toArrow()
    if top.num_rows < VOCABULARY - BUCKETS:
        top = counts.orderBy(F.desc("n"), "h").limit(VOCABULARY - BUCKETS).toArrow()
    h, n = (top.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    by, every = np.lexsort((h, -n)), counts.agg(F.sum("n")).first()[0] or 0
    return Vocabulary(h[by], n[by], every - int(n.sum()))


def initial(size: int = VOCABULARY, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    scale = {"E": 0.3, "C": 0.1, "N": 0.1}
    out = {k: (r.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes(size).items()}
    out["A"] += 1
    out["N"][:, DIM] = 0
    return out


def pack(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in shapes(VOCABULARY))


def unpack(b: bytes, size: int) -> dict[str, np.ndarray]:
    flat, at, out = np.frombuffer(b, np.float32), 0, {}
    for k, s in shapes(size).items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return out


def padded(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``WINDOW`` of ``PAD`` around each document, and the place of each token."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(len(ids)) + WINDOW * (doc + 1)
    seq = np.full(len(ids) + WINDOW * len(bounds), PAD, np.int64)
    seq[at] = ids
    return seq, at


def blocks(seq: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``BATCH`` tokens at a time, with the neighbours on both sides."""
    for i in range(0, len(at), BATCH):
        here = at[i : i + BATCH]
        first = here[0] - WINDOW
        yield seq[first : here[-1] + WINDOW + 1], here - first


def _softmax(x: np.ndarray, target: np.ndarray, scale: float) -> np.ndarray:
    """Log-probability of each row's target; with ``scale``, the gradient of its negative times that."""
    rows = np.arange(len(x))
    np.clip(x, -BOUND, BOUND, out=x)
    of = x[rows, target]
    np.exp(x, out=x)
    total = x.sum(1)
    if not scale:
        return (of - np.log(total)).astype(np.float64)
    x *= (scale / total)[:, None].astype(x.dtype)
    x[rows, target] -= scale
    return x


def _seen(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (rows of an array of ``size``), sorted, and the place of each key among them."""
    seen = np.zeros(size, bool)
    seen[keys] = True
    rows = np.flatnonzero(seen)
    place = np.empty(size, np.int64)
    place[rows] = np.arange(len(rows))
    return rows, place.take(keys, mode="wrap")


def _sums(at: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    """The sums of the values of each of ``size`` places, given a column at a time."""
    out = np.empty((size, len(columns)), columns.dtype)
    for k, column in enumerate(columns):  # a column and its sums stay in the cache
        out[:, k] = np.bincount(at, column, size)
    return out


def _paths(tree: Tree, ids: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The codes of the nodes on the path of each id, one path after another."""
    depth = depth.astype(np.int64)
    return tree.nodes.take(np.repeat(tree.starts[ids] - np.cumsum(depth) + depth, depth) + np.arange(int(depth.sum())))


def _descend(weights: np.ndarray, tree: Tree, ids: np.ndarray, one: np.ndarray, scale: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Gradients of the logistic choices by ``one`` (tokens in order of subtree) and by the rows of N.

    The tokens of a subtree meet all of its nodes that any of them passes in one product of matrices, of
    which each token's own path is used.
    """
    depth, subtree = tree.depth[ids], tree.subtree[ids]
    code = _paths(tree, ids, depth)
    rows, at = _seen(code >> 1, len(weights))
    w, sign = weights.take(rows, axis=0), ((code & 1) * 2 - 1).astype(one.dtype)
    across = np.ascontiguousarray(w.T)
    t, r = np.searchsorted(subtree, np.arange(TOP + 1)), np.searchsorted(rows, tree.cuts)
    wide = np.diff(r)
    b = np.concatenate([[0], np.cumsum(np.diff(t) * wide)])
    # where the token's row of its subtree's matrix begins, less the first node's place
    begin = b[subtree] + (np.arange(len(ids)) - t[subtree]) * wide[subtree] - r[subtree]
    at += np.repeat(begin, depth)
    flat = np.empty(b[-1], one.dtype)
    t, r, b = t.tolist(), r.tolist(), b.tolist()
    groups = [(slice(t[k], t[k + 1]), slice(r[k], r[k + 1]), flat[b[k] : b[k + 1]].reshape(t[k + 1] - t[k], r[k + 1] - r[k])) for k in range(TOP) if b[k] < b[k + 1]]
    for some, nodes, m in groups:
        np.matmul(one[some], across[:, nodes], out=m)
    x = flat.take(at)
    x *= sign
    q = np.exp(-np.clip(x, -BOUND, BOUND, out=x))
    flat.fill(0)
    flat[at] = sign * q / (1 + q) * one.dtype.type(-scale)
    back, sums = np.zeros_like(one), np.empty_like(w)
    for some, nodes, m in groups:
        np.matmul(m, w[nodes], out=back[some])
        np.matmul(m.T, one[some], out=sums[nodes])
    return back, (rows, sums)


def forward(p: dict[str, np.ndarray], tree: Tree, seq: np.ndarray, at: np.ndarray, grads: dict | None = None) -> np.ndarray | None:
    """log p(token | both sides) of each token; or sets ``grads`` to the gradient of minus their mean, of E and N as (rows, values)."""
    scale = 1 / len(at) if grads is not None else 0.0
    count = tree.depth[seq[at]]
    # longest paths first, so that those that go on at a depth are the first rows; where gradients are wanted, by subtree
    order = np.argsort(tree.subtree[seq[at]] if scale else np.uint16(65535) - count, kind="stable")
    at, count = at[order], count[order]
    ids, m = seq[at], len(seq) - WINDOW
    if scale:
        rows, place = _seen(seq, len(p["E"]))
        near = p["E"].take(rows, axis=0).take(place, axis=0)
    else:
        near = p["E"].take(seq, axis=0, mode="wrap")
    z = near[: m - WINDOW] * p["A"][0]
    for o, a in zip(OFFSETS[1:], p["A"][1:], strict=True):
        z += near[WINDOW + o : m + o] * a
    z += p["b"]
    h = np.tanh(z.take(at - WINDOW, axis=0))
    # on whole tiles of rows: a row's product doesn't depend on how many others there are
    x = (h if scale else np.concatenate([h, np.zeros((-len(h) % TILE, DIM), h.dtype)])) @ p["C"]
    x = x[: len(h)]
    top = _softmax(x + p["c"], tree.subtree[ids], scale)
    one = np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)  # the last column of N is a constant
    if not scale:
        going = len(at) - np.cumsum(np.bincount(count))[:-1]
        first = tree.starts[ids]
        odds = np.ones(len(at))  # one over the product of the nodes' probabilities
        for depth, k in enumerate(going.tolist()):
            code = tree.nodes.take(first[:k] + depth)
            node, sign = code >> 1, ((code & 1) * 2 - 1).astype(h.dtype)
            x = np.einsum("nd,nd->n", one[:k], p["N"].take(node, axis=0)) * sign
            q = np.exp(-np.clip(x, -BOUND, BOUND, out=x))
            odds[:k] *= 1 + q.astype(np.float64)
            if depth % 16 == 15:  # beyond, the product could leave the range
                top[:k] -= np.log(odds[:k])
                odds[:k] = 1
        out = np.empty_like(top)
        out[order] = top - np.log(odds)
        return out
    dh, grads["N"] = _descend(p["N"], tree, ids, one, scale)
    dh = dh[:, :DIM] + top @ p["C"].T
    grads["C"], grads["c"] = h.T @ top, top.sum(0)
    dz = np.zeros((m - WINDOW, DIM), h.dtype)
    dz[at - WINDOW] = dh * (1 - h * h)
    grads["b"], grads["A"] = dz.sum(0), np.empty_like(p["A"])
    back = np.zeros_like(near)
    for k, o in enumerate(OFFSETS):
        grads["A"][k] = np.einsum("nd,nd->d", dz, near[WINDOW + o : m + o])
        back[WINDOW + o : m + o] += dz * p["A"][k]
    grads["E"] = (rows, _sums(place, np.ascontiguousarray(back.T), len(rows)))
    return None


class Trainer:
    """Adam over batches of tokens; the rows of E and N move in batches that touch them."""

    def __init__(self, p: dict[str, np.ndarray], tree: Tree):
        self.p, self.tree, self.step, self.seen = p, tree, 0, 0
        self.m, self.v = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    @staticmethod
    def _move(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: np.float32) -> None:
        step = g - m
        step *= np.float32(0.1)
        m += step
        np.multiply(g, g, out=step)
        step -= v
        step *= np.float32(0.01)
        v += step
        np.sqrt(v, out=step)
        step += np.float32(1e-6)
        np.divide(m, step, out=step)
        step *= rate
        p -= step

    def _rows(self, k: str, rows: np.ndarray, g: np.ndarray, rate: np.float32) -> None:
        every = self.p[k], self.m[k], self.v[k]
        for i in range(0, len(rows), SOME):
            some = rows[i : i + SOME]
            held = [x.take(some, axis=0) for x in every]
            self._move(*held, g[i : i + SOME], rate)
            for x, y in zip(every, held, strict=True):  # a row as one item, which is faster to put
                row = f"V{x.itemsize * x.shape[1]}"
                x.view(row)[:, 0][some] = y.view(row)[:, 0]

    def learn(self, seq: np.ndarray, at: np.ndarray) -> None:
        for near, here in blocks(seq, at):
            grads: dict = {}
            forward(self.p, self.tree, near, here, grads)
            self.step += 1
            rate = np.float32(RATE * np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step))
            for k, g in grads.items():
                if isinstance(g, tuple):
                    self._rows(k, *g, rate)
                else:
                    self._move(self.p[k], self.m[k], self.v[k], g, rate)
            self.seen += len(here)


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, h (a hash of the row) and the ids of its words, 32 bits each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for whole in batches:
            seen = 0
            for docs_, data, offsets in documents([whole.select(["doc_id", "text"])]):
                h, bounds = tokens(data, offsets)
                ids = vocab.ids(h).astype(np.int32) if len(h) else np.zeros(0, np.int32)
                at = (4 * bounds).tolist()
                flat = ids.tobytes()
                said = pa.array([flat[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), whole.column("h").slice(seen, len(docs_)), said], ["doc_id", "h", "ids"])
                seen += len(docs_)

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(tidy(run), "doc_id long, h long, ids binary")


def _sequences(batches: Iterable[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, ids and bounds of some documents at a time: about ``most`` tokens, or one document."""
    for batch in batches:
        rows, size, held = batch.column("ids"), 0, 0
        docs, n = batch.column("doc_id").to_pylist(), np.array([len(x.as_buffer()) // 4 for x in rows], np.int64)
        for i in range(batch.num_rows):
            size += int(n[i])
            if size >= most or i == batch.num_rows - 1:
                flat = b"".join(x.as_py() for x in rows.slice(held, i + 1 - held))
                yield docs[held : i + 1], np.frombuffer(flat, np.int32).astype(np.int64), np.concatenate([[0], np.cumsum(n[held : i + 1])])
                size, held = 0, i + 1


PIECES = "piece int, task int, params binary, n long"


def _pieces(rows: Iterable[tuple[int, int, bytes, int]]) -> Iterator[pa.RecordBatch]:
    for piece, task, params, n in rows:
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([task], pa.int32()), pa.array([params], pa.binary()), pa.array([n], pa.int64())], ["piece", "task", "params", "n"])


def _packed(change: np.ndarray) -> bytes:
    """What of a piece isn't 0: a bit for each number, then those that have theirs set."""
    moved = change != 0
    return np.packbits(moved).tobytes() + change[moved].astype(np.float32).tobytes()


def _add(total: np.ndarray, packed: bytes, weight: float) -> None:
    moved = np.unpackbits(np.frombuffer(packed, np.uint8, -(-len(total) // 8)), count=len(total)).astype(bool)
    total[moved] += np.frombuffer(packed, np.float32, offset=-(-len(total) // 8)).astype(np.float64) * weight


def _average(fan_in: int, size: int):
    """Mean changes of ``fan_in`` neighbouring parts at a time; rows come sorted, so that sums don't depend on where they were made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, seen = None, np.zeros(0), 0
        for batch in batches:
            for piece, task, b, n in zip(batch.column("piece").to_pylist(), batch.column("task").to_pylist(), batch.column("params"), batch.column("n").to_pylist(), strict=True):
                if key != (piece, task // fan_in):
                    if seen:
                        yield from _pieces([(*key, _packed(total / seen), seen)])
                    key, total, seen = (piece, task // fan_in), np.zeros(min(PIECE, size - piece * PIECE)), 0
                _add(total, b.as_py(), n)
                seen += n
        if seen:
            yield from _pieces([(*key, _packed(total / seen), seen)])

    return run


def train(docs: DataFrame, vocab: Vocabulary, fan_in: int = 32) -> dict[str, np.ndarray]:
    """Parameters after one pass over all documents (``encoded``), which are dealt by hash, so that the layout of the input doesn't matter."""
    spark = docs.sparkSession
    parts = max(1, -(-docs.count() // PART))
    now = pack(initial(vocab.size))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast((now, vocab))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, vocab = shared.value
            trainer = Trainer(unpack(start, vocab.size), vocab.tree)
            for _, ids, bounds in _sequences(batches):
                if len(ids):
                    trainer.learn(*padded(ids, bounds))
            if trainer.seen:
                change, task = np.frombuffer(pack(trainer.p), np.float32) - np.frombuffer(start, np.float32), TaskContext.get().partitionId()
                yield from _pieces((i // PIECE, task, _packed(change[i : i + PIECE]), trainer.seen) for i in range(0, len(change), PIECE) if change[i : i + PIECE].any())

        mine = docs.filter(F.pmod("h", F.lit(ROUNDS)) == turn).repartitionById(parts, F.pmod(F.shiftright("h", 8), F.lit(parts)).cast("int"))
        rows, n = mine.sortWithinPartitions("h", "doc_id").mapInArrow(tidy(run), PIECES), parts
        while True:
            by = F.floor(F.col("task") / fan_in)
            rows = rows.repartition("piece", by).sortWithinPartitions("piece", "task").mapInArrow(tidy(_average(fan_in, len(now) // 4)), PIECES)
            rows, n = materialize(rows, "params"), -(-n // fan_in)
            if n == 1:
                break
        # pieces that a part didn't move came from the others only
        every = rows.agg(F.max("n")).first()[0] or 0
        moved = np.frombuffer(now, np.float32).astype(np.float64)
        for r in rows.select("piece", "params", "n").toLocalIterator():
            _add(moved[r.piece * PIECE : (r.piece + 1) * PIECE], bytes(r.params), r.n / every)
        now = moved.astype(np.float32).tobytes()
        shared.unpersist()
    return unpack(now, vocab.size)


def score_documents(docs: DataFrame, vocab: Vocabulary, p: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, pll (sum of conditional log-probabilities), pll_mean of ``encoded`` documents."""
    shared = docs.sparkSession.sparkContext.broadcast((pack(p), vocab))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value[1]
        p = unpack(shared.value[0], vocab.size)
        for docs_, ids, bounds in _sequences(batches):
            n = np.diff(bounds)
            total = np.zeros(len(docs_))
            if len(ids):
                said = np.concatenate([forward(p, vocab.tree, *block) for block in blocks(*padded(ids, bounds))])
                total = np.bincount(np.repeat(np.arange(len(n)), n), said, len(n))
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(n.astype(np.int64)), pa.array(total), mean], ["doc_id", "n_tokens", "pll", "pll_mean"])

    return docs.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, n_tokens long, pll double, pll_mean double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    vocab = vocabulary(docs)
    ids = materialize(encoded(docs, vocab), "ids")
    return score_documents(ids, vocab, train(ids, vocab))
