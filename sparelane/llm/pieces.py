"""SentencePiece encoding and decoding as a weighted finite-state transducer.

An input is composed lazily with the pieces (a state for the piece read last, an arc for each
piece that may follow) and the byte fallback (arcs of byte pieces for a character without a piece) as
a lattice over its characters, and its ids are the labels of the shortest path in the tropical
semiring. Arcs are looked up when the composition reaches them, no machine is written out; the
normaliser (a precompiled character map, dummy prefix, squeezed and escaped blanks) rewrites the text before: the
map is compiled into a transducer over characters, of which the longest path from each place counts.

Weights: in a unigram model an arc costs minus its piece's score. In a merge (BPE) model an
arc costs nothing if merging leaves its piece and the one before as they are, and is
infinite otherwise; then one path is finite, the one that merging finds.

Because no piece holds a blank after another character, paths of blank-led units are
independent; each distinct unit is searched once and kept in a bounded table of the worker.

Defined results: a null or empty text has no tokens and decodes to the empty text; a text
with U+2581 itself decodes to blanks there, as the format wants; rows are independent; input
columns named n_tokens, token_ids or round_trip give way. A text that the character map changes decodes
to what the map makes of it. Models with a piece that holds a blank after another character, or with
both a character map and pieces that users defined, are refused with a ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scratch import KEPT, tidy

BLANK = "▁"
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
INF = float("inf")
#: Distinct units whose ids a worker keeps, and pairs of pieces whose verdict it keeps: some tens of MB, since it waits beside the JVM.
KEPT_UNITS = KEPT_PAIRS = 250_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = b[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(b):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, b[at : at + n]
            at += n


class CharacterMap:
    """The normaliser's transducer: ``arcs[state]`` leads on by character, ``said[state]`` is what a path ending there becomes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.arcs: list[dict[str, int]] = [{}]
        self.said: list[str | None] = [None]
        for key, value in self._rules(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]):
            state = 0
            for c in key:
                state = self.arcs[state].setdefault(c, len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append({})
                    self.said.append(None)
            self.said[state] = value
        chars = lambda x: "[" + "".join(map(re.escape, sorted(x))) + "]" if x else "(?!)"
        alone = {c for c, state in self.arcs[0].items() if self.said[state] is not None}
        more = {c for c, state in self.arcs[0].items() if self.arcs[state]}
        # the places where a path can end
        self.places = re.compile(f"{chars(alone)}|{chars(more)}(?={chars({c for s in self.arcs[0].values() for c in self.arcs[s]})})")

    @staticmethod
    def _rules(units: np.ndarray, texts: bytes) -> Iterator[tuple[str, str]]:
        """The keys of a double-array trie (its units as the format packs them), found level by level, with their values."""
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        at, keys, labels = step(units[:1]).astype(np.int64), [b""], np.arange(1, 256)
        while len(at):
            child = at[:, None] ^ labels
            unit = units[np.minimum(child, len(units) - 1)]
            row, c = np.nonzero((child < len(units)) & ((unit & np.uint32(0x800000FF)) == labels))
            unit = unit[row, c]
            at = child[row, c] ^ step(unit).astype(np.int64)
            keys = [keys[r] + bytes([x]) for r, x in zip(row.tolist(), labels[c].tolist(), strict=True)]
            ends = (unit >> 8 & 1).astype(bool)
            values = units[np.minimum(at, len(units) - 1)] & 0x7FFFFFFF
            for i in np.flatnonzero(ends).tolist():
                v = int(values[i])
                yield keys[i].decode(), texts[v : texts.index(b"\0", v)].decode()

    def rewrite(self, text: str) -> str:
        """The text with the longest path from each place, in order, replaced by what it becomes."""
        out, done, arcs, said = [], 0, self.arcs, self.said
        for m in self.places.finditer(text):
            i = m.start()
            if i < done:
                continue
            state, j, end, becomes = 0, i, 0, None
            while j < len(text) and (state := arcs[state].get(text[j], -1)) >= 0:
                j += 1
                if said[state] is not None:
                    end, becomes = j, said[state]
            if becomes is not None:
                out += [text[done:i], becomes]
                done = end
        return "".join([*out, text[done:]]) if out else text


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, norm = UNIGRAM, {}
        for field, value in _fields(model):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
            elif field == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
        if kind not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        if norm.get(2) and any(k == USER for _, _, k in self.pieces):
            raise ValueError("a character map leaves pieces alone that users defined; it is not supported beside them")
        self.map = CharacterMap(norm[2]) if norm.get(2) else None
        self.merges = kind == MERGES
        self.dummy, self.squeeze, self.escape = norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.score = {p: s for p, s, k in self.pieces if k in (NORMAL, USER)}
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        found = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.bytes = [found[i] for i in range(256)] if len(found) == 256 else None
        self.longest = max(map(len, self.ids), default=1)
        self.unknown_cost = 10 - min(self.score.values(), default=0)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character")
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.units = re.compile(f"{BLANK}+[^{BLANK}{line}]*|[^{BLANK}{line}]+" + "|\n" * bool(line))
        self.table = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() for p, _, k in self.pieces]
        self.kept: dict[str, bytes] = {}
        if self.merges:
            self._derive()

    def normalise(self, text: str) -> str:
        if self.map:
            text = self.map.rewrite(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = " " * self.dummy + text
        return text.replace(" ", BLANK) if self.escape else text

    # merge models: which pieces may follow each other

    def _merge(self, parts: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
        """Merge best first, leftmost of equals; the parts left and the merges done."""
        done = []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, done
            done.append((parts[at], parts[at + 1]))
            parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2 :]

    def _derive(self) -> None:
        """For each piece that merging makes: the tokens that stand at its left and right edge in turn, with their scores."""
        halves: dict[str, tuple[str, str] | None] = {}
        plain: dict[str, bool] = {}
        for p in sorted(self.ids, key=len):
            if len(p) == 1:
                halves[p], plain[p] = None, True
                continue
            parts, done = self._merge(list(p))
            if len(parts) > 1:
                del self.ids[p]
                continue
            halves[p] = done[-1]
            # merging goes by falling score inside it, so that scores are times
            scores = [self.score[a + b] for a, b in done]
            plain[p] = all(a >= b for a, b in zip(scores, scores[1:], strict=False)) and scores.count(-1e9) == 0
        self.plain = plain
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        for edge, side in ((self.left, 0), (self.right, 1)):
            for p, h in halves.items():
                edge[p] = [*edge[h[side]], (p, self.score[p])] if h else [(p, INF)]
        self.name = {i: p for p, i in self.ids.items()}
        self.may: dict[int, bool] = {}
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # states of the pieces' machine by what was read: the piece that ends there, or -1
        self.heads = {p[:i]: -1 for p in self.ids for i in range(1, len(p))} | self.ids

    def follows(self, a: str, b: str) -> bool:
        """Whether merging leaves ``a`` before ``b`` as they are."""
        if not (self.plain[a] and self.plain[b]):
            return self._merge(list(a + b))[0] == [a, b]
        x, y, i, j, get = self.right[a], self.left[b], 0, 0, self.score.get
        while True:
            across = get(x[i][0] + y[j][0], -INF)
            more_a = x[i + 1][1] if i + 1 < len(x) else -INF
            more_b = y[j + 1][1] if j + 1 < len(y) else -INF
            if across > more_a and across >= more_b:
                return False
            if more_a == more_b == -INF:
                return True
            if more_a >= more_b:
                i += 1
            else:
                j += 1

    def _compare(self, a: int, b: int) -> bool:
        if len(self.may) > KEPT_PAIRS:
            self.may.clear()
        known = self.may[a << 32 | b] = self.follows(self.name[a], self.name[b])
        return known

    # composition with an input and its shortest path

    def _parts(self, unit: str) -> list[str]:
        """``unit`` cut between two characters that no piece holds side by side: paths never cross there."""
        beside, out, at = self.beside, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in beside:
                out.append(unit[at:i])
                at = i
        out.append(unit[at:])
        return out

    def path(self, unit: str) -> bytes:
        """The ids of the shortest path through one unit, as 32-bit integers."""
        if self.merges:
            parts = self._parts(unit)
            if len(parts) > 1:
                return b"".join(self._kept(x) for x in parts)
        return array("i", self._finite(unit) if self.merges else self._cheapest(unit)).tobytes()

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[c] for c in char.encode()] if self.bytes else [self.unknown]

    def _finite(self, unit: str) -> list[int]:
        """The one path of finite weight, longest arcs first.

        One path at most of finite weight leads to a place, so a place that it can't leave is never tried again.
        """
        n, get, may = len(unit), self.heads.get, self.may.get
        places, taken, dead = [0], [-1], bytearray(n + 1)
        while places[-1] < n:
            i, a, ends = places[-1], taken[-1], []
            for e in range(i + 1, n + 1):
                b = get(unit[i:e])
                if b is None:
                    break
                if b >= 0 and not dead[e]:
                    ends.append((e, b))
            for e, b in reversed(ends):
                if a >= 0:
                    fine = may(a << 32 | b)
                    if not (self._compare(a, b) if fine is None else fine):
                        continue
                places.append(e)
                taken.append(b)
                break
            else:
                if unit[i] not in self.ids:
                    places.append(i + 1)
                    taken.append(-1)
                elif i:
                    dead[i] = 1
                    places.pop()
                    taken.pop()
                else:  # none, in a model whose scores aren't those of merges: merging itself
                    return [x for p in self._merge(list(unit))[0] for x in ([self.ids[p]] if p in self.ids else self._fallback(p))]
        out: list[int] = []
        for i, b in zip(places, taken[1:], strict=False):
            out += [b] if b >= 0 else self._fallback(unit[i])
        return out

    def _cheapest(self, unit: str) -> list[int]:
        n, ids, longest = len(unit), self.ids, self.longest
        cost, back = [0.0] + [INF] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                if unit[i:j] in ids and cost[i] - self.score[unit[i:j]] < cost[j]:
                    cost[j], back[j] = cost[i] - self.score[unit[i:j]], i
            if unit[j - 1] not in ids and cost[j - 1] + self.unknown_cost < cost[j]:
                cost[j], back[j] = cost[j - 1] + self.unknown_cost, j - 1
        out: list[int] = []
        while n:
            piece = unit[back[n] : n]
            if piece in ids:
                out.append(ids[piece])
            elif self.bytes:
                out += reversed(self._fallback(piece))
            elif not (out and out[-1] == self.unknown):
                out.append(self.unknown)
            n = back[n]
        out.reverse()
        return out

    def _kept(self, unit: str) -> bytes:
        ids = self.kept.get(unit)
        if ids is None:
            ids = self.path(unit)
            if len(unit) <= 64:
                if len(self.kept) >= KEPT_UNITS:
                    self.kept.clear()
                self.kept[unit] = ids
        return ids

    def encode(self, text: str) -> array:
        kept, parts = self.kept, []
        for unit in self.units.findall(self.normalise(text)):
            ids = kept.get(unit)
            if ids is None:
                ids = self._kept(unit)
            parts.append(ids)
        return array("i", b"".join(parts))

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        if self.escape:
            text = text.replace(BLANK, " ")
        return text[1:] if self.dummy and text[:1] == " " else text


_compiled: dict[bytes, Transducer] = KEPT.setdefault("pieces", {})


def compiled(model: bytes) -> Transducer:
    """The model's transducer, compiled once in a process."""
    key = hashlib.sha256(model).digest()
    found = _compiled.get(key)  # scratch.tidy may clear the table at any time
    if found is None:
        found = _compiled[key] = Transducer(model)
    return found


def encode_documents(docs: DataFrame, model: bytes, digest: bool = False) -> DataFrame:
    """``docs`` with n_tokens, token_ids and round_trip (whether they decode to the text).

    ``digest``: token_ids only as the SHA-256 of its little-endian 32-bit integers, and of
    the input the doc_id only.
    """
    docs = docs.select("doc_id", "text") if digest else docs
    names = ["doc_id"] if digest else [c for c in docs.columns if c not in ("n_tokens", "token_ids", "round_trip")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    schema += ", n_tokens bigint, " + ("ids_sha256 string" if digest else "token_ids array<int>") + ", round_trip boolean"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts, ids, same, offsets = [], [], [], [0]
                flat = bytearray()
                for text in pc.fill_null(batch.column("text"), "").to_pylist():
                    got = t.encode(text)
                    counts.append(len(got))
                    same.append(t.decode(got) == text)
                    if digest:
                        ids.append(hashlib.sha256(got.tobytes()).hexdigest())
                    else:
                        flat += got.tobytes()
                        offsets.append(len(flat) // 4)
                column = pa.array(ids, pa.string()) if digest else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(bytes(flat))]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.int64()), column, pa.array(same, pa.bool_())], [*names, "n_tokens", "ids_sha256" if digest else "token_ids", "round_trip"])

    return docs.mapInArrow(tidy(run, "pieces"), schema)
