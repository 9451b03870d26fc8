"""Exact deduplication, substring and suffix deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from conftest import prose
from sparelane.llm import _windows, exact_dedup, fm_dedup, suffix_dedup
from sparelane.llm.exact_dedup import PatriciaTrie

BIG = (1 << 63) - 1


def frame(spark, docs, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def by_exact(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), BIG if i is None else i, i))
    out = []
    for i, t in docs:
        s = re.sub("[\x20\x09-\x0d]", "", t or "")
        n, _, keep = min(groups[s])
        out.append((i, keep, len(groups[s]), i == keep and len(t or "") == -n, sha(s.encode())))
    return sorted(out, key=repr)


def test_exact_dedup(spark, edge_docs, empty_docs, corpus):
    from conftest import EDGES  # noqa: F401  the fixture's rows

    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for df, docs in ((edge_docs, rows), (frame(spark, corpus), corpus)):
        got = sorted((tuple(r) for r in exact_dedup.exact_dedup(df).collect()), key=repr)
        assert got == by_exact(docs)
    assert exact_dedup.exact_dedup(empty_docs).count() == 0


@pytest.mark.parametrize("budget", [None, 300, 3000])
def test_trie_keeps_the_better_row_and_spills(budget):
    r = random.Random(budget)
    trie, expected = PatriciaTrie(budget), {}
    for _ in range(1500):
        key = bytes(r.choice(b"ab") for _ in range(r.randrange(12))) * r.choice([1, 1, 30])
        value = [1, r.randrange(5), r.choice([None, r.randrange(50)]), key.hex()]
        best = expected.get(key)
        order = lambda v: (-v[1], v[2] is None, v[2] or 0)
        expected[key] = [1 if best is None else best[0] + 1, *min((v for v in (best, value) if v), key=order)[1:]]
        trie.insert(key, list(value))
    got = {v[3]: v for v in trie.values()}
    assert got == {k.hex(): v for k, v in expected.items()}


def by_words(docs, k):
    first = {}
    words = [(BIG if i is None else i, i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    for n, _, w in words:
        for j in range(len(w) - k + 1):
            x = tuple(w[j : j + k])
            first[x] = min(first.get(x, BIG), n)
    out = []
    for n, i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < n:
                gone.update(range(j, j + k))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept).encode())))
    return sorted(out, key=repr)


def by_bytes(docs, k):
    first, out = {}, []
    texts = [(BIG if i is None else i, i, (t or "").encode()) for i, t in docs]
    for n, _, b in texts:
        for j in range(len(b) - k + 1):
            first[b[j : j + k]] = min(first.get(b[j : j + k], BIG), n)
    for n, i, b in texts:
        gone, seen = np.zeros(len(b), bool), set()
        for j in range(len(b) - k + 1):
            x = b[j : j + k]
            if first[x] < n or x in seen:
                gone[j : j + k] = True
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha(kept)))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("crowded", [_windows.CROWDED, 3])
def test_words_that_recur_go(spark, edge_docs, empty_docs, corpus, crowded, monkeypatch):
    monkeypatch.setattr(_windows, "CROWDED", crowded)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for df, docs, k in ((edge_docs, rows, 13), (frame(spark, corpus), corpus, 13), (frame(spark, corpus), corpus, 4)):
        assert collected(fm_dedup.remove_repeats(df, k)) == by_words(docs, k)
    if crowded > 3:
        assert fm_dedup.remove_repeats(empty_docs).count() == 0
        assert set(fm_dedup.remove_repeats(edge_docs, texts=True).columns) >= {"kept", "kept_sha256"}


@pytest.mark.parametrize("crowded", [_windows.CROWDED, 3])
def test_bytes_that_recur_go(spark, edge_docs, empty_docs, corpus, crowded, monkeypatch):
    monkeypatch.setattr(_windows, "CROWDED", crowded)
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for df, docs, k in ((edge_docs, rows, 100), (frame(spark, corpus), corpus, 100), (frame(spark, corpus), corpus, 20)):
        assert collected(suffix_dedup.remove_repeats(df, k)) == by_bytes(docs, k)
    if crowded > 3:
        assert suffix_dedup.remove_repeats(empty_docs).count() == 0


@pytest.mark.parametrize("of", [lambda i: None, lambda i: 7, lambda i: 1 + i // 3, lambda i: 9 - i // 2])
@pytest.mark.parametrize("crowded", [_windows.CROWDED, 2])
def test_rows_that_share_an_id_or_have_none_are_judged_each_by_its_own_text(spark, of, crowded, monkeypatch):
    monkeypatch.setattr(_windows, "CROWDED", crowded)
    p, q, z = (prose(seed, 60) for seed in (1, 2, 3))
    texts = [p, p + " x y z", q, q, z + " " + p, q + " " + z + " " + z, p, p[:150] + q[:150] + p[:150]]
    docs = [(1, p)] + [(of(i), t) for i, t in enumerate(texts)]
    assert collected(fm_dedup.remove_repeats(frame(spark, docs), 13)) == by_words(docs, 13)
    assert collected(suffix_dedup.remove_repeats(frame(spark, docs), 100)) == by_bytes(docs, 100)


def test_very_long_texts_and_clashing_columns(spark):
    """A megabyte in one text, and columns named like the operators' own."""
    long = prose(5, 180_000, 50_000)
    docs = [(1, long), (2, "a b " + long[500_000:500_900]), (3, long[-400:] + " end"), (4, "short")]
    extra = ", d long, r long, row long, wanted string, marks int, kind int, content binary"
    df = spark.createDataFrame([(*x, 1, 2, 3, "w", 4, 5, b"c") for x in docs], "doc_id long, text string" + extra)
    assert collected(fm_dedup.remove_repeats(df, 13)) == by_words(docs, 13)
    assert collected(suffix_dedup.remove_repeats(df, 100)) == by_bytes(docs, 100)


def test_crowded_keys_are_told_to_workers():
    """The limit goes along with the tasks, so a changed one holds there too."""
    scheme = _windows.Scheme(13, 4, True, False)
    assert scheme.crowded == _windows.CROWDED


def test_matching_statistics():
    r = random.Random(3)
    for _ in range(120):
        k, a = r.choice([1, 2, 3, 5, 8, 13]), r.choice([1, 2, 5])
        seqs = [[r.randint(1, a) for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 8))]
        asked = [[r.randint(1, a + 1) for _ in range(r.randint(0, 25))] for _ in range(4)]
        flat = lambda s: (np.array([x for y in s for x in y], np.int64), np.append(0, np.cumsum([len(x) for x in s])))
        index = fm_dedup.FMIndex(*flat(seqs), k)
        for streamed in (seqs, asked):
            text, bounds = flat(streamed)
            length, low, high = index.matching_statistics(text, bounds)
            for j, s in enumerate(streamed):
                for i in range(len(s)):
                    count = lambda n: sum(s[i : i + n] == x[p : p + n] for x in seqs for p in range(len(x) - n + 1))  # noqa: E731, B023
                    best = max([n for n in range(1, min(k, len(s) - i) + 1) if count(n)], default=0)
                    at = bounds[j] + i
                    assert length[at] == best and (not best or high[at] - low[at] == count(best))


def common(x, y):
    return next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_collection_bwt(monkeypatch):
    r = random.Random(5)
    for _ in range(250):
        monkeypatch.setattr(suffix_dedup, "BLOCK", r.choice([2, 3, 7, 1 << 17]))
        monkeypatch.setattr(suffix_dedup, "IN_MEMORY", r.choice([1, 64, 1 << 18]))
        seqs = [bytes(r.choice(b"ab" if r.random() < 0.7 else b"abcd\xff\0") for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 8))]
        if seqs and r.random() < 0.5:
            seqs += [r.choice(seqs) + b"a", r.choice(seqs)[1:]]
        delay = np.array([r.randint(0, 3) * (r.random() < 0.6) for _ in seqs], np.int64)
        suffixes = sorted((s[len(s) - n :], j, n) for j, s in enumerate(seqs) for n in range(len(s) + 1))
        bwt = suffix_dedup.CollectionBWT(seqs, delay)
        seq, size, prefix = bwt.rows()
        assert list(zip(seq.tolist(), size.tolist(), strict=True)) == [(j, n) for _, j, n in suffixes]
        assert prefix.tolist()[1:] == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
        least = r.choice([2, 4, 7])
        got, wanted = {}, {}
        for c, *x in zip(*(c.tolist() for c in bwt.classes(least)), strict=True):
            got.setdefault(c, []).append(tuple(x))
        for s, j, n in suffixes:
            if n >= least:
                wanted.setdefault((s[:least], n + int(delay[j])), []).append((j, n))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in wanted.values() if len(v) > 1)
