"""Decontamination, line templates, Jaccard join and components against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparelane.llm import components, decontaminate, line_templates, ngram_join
from conftest import prose
from test_exact import BIG, collected, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contaminated(docs, items, k):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        for j in range(max(len(w) - k, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                of = windows.get(tuple(w[j : j + n]))
                if of:
                    hit.update(range(j, j + n))
                    found |= of
        out.append((i, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def test_contamination(spark, edge_docs, empty_docs, corpus, monkeypatch):
    items = [(1, corpus[45][1][60:400]), (2, "ALPHA  Beta, gamma"), (3, None), (4, "-"), (5, "one"), (2, "ALPHA  Beta, gamma"), (6, corpus[45][1][60:400]), (7, "the " * 20), (8, "absent words of an item that nothing holds at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    show = lambda df: sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in df.collect()), key=repr)
    for limit in (decontaminate.BROADCAST_CHARS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", limit)
        monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", limit)
        assert show(decontaminate.contamination(edge_docs, bench)) == contaminated(rows, items, 10)
    assert show(decontaminate.contamination(frame(spark, corpus), bench, 4)) == contaminated(corpus, items, 4)
    assert decontaminate.contamination(empty_docs, bench).count() == 0
    none = decontaminate.contamination(edge_docs, bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    shared = [(7, corpus[45][1]), (7, prose(77, 50)), (None, corpus[45][1]), (None, prose(78, 50)), (None, prose(78, 50))]
    assert show(decontaminate.contamination(frame(spark, shared), bench)) == contaminated(shared, items, 10)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue red"), (2, "blue blue"), (3, "red " * 3)], "doc_id long, text string")
    index = decontaminate.PositionalIndex(docs, spark.createDataFrame([("red",), ("blue",)], "term string"))
    assert collected(index.near("red", "blue", 3)) == [(1, 0, 3), (1, 4, 3)]
    assert collected(index.near("red", "blue", 1)) == [(1, 4, 3)]
    assert collected(index.near("red", "red", 1)) == [(3, 0, 1), (3, 1, 0), (3, 1, 2), (3, 2, 1)]
    assert collected(index.lengths()) == [(1, 5), (2, 2), (3, 3)]
    assert collected(decontaminate.proximity(docs, "red", "blue", 1)) == [(1, 4, 3)]
    with pytest.raises(ValueError, match="green"):
        index.near("red", "green", 1)


def by_lines(docs, least, depth, share):
    mask = lambda t: "<*>" if re.search("[0-9]", t) else t
    lines = []
    for i, t in docs:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            w = [mask(x) for x in re.sub("[\t\x0b\x0c\r]", " ", line).strip(" ").split(" ") if x]
            if w:
                lines.append((i, n, tuple(w), (len(w), *w[:depth])))
    leaves, per_line, constant = {}, {}, {}
    for i, _, w, leaf in lines:
        leaves.setdefault(leaf, set()).add(i)
        per_line.setdefault((leaf, w), set()).add(i)
    for (leaf, w), of in per_line.items():
        for p, x in enumerate(w):
            constant[leaf, p, x] = constant.get((leaf, p, x), 0) + len(of)
    templates = {}
    for i, n, w, leaf in lines:
        if len(leaves[leaf]) >= least:
            t = tuple(x if x != "<*>" and constant[leaf, p, x] >= least else "<*>" for p, x in enumerate(w))
            if sum(x != "<*>" for x in t) >= share * len(t):
                templates.setdefault(t, []).append((i, n))
    drop = {}
    for of in templates.values():
        ids = {i for i, _ in of}
        if len(ids) >= least:
            first = min(ids, key=lambda i: BIG if i is None else i)
            for i, n in of:
                if i != first:
                    drop.setdefault(i, set()).add(n)
    out = []
    for i, t in docs:
        if t is None:
            out.append((i, None, 0, 0, False))
            continue
        parts = t.split("\n")
        kept = [x for n, x in enumerate(parts) if n not in drop.get(i, ())]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept), len(kept) < len(parts) and not "".join(kept).strip()))
    return sorted(out, key=repr)


def test_lines_of_recurring_templates_go(spark, edge_docs, empty_docs):
    r = random.Random(2)
    docs = [(i, f"Copyright by firm {i} all rights reserved\n" * (i % 3 > 0) + f"own line of {i} with x{i}y words\nunique {r.random()} b c\n" + ("Page 7\n\n" if i % 2 else "menu home about\nend")) for i in range(30)]
    docs += [(50, None), (51, ""), (52, "menu home about"), (None, "menu home about\nother"), (53, "menu home about\nmenu home about")]
    show = lambda df: collected(df.select("doc_id", "text", "n_lines", "n_dropped", "emptied"))
    for least, depth, share in ((10, 3, 0.6), (4, 1, 0.3), (3, 2, 0.9)):
        got = show(line_templates.drop_lines(frame(spark, docs), least, depth, share))
        assert got == by_lines(docs, least, depth, share)
    clash = edge_docs.select("*", *(F.lit(7).alias(c) for c in ("n_lines", "n_dropped", "emptied", "__d", "row", "given", "left", "gone", "size")))
    out = line_templates.drop_lines(clash, 2)
    assert {r.row for r in out.collect()} == {r.gone for r in out.collect()} == {7} and out.schema["emptied"].dataType.simpleString() == "boolean"
    shared = [(1, "some plain line\nown a"), (7, "some plain line\nown b"), (7, "other text\nown c"), (None, "some plain line\nown d"), (None, "own e\nown f")]
    assert sorted(r.text for r in line_templates.drop_lines(frame(spark, shared)).collect()) == sorted(["some plain line\nown a", "own b", "other text\nown c", "own d", "own e\nown f"])
    out = line_templates.drop_lines(edge_docs, 2)
    assert set(out.columns) >= {"key", "leaf", "part", "kept"} and out.count() == edge_docs.count()
    assert line_templates.drop_lines(empty_docs).count() == 0


def test_lines_that_two_documents_have_go(spark):
    long = " ".join(f"t{i}" for i in range(50))
    short = " ".join(f"t{i}" for i in range(49))
    docs = [(1, f"same words here\nown a\n{long}"), (2, f"own b\n same  words here\n{short}"), (3, f"{long}\n{short}\nown c"), (None, "own c\nown d")]
    out = {r.doc_id: r.text for r in line_templates.drop_lines(frame(spark, docs)).collect()}
    assert out == {1: docs[0][1], 2: f"own b\n{short}", 3: f"{short}\nown c", None: "own d"}


def by_jaccard(docs, size, percent):
    sets = []
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        sets.append((BIG if i is None else i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), BIG), i)
    known = lambda x: None if x == BIG else x
    return sorted(((known(i), len(s), known(least[find(x)])) for x, (i, s) in enumerate(sets)), key=repr)


def test_jaccard_components(spark, edge_docs, empty_docs, corpus):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    for df, docs, percent in ((edge_docs, rows, 75), (frame(spark, corpus), corpus, 75), (frame(spark, corpus), corpus, 40)):
        assert collected(ngram_join.jaccard_components(df, 5, percent)) == by_jaccard(docs, 5, percent)
    assert ngram_join.jaccard_components(empty_docs).count() == 0


def test_jaccard_components_of_hot_shingles_and_split_lists(spark, corpus, monkeypatch):
    """Hot shingles pass by the deal, and lists stand in several blocks: same result."""
    for name, value in (("BLOCK", 3), ("TOGETHER", 2), ("SAMPLED", 1), ("HOT", 0.0), ("GATHERED", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    many = [(1000 + i, f"one{i} " + corpus[70][1] + f" two{i}") for i in range(80)]
    docs = corpus + many
    found = ngram_join.hot_shingles(frame(spark, docs), 5, len(docs), 10_000)
    assert len(found[0]) and found[1].min() >= 64
    assert collected(ngram_join.jaccard_components(frame(spark, docs))) == by_jaccard(docs, 5, 75)


def test_classes_tell_rows_without_ids_apart(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(None, a, 1), (None, a + " end", 2), (None, b, 3), (None, None, 4)], "doc_id long, text string, node int")
    got = ngram_join.jaccard_components(docs, row=F.col("node")).collect()
    of = {r["row"]: r["class"] for r in got}
    assert of[1] == of[2] != of[3] and of[4] is None and {r.component_id for r in got} == {None}


def test_links_that_only_chain_through_other_copies(spark, monkeypatch):
    """Each text is near the next, but the ends are far apart; nodes of many pairs are split."""
    monkeypatch.setattr(ngram_join, "TOGETHER", 2)
    words = [f"c{i}" for i in range(60)]
    docs = []
    for i in range(14):
        docs.append((20 - i, " ".join(f"d{j}" if j < 3 * i else w for j, w in enumerate(words))))
    docs += [(50 + i, " ".join([*words[:58], f"e{i}"])) for i in range(12)]
    assert collected(ngram_join.jaccard_components(frame(spark, docs))) == by_jaccard(docs, 5, 75)


def test_components(spark):
    r = random.Random(9)
    for n, m in ((30, 20), (30, 60), (40, 39)):
        pairs = [(i, i + 1) for i in range(m)] if m == 39 else [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        got = components.components(spark.createDataFrame(pairs, "a long, b long"))
        assert dict(collected(got)) == {x: root[x] for p in pairs for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_size():
    for n in range(1, 200):
        p = int(ngram_join.prefix_size(F and __import__("numpy").array([n]), 75)[0])
        assert p == n - -(-3 * n // 4) + 1 and 1 <= p <= n
