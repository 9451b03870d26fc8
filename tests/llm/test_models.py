"""Pieces, quality, masked language model and secrets."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import struct
import time
from pathlib import Path

import numpy as np
import pytest
from conftest import prose

from sparelane.llm import masked_lm, pieces, quality, scratch, secrets
from test_exact import collected, frame

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
needs_model = pytest.mark.skipif(not MODEL.exists(), reason="no vocabulary file")


def samples(transducer):
    r = random.Random(1)
    out = ["", " ", "a  b", "Hello world", " x\ny\t", "é́ 中文🙂", "\x00a", "<s> </s> <0x41>", "a" * 40, " " * 33 + "x", "=" * 50]
    out += ["".join(r.choice("ab e  thn\n\t中é🙂.1=AKIA") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    known = [p for p, _, k in transducer.pieces if k == pieces.NORMAL]
    return out + ["".join(r.choice(known) for _ in range(r.randint(1, 5))).replace(pieces.BLANK, " ") for _ in range(6000)]


@needs_model
def test_merge_model_equals_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    model = MODEL.read_bytes()
    mine, other = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in samples(mine):
        ids = list(mine.encode(text))
        assert ids == other.encode(text), text
        assert mine.decode(ids) == text


def message(fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(fallback, character_map=b"", user=()):
    r = random.Random(4)
    table = [("<unk>", 0.0, pieces.UNKNOWN)]
    table += [(f"<0x{i:02X}>", 0.0, pieces.BYTE) for i in range(256)] if fallback else []
    table += [(p, -r.uniform(1, 9), pieces.NORMAL) for p in ("▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "cab", "é", "▁b")]
    table += [(p, 0.0, pieces.USER) for p in user]
    parts = [(1, message([(1, p.encode()), (2, s), (3, k)])) for p, s, k in table]
    return message([*parts, (2, message([(3, pieces.UNIGRAM), (35, int(fallback)), (40, 0)])), (3, message([(1, b"identity"), *[(2, character_map)] * bool(character_map), (3, 1), (4, int(bool(character_map))), (5, 1)]))])


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_equals_the_library(fallback):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = unigram_model(fallback)
    mine, other = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(6)
    for _ in range(800):
        text = "".join(r.choice("abcab  éx") for _ in range(r.randint(0, 25)))
        assert list(mine.encode(text)) == other.encode(text), text


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_character_map_equals_the_library(rule):
    """The rules' own characters, what combines, what goes, and blanks beside it."""
    sentencepiece = pytest.importorskip("sentencepiece")
    spec = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    blob = dict(pieces._fields(spec))[2]
    plain = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    model = unigram_model(True, blob)
    mine, other = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    r, rules = random.Random(2), list(mine.map.arcs[0])
    for text in ["", " ", "\x01", "\x01  a", "a \u200b b", "e\u0323\u0301", "ﷺ", "ｶﾞ"] + ["".join(r.choice("abc \t\n\x07\u200b\u3000Ａﬁ①㌔\u0323\u0301\u0308eé가ᄀ\u1161中") if r.random() < 0.7 else r.choice(rules) for _ in range(r.randint(0, 20))) for _ in range(3000)]:
        assert mine.normalise(text) == plain.Normalize(text), text
        assert list(mine.encode(text)) == other.encode(text), text
    assert mine.decode(mine.encode("ＡＢ\tc")) == plain.Normalize("ＡＢ\tc").replace("▁", " ")[1:]
    with pytest.raises(ValueError, match="users defined"):
        pieces.Transducer(unigram_model(True, blob, ["<x>"]))


@needs_model
def test_pieces_of_documents(spark, edge_docs, empty_docs):
    model = MODEL.read_bytes()
    t = pieces.Transducer(model)
    out = pieces.encode_documents(edge_docs, model)
    rows = out.collect()
    assert len(rows) == edge_docs.count() and "leaf" in out.columns
    for r in rows:
        assert list(r.token_ids) == list(t.encode(r.text or "")) and r.n_tokens == len(r.token_ids) and r.round_trip
    digests = sorted(r.ids_sha256 for r in pieces.encode_documents(edge_docs, model, digest=True).collect())
    assert digests == sorted(hashlib.sha256(np.array(r.token_ids, "<i4").tobytes()).hexdigest() for r in rows)
    assert pieces.encode_documents(empty_docs, model).count() == 0


@pytest.fixture(scope="module")
def graded():
    """Good prose, junk, and prose with words that only bad documents have."""
    r = random.Random(8)
    docs, labels = [], []
    for i in range(240):
        kind = "good" if i % 4 else ("junk", "toxic", "junk")[i // 4 % 3]
        text = prose(i, 120, 80)
        if kind == "junk":
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif kind == "toxic":
            w = text.split()
            for _ in range(12):
                w.insert(r.randrange(len(w)), r.choice(["idiotic", "moronic"]))
            text = " ".join(w)
        docs.append((i, text))
        if i < 200:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_quality_keeps_good_documents_held_out(spark, graded, empty_docs, edge_docs):
    docs, labels = graded
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.resample(frame(spark, docs), marks).collect()}
    test = range(200, 240)
    kept = {i for i in test if out[i].kept}
    assert kept == {i for i in test if i % 4}
    assert sum(r.kept for r in out.values()) >= 0.97 * sum(bool(i % 4) for i in range(240))
    for none in (marks.limit(0), marks.filter("quality = 1 AND toxic = 0")):
        assert quality.resample(edge_docs, none).filter("kept").count() == edge_docs.count()
    assert quality.resample(empty_docs, marks).count() == 0
    given = quality.resample(edge_docs, marks, columns=edge_docs.columns)
    assert set(given.columns) >= {"leaf", "text", "log_weight"}


def test_kth_largest_is_exact(spark):
    r = random.Random(3)
    values = [r.choice([0.0, 1e9, -5.5, r.gauss(0, 1), r.gauss(0, 1e-9)]) for _ in range(400)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 57, 200, 399, 400):
        assert quality.kth_largest(keys, k, few=5, bins=7) == sorted(values, reverse=True)[k - 1]


def test_scores_are_sums_of_truncated_log_ratios():
    r = np.random.default_rng(0)
    table = r.normal(size=quality.BUCKETS).astype(np.float32)
    texts = [b"one two one two", b"", b"zz", b"Some OTHER words 12, here"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    together = quality.score(table, data, offsets)
    for i, t in enumerate(texts):
        alone = quality.grams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
        assert np.isclose(together[i], table[alone].sum() * quality.SCALE / (len(alone) + quality.SCALE), atol=1e-4)
    assert quality.threshold(np.array([0.0, 1.0, 2.0]), np.array([-3.0, -2.0]), 0.99) == -1.0


def naive_contexts(ids, bounds):
    """The ids beside each token, ``PAD`` beyond its document."""
    near = lambda a, b, i: ids[i] if a <= i < b else masked_lm.PAD
    return [[near(a, b, i + o) for o in masked_lm.OFFSETS] for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b)]


def naive_log_p(p, tree, ctx, word):
    h = np.tanh(sum(p["E"][c] * p["A"][k] for k, c in enumerate(ctx)) + p["b"])
    z = h @ p["C"] + p["c"]
    said = z[tree.subtree[word]] - z.max() - np.log(np.exp(z - z.max()).sum())
    for code in tree.nodes[tree.starts[word] : tree.starts[word + 1]]:
        x = p["N"][code // 2] @ np.append(h, 1)
        said -= np.logaddexp(0, -x if code % 2 else x)
    return said


def test_tree_is_optimal_and_whole():
    """Against merging the two lightest again and again."""
    r = np.random.default_rng(4)
    for weights in (r.zipf(1.3, 3000).clip(max=10**6), np.ones(masked_lm.TOP + 1, np.int64), np.full(1000, 7)):
        tree = masked_lm.Tree(weights)
        heap, cost, merges = [int(w) for w in weights], 0, len(weights) - masked_lm.TOP
        heapq.heapify(heap)
        for _ in range(merges):  # what is left are the subtrees
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (weights * tree.depth).sum() == cost
        assert sorted(np.bincount(tree.subtree, weights, masked_lm.TOP)) == sorted(heap)
        paths = {(int(tree.subtree[i]), tuple((tree.nodes[tree.starts[i] : tree.starts[i + 1]] % 2).tolist()[::-1])) for i in range(len(weights))}
        assert len(paths) == len(weights)


def test_network_probabilities_and_gradients():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in masked_lm.initial().items()}
    tree = masked_lm.Tree(r.zipf(1.4, masked_lm.VOCABULARY).clip(max=10**6))
    ids = r.integers(0, masked_lm.VOCABULARY, 30)
    bounds = np.array([0, 0, 11, 30])
    ctx = naive_contexts(ids, bounds)
    seq, at = masked_lm.padded(ids, bounds)
    got = masked_lm.forward(p, tree, seq, at)
    assert np.allclose(got, [naive_log_p(p, tree, c, i) for c, i in zip(ctx, ids, strict=True)])
    every = np.logaddexp.reduce([naive_log_p(p, tree, ctx[4], i) for i in range(masked_lm.VOCABULARY)])
    assert abs(every) < 1e-6
    grads = {}
    masked_lm.forward(p, tree, seq, at, grads)
    for k in "EN":
        rows, values = grads[k]
        grads[k] = np.zeros_like(p[k])
        grads[k][rows] = values
    node = tree.nodes[tree.starts[ids[5]]] // 2
    for name, where in (("E", (ids[3], 2)), ("E", (masked_lm.PAD, 4)), ("A", (1, 5)), ("b", (3,)), ("C", (4, 7)), ("c", (tree.subtree[ids[0]],)), ("N", (node, 1)), ("N", (node, masked_lm.DIM))):
        loss = []
        for step in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][where] += step
            loss.append(-masked_lm.forward(q, tree, seq, at).mean())
        assert np.isclose(grads[name][where], (loss[0] - loss[1]) / 2e-5, atol=1e-7)


def test_a_training_step_equals_adam():
    """Rows that no token of the batch touches stay; the others move as in a plain version."""
    r = np.random.default_rng(3)
    tree, ids = masked_lm.Tree(np.arange(masked_lm.VOCABULARY) + 1), r.integers(0, 300, 500)
    seq, at = masked_lm.padded(ids, np.array([0, 200, 500]))
    trainer = masked_lm.Trainer(masked_lm.initial(), tree)
    before, grads = masked_lm.initial(), {}
    masked_lm.forward(before, tree, seq, at, grads)
    trainer.learn(seq, at)
    for k, g in grads.items():
        rows, g = g if isinstance(g, tuple) else (np.arange(len(g)), g)
        expected = before[k].copy()
        expected[rows] -= masked_lm.RATE * np.sqrt(0.01) / 0.1 * 0.1 * g / (np.sqrt(0.01 * g * g) + 1e-6)
        assert np.allclose(trainer.p[k], expected, atol=1e-4)
    assert trainer.seen == 500 and (trainer.p["E"] == before["E"]).all(axis=1).sum() == masked_lm.VOCABULARY - len(set(ids.tolist()))


def test_parts_average_by_tokens(monkeypatch):
    """Changes of three parts, one without some pieces, in two levels, against the plain mean."""
    monkeypatch.setattr(masked_lm, "PIECE", 10)
    r = np.random.default_rng(6)
    changes, seen = r.normal(size=(3, 25)).astype(np.float32), [5, 1, 9]
    changes[1, :20] = 0
    changes[:, 3] = 0
    rows = [(i // 10, t, masked_lm._packed(c[i : i + 10]), n) for t, (c, n) in enumerate(zip(changes, seen, strict=True)) for i in range(0, 25, 10) if c[i : i + 10].any()]
    for fan_in in (2, 2):
        out = masked_lm._average(fan_in, 25)(masked_lm._pieces(sorted(rows)))
        rows = [tuple(x.values()) for batch in out for x in batch.to_pylist()]
    got, every = np.zeros(25), max(r[3] for r in rows)
    for piece, task, b, n in rows:
        assert task == 0
        masked_lm._add(got[piece * 10 : (piece + 1) * 10], b, n / every)
    assert np.allclose(got, np.average(changes, axis=0, weights=seen), atol=1e-6) and len(rows) == 3


def test_scores_follow_training(spark, corpus, edge_docs, empty_docs):
    docs = frame(spark, corpus * 3)
    vocab = masked_lm.vocabulary(docs)
    coded = masked_lm.encoded(docs, vocab)
    trained = masked_lm.train(coded, vocab, fan_in=2)
    mean = lambda p: masked_lm.score_documents(coded, vocab, p).agg({"pll": "sum"}).first()[0]
    assert mean(trained) > mean(masked_lm.initial(vocab.size))
    rows = {r.doc_id: r for r in masked_lm.score_documents(masked_lm.encoded(frame(spark, corpus), vocab), vocab, trained).collect()}
    i, text = corpus[20]
    h, bounds = masked_lm.tokens(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    ids = vocab.ids(h)
    expected = sum(naive_log_p(trained, vocab.tree, c, w) for c, w in zip(naive_contexts(ids, bounds), ids, strict=True))
    assert np.isclose(rows[i].pll, expected, rtol=1e-3) and rows[i].n_tokens == len(text.split())
    out = masked_lm.pseudo_likelihood(edge_docs).collect()
    assert len(out) == edge_docs.count() and all((r.pll_mean is None) == (r.n_tokens == 0) for r in out)
    assert masked_lm.pseudo_likelihood(empty_docs).count() == 0


def test_vocabulary_follows_the_corpus(spark):
    least = masked_lm.VOCABULARY - masked_lm.BUCKETS
    sizes, size = [], 9000 + masked_lm.BUCKETS + (9000 - least) // masked_lm.WORDS_PER_BUCKET
    for n in (1000, 9000):
        often = " ".join(f"w{i}" for i in range(n))
        docs = [(j, often) for j in range(masked_lm.MIN_COUNT)] + [(99, " ".join(f"once{i}" for i in range(4000)))]
        vocab = masked_lm.vocabulary(frame(spark, docs))
        h = masked_lm.tokens(np.frombuffer(often.encode(), np.uint8), np.array([0, len(often)]))[0]
        assert len(set(vocab.ids(h).tolist())) == n and vocab.ids(h).max() < vocab.n
        sizes.append((vocab.n, vocab.size))
    assert sizes == [(least, masked_lm.VOCABULARY), (9000, size)]
    few = masked_lm.encoded(frame(spark, [(j, often) for j in range(4)]), vocab)
    trained = masked_lm.train(few, vocab, fan_in=2)
    assert len(trained["E"]) == size + 1 and len(trained["N"]) == size - 1
    total = lambda p: masked_lm.score_documents(few, vocab, p).agg({"pll": "sum"}).first()[0]
    assert total(trained) > total(masked_lm.initial(size))


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)), [sum(k == x for _, k, _ in found) for x in range(3)]


def key(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(n))


def secret_docs():
    r = random.Random(5)
    upper, mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    docs = []
    for i in range(150):
        text = prose(i, 60)
        if i % 3 == 0:
            text += f" é Password: '{key(r, mixed, 20)}' x"
        elif i % 3 == 1:
            text += f" AKIA{key(r, upper, 16)} " + key(r, "0123456789abcdef", 40)
        text += f" item-{i:06d}-of-page-{i} version_{i}.txt.backup"
        docs.append((i, text))
    return docs + [(200, "token=short, secret: secret: tOkEn = abcdefgh12"), (201, "AKIA AKIAAAAA AKIA1234567890AB12" + "f" * 31), (202, None), (203, "api_key=\n12345678"), (204, "ſecret=aaaaaaaaaa toKen=bbbbbbbbbb")]


def test_base_findings_equal_the_patterns(spark, edge_docs, empty_docs):
    docs = secret_docs()
    for r in secrets.scan_secrets(frame(spark, docs), None).collect():
        said, counts = base_spans(dict(docs)[r.doc_id] or "")
        assert r.spans == said and [r.n_assign, r.n_access, r.n_hex] == counts and r.n_net == 0
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert secrets.find_secrets(edge_docs).count() == edge_docs.count()
    assert secrets.find_secrets(empty_docs).count() == 0


def test_network_adds_keys_and_leaves_names(spark):
    docs = secret_docs()
    r = random.Random(77)
    fresh = [(300 + i, prose(300 + i, 40) + " key " + key(r, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 32)) for i in range(20)]
    net = secrets.fit_network(frame(spark, docs))
    out = {x.doc_id: x for x in secrets.scan_secrets(frame(spark, docs + fresh), net).collect()}
    assert sum(out[i].n_net >= 1 for i, _ in fresh) >= 16
    assert sum(out[i].n_net for i, _ in docs) <= 0.05 * 2 * len(docs)
    for i, t in docs:
        assert set(filter(None, base_spans(t or "")[0].split(","))) <= set(out[i].spans.split(","))


def test_every_run_is_scored_and_recall_is_kept():
    r = random.Random(9)
    bare, short = key(r, "abcdefghijklmnop", 30), key(r, "abcdef123", 8)
    joined = "AKIA1234567890AB12/" + key(r, "ghijkXYZ123", 24)
    text = f"{bare} {short} {joined} password: 'abcdefgh12'".encode()
    _, candidates = secrets._scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    said = {(text[s:e].decode(), label) for _, s, e, label in candidates}
    assert said == {(bare, secrets.OTHER), (short, secrets.OTHER), (joined, secrets.FINDING), (joined[20 - 2 :], secrets.REST), ("abcdefgh12", secrets.FINDING)}
    net = secrets.CharCNN()
    net.p["c"][:] = -50
    windows = [(bytes(f"{i:04d}" * 5, "ascii"), i % 3, 20 - i % 2) for i in range(200)]
    labels = np.array([i % 2 for i in range(200)], np.float32)
    assert np.allclose(net.scores(windows), net._forward(windows)[0], atol=1e-3)
    net.calibrate(windows, labels, 0.98)
    assert net.threshold < 0 and (net.scores(windows)[labels > 0] >= net.threshold).mean() >= 0.98 and 0 < net.precision <= 1


def test_network_gradients():
    r = np.random.default_rng(2)
    net = secrets.CharCNN()
    windows = [(bytes(r.integers(33, 120, 30, dtype=np.uint8)), 8, 22) for _ in range(40)]
    labels = np.array([i % 2 for i in range(40)], np.float32)
    loss = lambda: np.logaddexp(0, np.where(labels > 0, -1, 1) * net.scores(windows)).mean()
    before = loss()
    net.fit(windows, labels, epochs=60)
    assert loss() < before / 2


def test_scores_do_not_depend_on_the_layout(spark, corpus, edge_docs, monkeypatch):
    """Two and nine partitions, several training parts; repeated rows and null ids each for themselves."""
    monkeypatch.setattr(masked_lm, "PART", 20)
    docs = [*corpus, *[(r.doc_id, r.text) for r in edge_docs.collect()], (None, "one more"), (3, "one more")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted((tuple(r) for r in masked_lm.pseudo_likelihood(rows.repartition(n)).collect()), key=repr) for n in (2, 9)]
    assert got[0] == got[1] and len(got[0]) == len(docs)
    assert len({r[2] for r in got[0] if r[:2] in ((6, 2), (7, 2), (None, 2))}) == 2  # "one two" and "one more"


def test_waiting_worker_keeps_nothing(monkeypatch):
    monkeypatch.setattr(scratch, "IDLE_S", 0.2, raising=False)
    monkeypatch.setitem(scratch.KEPT, "some", {1: 2})
    for _ in range(2):
        assert list(scratch.tidy(iter, "some")([1])) == [1]
        assert scratch.KEPT["some"]
    until = time.monotonic() + 5
    while scratch.KEPT["some"] and time.monotonic() < until:
        time.sleep(0.05)
    assert not scratch.KEPT["some"]


def test_gradients_by_subtree_equal_those_by_node():
    rng = np.random.default_rng(3)
    size = masked_lm.VOCABULARY
    tree = masked_lm.Tree(rng.zipf(1.3, size).clip(1, 10**6))
    ids = rng.integers(0, size, 500)
    ids = ids[np.argsort(tree.subtree[ids], kind="stable")]
    weights, one = rng.normal(size=(size - 1, 25)), rng.normal(size=(len(ids), 25))
    back, (rows, sums) = masked_lm._descend(weights, tree, ids, one, 0.5)
    dh, dn = np.zeros_like(one), np.zeros_like(weights)
    for i, word in enumerate(ids.tolist()):
        for code in tree.nodes[tree.starts[word] : tree.starts[word + 1]].tolist():
            sign, node = (code & 1) * 2 - 1, code >> 1
            assert tree.cuts[tree.subtree[word]] <= node < tree.cuts[tree.subtree[word] + 1]
            g = -0.5 * sign / (1 + np.exp(sign * (one[i] @ weights[node])))
            dh[i] += g * weights[node]
            dn[node] += g * one[i]
    assert np.allclose(back, dh) and np.allclose(sums, dn[rows])
    assert not np.delete(dn, rows, axis=0).any()
