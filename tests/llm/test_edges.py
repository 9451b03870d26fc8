"""Every corpus operator on one table of a very long text, shared and missing ids, repeated rows, nulls and clashing columns."""

from __future__ import annotations

import pytest
from conftest import prose
from pyspark.sql import functions as F
from test_exact import by_exact, collected, frame
from test_near import by_jaccard, contaminated

import corpus_pipeline
from sparelane.llm import decontaminate, exact_dedup, line_templates, masked_lm, ngram_join, quality, secrets
from sparelane.llm.scratch import materialize

KEY = "password = abcdefgh12345678"
LONG = prose(70, 90_000, 30_000) + f" {KEY} " + prose(71, 90_000, 30_000)
P, Q = prose(72, 60), prose(73, 60)
DOCS = [(None, LONG), (None, "x y z"), (None, P), (5, P + " end"), (5, Q), (5, Q), (6, None), (7, ""), (8, LONG[:300_000]), (9, f"{KEY}\nsome line\n" + P), (10, "some line\nother words")]
NAMES = ["n", "node", "row", "list", "place", "kept", "key", "items", "start", "end", "h", "part", "class", "n_net", "good", "size", "given", "left"]


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(NAMES)))
    return materialize(rows.repartition(3), "edges")


def test_contamination(spark, table):
    items = [(1, LONG[600_000:600_400]), (2, Q[:200]), (2, Q[:200]), (3, None)]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, phrase_id int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in decontaminate.contamination(table, bench).collect()), key=repr)
    assert got == contaminated(DOCS, items, 10) and sum(r[4] for r in got) >= 3


def test_exact(table):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(table).collect()), key=repr)
    assert got == by_exact(DOCS)


def test_components(table):
    assert collected(ngram_join.jaccard_components(table)) == by_jaccard(DOCS, 5, 75)


def test_quality(spark, table):
    labels = spark.createDataFrame([(i, int(i != 8), 0) for i in range(5, 11)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.resample(table, labels, columns=["text", "n"]).collect()
    keys = {}
    for r in rows:
        keys.setdefault((r.doc_id, r.text), set()).add(r.key)
    assert len(rows) == len(DOCS) and all(len(k) == 1 for k in keys.values()) and len({k for x, k in ((x, next(iter(k))) for x, k in keys.items()) if x[0] is None}) == 3


def test_masked_scores(table):
    rows = masked_lm.pseudo_likelihood(table).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len((t or "").split()) for _, t in DOCS)
    same = {r.pll for r in rows if r.doc_id == 5 and r.n_tokens == len(Q.split())}
    assert len(same) == 1 and all((r.pll_mean is None) == (r.n_tokens == 0) for r in rows)


def test_secrets(table):
    rows = secrets.find_secrets(table).collect()
    at = LONG.index(KEY)
    spans = [r.spans for r in rows if r.doc_id is None and r.n_assign]
    assert len(rows) == len(DOCS) and len(spans) == 1 and f"assign:{at}:{at + len(KEY)}" in spans[0].split(",")


def test_lines(table):
    out = line_templates.drop_lines(table)
    assert set(NAMES) <= set(out.columns) and out.count() == len(DOCS)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (10, "other words") in got and (9, DOCS[9][1]) in got and (None, LONG) in got and (6, None) in got


def test_stages_decide_on_rows(spark, tmp_path):
    """Of rows that share an id or have none, only the copies and the contaminated go; frames without files work too."""
    docs = [(None, P, 1), (None, P, 2), (None, Q, 3), (4, "own text of four", 4), (4, prose(74, 40), 5), (4, prose(74, 40), 6), (None, None, 7), (None, "", 8)]
    given = spark.createDataFrame(docs, "doc_id long, text string, mark int")
    spark.createDataFrame([(1, Q)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (given, materialize(given.repartition(3), "given")):
        left = {r.mark for r in corpus_pipeline.duplicate_stage(spark, rows, str(tmp_path)).collect()}
        assert {3, 4, 7, 8} <= left and len(left & {1, 2}) == len(left & {5, 6}) == 1
        clean = corpus_pipeline.benchmark_stage(spark, rows, str(tmp_path))
        assert clean.columns == given.columns and {r.mark for r in clean.collect()} == {1, 2, 4, 5, 6, 7, 8}


def test_quality_of_rows_without_ids_does_not_tie(spark):
    docs = [(None, prose(i, 30)) for i in range(40)]
    out = quality.resample(frame(spark, docs), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len({r.key for r in out}) == 40


def test_stages_compact_the_executors(spark, tmp_path, monkeypatch):
    called = []
    monkeypatch.setattr(corpus_pipeline.scratch, "compact", called.append, raising=False)
    stage = corpus_pipeline._stage(lambda spark, docs, sf_dir: (len(called), docs))
    assert stage(spark, None, str(tmp_path)) == (1, None) and called == [spark]


def test_compact_collects_in_the_executors(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans  # local mode: the one JVM is the executor
    before = sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    corpus_pipeline.scratch.compact(spark)
    assert sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName()) >= before + 2
