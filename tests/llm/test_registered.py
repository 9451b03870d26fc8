"""Registered queries against DuckDB, and the pipeline's stages on planted cases."""

from __future__ import annotations

import pytest
from conftest import prose
from oracle import DATA, same

import corpus_pipeline
from sparelane.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same(queries.queries()[name](spark, str(DATA)), SQL[name])


def test_names():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontaminate", "pieces"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for i in range(160):
        text, bad = prose(i, 90, 60), i % 8 == 0
        if bad:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        docs.append((i, text + (f"\nShared footer line number {i}" if i % 4 == 1 else ""), "en", "s", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    near = prose(900, 100, 60).split()
    for i in range(5):
        docs.append((200 + i, " ".join([*near[:50], f"x{i}", *near[51:]]), "en", "s", 1))
    docs += [(210 + i, docs[3][1], "en", "s", 1) for i in range(3)]
    leak = prose(950, 30, 60)
    docs.append((220, prose(951, 40, 60) + " " + leak + " " + prose(952, 20, 60), "en", "s", 1))
    docs += [(230, None, None, None, None), (231, "", "en", "s", 0), (None, prose(960, 50, 60), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "words that no document has in this order at all ever again")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_catch_planted_cases_and_keep_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, tables), f"test-{k}")
        if k < 4:
            assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean, last = seen
    bad = {i for i in range(0, 160, 8)}
    assert not bad & set(quality) and len(quality) >= 0.97 * (160 - len(bad) + 12)
    footers = [i for i, t in lines.items() if t and "Shared footer" in t]
    assert footers == [1] and set(lines) == set(quality) - {i for i in quality if quality[i] and not (lines.get(i) or "").strip() and i not in lines}
    assert len({200, 201, 202, 203, 204} & set(near)) == 1
    assert 220 in near and 220 not in clean and set(near) - set(clean) == {220}
    assert set(last) == set(clean) and {230, 231, None} <= set(last)
    assert all(r.round_trip for r in docs.collect())


def test_run_and_empty_tables(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    assert out.count() > 100 and "token_ids" in out.columns
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
