"""Every registered query with SQL equals DuckDB's result."""

import os
import pathlib
import shutil
import subprocess
import sys

import pytest
from oracle import DATA, same

from sparelane.plans import catalog, state

SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    same(catalog.queries()[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage, with and without the pipeline."""
    root = pathlib.Path(__file__).resolve().parent.parent
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path)
    shutil.copytree(root / "sparelane", tmp_path / "sparelane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for _ in range(2):
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=True)
        assert said.stdout.split() == [str(len(catalog.queries())), str(len(SQL))]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_stored_state_is_built_once_and_again_when_its_input_changes(spark, tmp_path):
    path, builds = f"{tmp_path}/t.parquet", []
    ask = lambda: state.stored(spark, "test", [path], lambda: builds.append(1) or spark.read.parquet(path).groupBy().count()).first()[0]
    spark.range(5).write.parquet(path)
    assert [ask(), ask(), len(builds)] == [5, 5, 1]
    spark.range(3).write.mode("append").parquet(path)
    assert [ask(), len(builds)] == [8, 2]
