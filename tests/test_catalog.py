"""Every registered query of the reference's operators against its SQL."""

import pytest

from canopyql.plans import catalog
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"pagerank20"}))
def test_against_sql(spark, con, sf, name):
    assert_same(spark, con, sf, catalog.queries()[name], catalog.oracle_sql()[name])


def test_pagerank(spark, con, sf):
    assert_same(spark, con, sf, catalog.queries()["pagerank20"], catalog.oracle_sql()["pagerank20"])


def test_entry_module_without_corpus_operators(tmp_path):
    """A copy of the tree without the corpus folder and the pipeline still registers everything else."""
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{top}/canopyql", tmp_path / "canopyql", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "canopyql" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for extra in ("", "corpus_pipeline.py"):  # with the pipeline's file left behind, too
        if extra and os.path.exists(f"{top}/{extra}"):
            shutil.copy(f"{top}/{extra}", tmp_path)
        said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert said.stdout.split() == [str(len(catalog.queries()))] * 2
