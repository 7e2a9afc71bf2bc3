import os
import shutil
import subprocess
import sys

import pytest

from comparing import assert_same
from prismark.plans import catalogue, storage

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", ["lsh_grid", "pareto_frontier"])
def test_grid_lists_no_candidates(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("candidates are counted, not listed")

    monkeypatch.setattr(catalogue.lsh, "grid", refuse)
    assert catalogue.QUERIES[name](spark, SF).columns == ["num_tables", "hash_width", "avg_candidates", "avg_recall"]


def test_entry_without_the_training_data_operators(tmp_path):
    """In a copy without them, and with corpus_pipeline.py left behind or not, the rest is there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for keep in (True, False):
        copy = tmp_path / str(keep)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), [k for k in q if k.startswith('op') and k[2].isdigit() or k == 'pipeline'])"
        out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True).stdout
        assert out.split() == [str(len(catalogue.QUERIES)), "[]"]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="share"):
        storage.shared_root(Session())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
