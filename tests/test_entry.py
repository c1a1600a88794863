import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from trailspark.operators import lineage

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("trailspark/llm", "tests/llm"), ("trailspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_works_without_the_text_operators(tmp_path, gone):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *(os.path.basename(g) for g in gone)))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'route_length' in q and 'pipeline' not in q; import bench"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_cluster_without_a_shared_folder_is_told_so():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())
