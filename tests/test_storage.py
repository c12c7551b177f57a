import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sessions_without_a_checkpoint_folder():
    code = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "from weftgraph.operators.components import connected_components\n"
        "print('rows', connected_components(s.createDataFrame([(1, 2), (2, 3)], 'src long, dst long')).count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout, done.stderr[-2000:]


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    """The entry imports, and registers the graph queries, where the corpus operators were deleted."""
    import shutil

    shutil.copytree(os.path.join(ROOT, "weftgraph"), tmp_path / "weftgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print('names', len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[2:] == ["False", "False", "True"], done.stdout + done.stderr[-2000:]
