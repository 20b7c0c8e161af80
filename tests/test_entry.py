import subprocess
import sys

from conftest import ROOT


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_llm_folders():
    code = "import sys; sys.modules['corvane.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_imports_without_a_library_of_the_llm_folder():
    code = "import sys; sys.modules['zstandard'] = sys.modules['tokenizers'] = None\nimport __spark_entry__ as e\nassert 'op7_warc' not in e.queries() and 'pipeline' not in e.queries() and 'dir_rollup' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_workers_get_the_package(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "q = e.queries().get('op5_personal_data')\nassert q is None or q(spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    subprocess.run([sys.executable, "-c", code, ROOT], cwd=tmp_path, check=True, timeout=240, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
