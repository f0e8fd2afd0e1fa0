"""The library alone: without the optional folders and without a preset shared folder."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import os
import __spark_entry__ as registry
assert os.path.dirname(os.path.abspath(registry.__file__)) == os.getcwd()
from skyledger.session import local_session, materialize, shared_dir

names = registry.queries()
assert not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
assert set(registry.oracle_sql()) <= set(names) and len(names) > 100
spark = local_session(2, shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = shared_dir(spark)
assert shared_dir(spark.newSession()) == folder
assert materialize(spark.range(5)).count() == 5
assert names["period_trend_week"](spark, "/root/testdata/sf0.001").count() > 0
assert names["drought_score"](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def test_registry_and_queries_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "skyledger"), copy / "skyledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        # The pipeline alone is of no use and must not break the rest.
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    env |= {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and done.stdout.strip().endswith("fine"), done.stdout[-2000:] + done.stderr[-4000:]
