"""Python tasks run where the package cannot be imported, as on executors of a cluster."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver alone
import __spark_entry__ as entry
from pyspark.sql import functions as F
from tallyward.session import local_session
spark = local_session("apart", cpus=4)

def absent(batches):
    import importlib.util
    for batch in batches:
        yield batch.assign(found=importlib.util.find_spec("tallyward") is not None)

assert not spark.range(1).mapInPandas(absent, "id long, found boolean").first()["found"]
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
    print("ran", name)
"""


def run_apart(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "apart.py"
    script.write_text(SCRIPT.format(root=str(ROOT), names=names))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("ran ") == len(names)


def test_operators_run_without_the_package_on_executors(tmp_path):
    run_apart(
        tmp_path,
        ["op2_minhash_forest", "op3_language_mixture", "op4_leak_index", "op9_toxic_spans", "op10_substring_dedup", "op11_whitening", "op12_word_runs", "op13_quality_net"],
    )
