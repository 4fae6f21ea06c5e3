"""Python stages run although workers cannot import the package: it is sent to them."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from topicloom.runtime import local_session
spark = local_session(cores=4, shuffle_partitions=4, memory="2g")
for name in ("pcoa_2d", "merge_bigrams", "read_collections", "fit_per_document"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0, name
"""


def test_workers_need_no_installed_package(sf, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
