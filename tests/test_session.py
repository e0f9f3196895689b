import os
import subprocess
import sys

import pytest

from sparkrec import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None


class _Session:
    def __init__(self, master):
        self.sparkContext = _Context(master)
        self.conf = self

    def get(self, key, default=None):
        return default


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(_Session(master))


def test_operators_with_python_workers_ship_the_package(tmp_path):
    """An operator called directly, from another folder, finds the package in its workers."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from sparkrec.session import local_session
from sparkrec.operators import fold
spark = local_session(2, 2)
df = spark.sql("select 1L as user_id, timestamp'2024-01-01' as ts, 1.0D as weight, array(3.0D, 4.0D) as embedding")
assert fold.profile_from_ratings(df, order=["ts"]).first().profile_vec == [0.6, 0.8]
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
