"""The checkpoint folder in sessions without any setting of the installation."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT

PLAIN = """
from wholesail.session import checkpoint_dir, local_session
spark = local_session(cores=1, shuffle_partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
folder = checkpoint_dir(spark)
assert folder == checkpoint_dir(spark) or checkpoint_dir(spark).startswith("file:")
assert spark.range(3).checkpoint(eager=True).count() == 3
print("checkpoint written")
"""


def test_checkpoints_without_the_setting():
    conf = tempfile.mkdtemp(prefix="wholesail-test-conf-", dir="/tmp")
    env = {**os.environ, "SPARK_CONF_DIR": conf, "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=300)
    assert "checkpoint written" in done.stdout, done.stderr[-2000:]
