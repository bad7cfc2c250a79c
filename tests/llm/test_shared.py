import os
import subprocess
import sys

import pytest

from quire.llm import shared

DATA = "/root/testdata/sf0.001"
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
from quire.llm import shared
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, sys.argv[1]).count())
print("folder", shared.folder(spark))
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_session_without_a_shared_folder(tmp_path):
    """All queries run where spark.checkpoint.dir is unset, and leave no folder."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", SCRIPT, DATA], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    lines = [line.split() for line in done.stdout.splitlines() if " " in line]
    got = {line[0]: line[1] for line in lines if len(line) == 2}
    assert len(got) == 12 and got["folder"].startswith("file:///")
    assert not os.path.exists(got["folder"].removeprefix("file://"))


def test_scratch_is_removed(spark):
    with shared.Scratch(spark) as scratch:
        assert scratch.save(spark.range(3), "x").count() == 3
        path = scratch.root.removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    with shared.swept():
        one = shared.Scratch(spark)
        with shared.swept():
            two = shared.Scratch(spark)
            two.save(spark.range(2), "y")
        one.save(spark.range(2), "y")
        assert not os.path.exists(two.root.removeprefix("file://")) and os.path.exists(one.root.removeprefix("file://"))
    assert not os.path.exists(one.root.removeprefix("file://"))
