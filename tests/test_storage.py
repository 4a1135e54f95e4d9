"""The shared folder: read from the session, made up only where driver and executors are one process."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from carefold import storage
from carefold.storage import checkpointed, materialize, shared_dir


class Session:
    """A session's settings and master."""

    def __init__(self, master: str, **settings: str):
        self.settings = settings
        self.conf = self.sparkContext = self
        self.master = master
        self.applicationId = f"app-{id(self)}"

    def get(self, name: str, default: str | None) -> str | None:
        return self.settings.get(name, default)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(master), "x")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_process_gets_a_folder_of_its_own_once(master):
    session, other = Session(master), Session(master)
    a, b, c = shared_dir(session, "x"), shared_dir(session, "x"), shared_dir(other, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] != c.rsplit("/", 1)[0]


def test_the_session_names_the_folder():
    assert shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs://n/shared/"}), "x").startswith("hdfs://n/shared/x-")


def test_a_folder_without_a_file_system_is_in_the_default_one(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert storage.qualified(spark, "/user/x/ckpt") == "file:///user/x/ckpt"
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://store")
        conf.set("fs.viewfs.mounttable.store.link./user", "file:///tmp")
        assert storage.qualified(spark, "/user/x/ckpt") == "viewfs://store/user/x/ckpt"
    finally:
        conf.set("fs.defaultFS", before)


_ALONE = """
from pyspark.sql import SparkSession
from carefold.storage import checkpointed, materialize, release
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
rows = materialize(spark.range(5), "rows")
assert rows.count() == 5 and checkpointed(spark.range(7)).count() == 7
print("FOLDER", rows.inputFiles()[0], release(spark), release(spark))
"""


def test_a_local_session_without_the_setting(tmp_path):
    """Its folder is made up, and what was stored there goes when it is released."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", _ALONE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    _, file, gone, again = next(line for line in done.stdout.splitlines() if line.startswith("FOLDER")).split()
    assert "carefold-shared" in file and (gone, again) == ("1", "0") and not Path(file.removeprefix("file://")).parent.exists()


def test_materialized_rows_come_back(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "n long, t string")
    back = materialize(df, "rows")
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    assert not back.inputFiles()[0].startswith("/tmp/carefold-shared")


def test_checkpointed_rows_keep_their_partitions(spark):
    df = spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id")
    parts = [[r.id for r in p] for p in checkpointed(df).rdd.glom().collect() if p]
    assert sum(parts, []) == list(range(100)) and len(parts) > 1
