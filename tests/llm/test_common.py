import os
import subprocess
import sys

import pytest

from glyphmill.llm import common


class Session:
    def __init__(self, **conf):
        found = {k.replace("_", "."): v for k, v in conf.items()}
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, other=None: found.get(k, other))})


def test_clusters_need_a_shared_folder(monkeypatch):
    monkeypatch.delattr(common.shared_dir, "own", raising=False)
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(Session(spark_master=master))
    assert common.shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[*]", "local[4]"):
        assert common.shared_dir(Session(spark_master=master)).startswith("file://")


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, f"r{i}") for i in range(101)], "part long, `a.b` string").repartition(5)
    rows = common.numbered(df, df.part).collect()
    assert sorted((r.nth, r.part) for r in rows) == [(i, i) for i in range(101)] and rows[0]["a.b"].startswith("r")
    assert common.numbered(df.limit(0), df.part).count() == 0


def test_files_of_exchanges_go_with_their_cut(tmp_path):
    script = """
import glob, time
from pyspark.sql import SparkSession
from glyphmill.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{AT}/shared").getOrCreate()
out = common.cut(spark.range(1000).repartition(3).selectExpr("id % 7 AS k").groupBy("k").count())
for _ in range(40):
    left = glob.glob(f"{AT}/local/**/shuffle_*.data", recursive=True)
    if not left:
        break
    time.sleep(0.1)
print("LEFT", len(left), sorted(r["count"] for r in out.collect()), spark.conf.get(common.CLEANUP))
"""
    env = os.environ | {"SPARK_LOCAL_DIRS": f"{tmp_path}/local"}
    said = subprocess.run([sys.executable, "-c", script.replace("{AT}", str(tmp_path))], env=env, capture_output=True, text=True, timeout=120)
    assert "LEFT 0 [142, 143, 143, 143, 143, 143, 143] false" in said.stdout, said.stdout + said.stderr[-2000:]
