"""The shared folder and what is written there."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from campovia import session


def test_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        context.master = master
        with pytest.raises(ValueError):
            session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))


def test_settings_come_first():
    conf = SimpleNamespace(get=lambda key, default=None: "hdfs:/shared")
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    assert session.shared_dir(SimpleNamespace(conf=conf, sparkContext=context)) == "hdfs:/shared"


def test_local_session_takes_a_temporary_folder(spark):
    assert session.shared_dir(spark)
    assert session.durable(spark.range(5)).count() == 5


def test_buckets_save_the_shuffle(spark):
    rows = session.bucketed(spark.range(1000).withColumn("chunk", F.col("id") % 7), "chunk", 8)
    counts = rows.groupBy("chunk").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["count"] for r in counts.collect()) == [142] + [143] * 6
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("campovia_")]
