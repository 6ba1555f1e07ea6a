"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException

from crawlweave import Workspace
from crawlweave.workspace import shared_root


def session(master, folder=None):
    unset = SimpleNamespace(get=lambda key, default=None: folder)
    context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: unset)
    return SimpleNamespace(conf=unset, sparkContext=context)


def test_shared_folder_is_taken_from_the_session():
    assert shared_root(session("yarn", "hdfs:///work/")) == "hdfs:///work"
    with pytest.raises(ValueError):
        shared_root(session("yarn"))
    first = shared_root(session("local[2]"))
    assert first == shared_root(session("local[2]")) and "crawlweave-" in first


def test_bucketed_tables_append_and_drop(spark):
    ws = Workspace(spark)
    rows = spark.range(10).withColumnRenamed("id", "k")
    ws.save_bucketed(rows, "t", ["k"])
    both = ws.save_bucketed(rows, "t", ["k"], mode="append")
    assert both.count() == 20
    plan = both.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    inner = ws.child("call")
    inner.save(rows, "u")
    assert inner.load("u").count() == 10 and inner.root != ws.child("call").root
    ws.clean()
    assert not spark.catalog.tableExists(f"crawlweave_{ws.run_id}_t")
    for path in (ws.path("t"), inner.path("u")):
        with pytest.raises(AnalysisException):
            spark.read.parquet(path)
