from pathlib import Path

import pytest

from stratalens import session


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Context:
    def __init__(self, master, known=None):
        self.master, self.known = master, known

    def getCheckpointDir(self):
        return self.known

    def setCheckpointDir(self, path):
        self.known = path

    def getConf(self):
        return Conf()


class Session:
    def __init__(self, master, known=None, **conf):
        self.sparkContext, self.conf = Context(master, known), Conf(**conf)


def test_named_folder_is_used():
    cluster = Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///shared"})
    assert session.shared_dir(cluster) == "hdfs:///shared"
    assert cluster.sparkContext.getCheckpointDir() == "hdfs:///shared"
    assert session.scratch_path(cluster, "x").startswith("hdfs:///shared/x-")


def test_folder_already_set_is_kept():
    assert session.shared_dir(Session("yarn", known="hdfs:///set")) == "hdfs:///set"


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("yarn"))


def test_local_master_may_use_a_temporary_folder():
    assert Path(session.shared_dir(Session("local[2]"))).exists()


def test_materialized_rows_are_cut_from_their_plan(spark):
    frame = session.materialize(spark.range(10).selectExpr("id * 2 AS v"))
    assert "Range" not in frame._jdf.queryExecution().analyzed().toString()
    assert frame.count() == 10
