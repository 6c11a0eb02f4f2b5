"""Session settings and the shared folder."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from tidemark.session import scratch_path, shared_dir


class FakeContext:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


def fake_session(master, configured=None, directory=None):
    conf = SimpleNamespace(get=lambda key, default: configured if configured is not None else default)
    return SimpleNamespace(sparkContext=FakeContext(master, directory), conf=conf)


def test_configured_folder_is_used_everywhere():
    session = fake_session("spark://host:7077", configured="hdfs:///shared")
    assert shared_dir(session) == "hdfs:///shared"
    assert session.sparkContext.directory == "hdfs:///shared"
    assert scratch_path(session, "x").startswith("hdfs:///shared/x-")


def test_folder_set_on_the_context_is_kept():
    session = fake_session("spark://host:7077", directory="hdfs:///own/1")
    assert shared_dir(session) == session.sparkContext.directory == "hdfs:///own/1"


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake_session("yarn"))


def test_local_session_gets_its_own_folder():
    assert os.path.isdir(shared_dir(fake_session("local[2]")))


def test_adaptive_execution_is_on(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
