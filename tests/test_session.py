from types import SimpleNamespace

import pytest

from colloquary.session import shared_folder


class _Conf(dict):
    def get(self, key, default):
        return super().get(key, default)


class _Session:
    def __init__(self, master="local[4]", **conf):
        self.conf = _Conf(**conf)
        self.sparkContext = SimpleNamespace(master=master)


def test_folder_is_below_the_one_the_cluster_names():
    session = _Session(**{"spark.checkpoint.dir": "hdfs://shared/check/"})
    a, b = shared_folder(session, "x"), shared_folder(session, "x")
    assert a != b and a.startswith("hdfs://shared/check/colloquary/x-")


def test_folder_without_the_setting():
    assert shared_folder(_Session(), "x").startswith("/tmp/spark-")


def test_a_cluster_must_name_a_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_folder(_Session(master), "x")
