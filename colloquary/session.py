"""Session settings, and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# Left to the cluster on purpose: executors, memory, shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # sessions are merged before the shuffle, so a busy key sends sessions, not rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # best-of-k rankings are cut down to k rows before the shuffle up to this k
    "spark.sql.window.group.limit.threshold": "100000",
    # state of many keys does not fit the heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "colloquary", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where that setting is missing and Spark runs on one machine (tests, a laptop), a local
    one is made; on a cluster, whose machines would not see each other's, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a shared folder for {master}")
        root = _local_folder()
    return f"{root.rstrip('/')}/colloquary/{name}-{uuid.uuid4().hex}"
