"""Sessions."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def make_session(name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that lattice plans are tuned for; SPARK_MASTER or ``master`` chooses where it runs."""
    builder = SparkSession.builder.appName(name)
    if master or os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def quiet(spark: SparkSession, level: str = "ERROR", after: str = "WARN") -> Iterator[None]:
    """Hold Spark's log at a level for a while."""
    spark.sparkContext.setLogLevel(level)
    try:
        yield
    finally:
        spark.sparkContext.setLogLevel(after)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session may lack one; it then gets ``/tmp/checkpoints``.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path is None and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = (path or "file:///tmp/checkpoints").rstrip("/")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
