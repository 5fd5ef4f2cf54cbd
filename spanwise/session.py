"""The Spark session that the engine is run and measured with, and the folder that its driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(cores: int | None = None, app: str = "spanwise", **settings: str) -> SparkSession:
    """A session with adaptive execution. On a cluster, submit with your own master and only the last four matter."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    conf = {
        "spark.master": f"local[{n}]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
        "spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
    } | settings
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in for it if all runs on this machine; on a cluster it is an error, as
    each executor would write to a disk of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.spanwise.shared", None)
    if not set_dir:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.TemporaryDirectory(prefix="spanwise-")
        atexit.register(folder.cleanup)
        set_dir = f"file://{folder.name}"
        spark.conf.set("spark.spanwise.shared", set_dir)
    return set_dir.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own part of the shared folder."""
    name = spark.conf.get("spark.spanwise.session", None)
    if not name:
        name = uuid.uuid4().hex
        spark.conf.set("spark.spanwise.session", name)
    return f"{shared_dir(spark)}/spanwise/{name}"
