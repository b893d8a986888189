"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and the master is local (tests, one machine), a temporary folder becomes its value. On a cluster an unset one is an error: no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = kept.rsplit("/", 1)[0] if kept else "file://" + tempfile.mkdtemp(prefix="voxlake-")
        if not kept:
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path
