"""Folders for written intermediate tables of the engine's own operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write: under spark.checkpoint.dir, or, on a local master, a local one where that is unset. It goes when the driver ends."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{named.rstrip('/') if named else 'file://' + tempfile.mkdtemp(prefix='quarrywork-')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path
