"""Written intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names the folder on a cluster. Where it is unset, a
local temporary folder is made on a local master (tests, one machine); any other
master raises, as executors would each write to a disk of their own. A written table cuts
lineage and survives lost executors; the tables of an application go when the
driver ends, or earlier through :meth:`Scratch.drop`.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="quarrywork-")
    return _local[app]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Settings of a writing action, each the least of this and the session's. Rows of texts or sets are large, so Arrow
#: batches end at fewer rows or bytes than by default. The virtual machine never compiles methods of over 8000 bytes,
#: so that larger generated ones would be interpreted; under this limit Spark splits them.
_BOUNDS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20,
    "spark.sql.codegen.hugeMethodLimit": 8000,
}


@contextlib.contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    """The bounds for one action; the session's own settings after it."""
    before = {name: spark.conf.get(name) for name in _BOUNDS}
    for name, most in _BOUNDS.items():
        digits = before[name].rstrip("b")
        now = int(digits) if digits.isdigit() else 0
        spark.conf.set(name, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Scratch:
    """A folder for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, self.path)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", group_mb: int = 128) -> DataFrame:
        """Writes df as Parquet and returns the written table. group_mb: the row groups, smaller for rows of large values."""
        path = f"{self.path}/{name}"
        with _bounded(self.spark):
            self._save(df, path, codec, group_mb)
        return self.spark.read.schema(df.schema).parquet(path)

    def _save(self, df: DataFrame, path: str, codec: str, group_mb: int) -> None:
        df.write.mode("overwrite").option("compression", codec).option("parquet.block.size", str(group_mb << 20)).parquet(path)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.path}/{name}" if name else self.path)
