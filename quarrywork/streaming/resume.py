"""Incremental runs: new files of a folder go through a transformation once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Processes the Parquet files under source that no earlier run has, and appends to sink; the checkpoint remembers them."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
