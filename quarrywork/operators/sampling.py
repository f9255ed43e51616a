"""Exact seeded samples that don't depend on how the rows are dealt, and the stored lists of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digits of the hash that the histogram reads: 16 to the fifth buckets.
DIGITS = 5


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n distinct keys (all, if they are fewer) whose seeded hashes are smallest; null keys are no ids.

    A histogram of the hashes' first digits finds the bucket in which the nth
    lies: lower buckets are taken whole, and only that bucket is sorted.
    """
    hashed = rows.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", seeded_hash(F.col(key), seed))
    bucket = F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("int")
    counts = sorted(hashed.groupBy(F.shiftright(bucket, 4 * DIGITS - 12).alias("b")).count().collect())  # 4096 rows at most
    before, edge = 0, 1 << 12
    for b, k in counts:
        if before + k >= n:
            edge = b
            break
        before += k
    coarse = F.shiftright(bucket, 4 * DIGITS - 12)
    rest = hashed.filter(coarse == edge).orderBy("_h", key).limit(max(0, n - before))
    return hashed.filter(coarse < edge).select(key).unionByName(rest.select(key))


def stored_sample(rows: DataFrame, key: str, n: int, seed: int, path: str) -> DataFrame:
    """seeded_sample, written once: where path has a list of ids, that list holds, whatever rows are now."""
    spark = rows.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        seeded_sample(rows, key, n, seed).orderBy(key).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
