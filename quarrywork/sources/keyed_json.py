"""Sources and sinks: keyed JSON objects, unions with key collisions, resume, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def read_keyed_json(spark: SparkSession, path: str | list[str], row: T.StructType | str, key: str = "id") -> DataFrame:
    """One row for each entry of files that hold one object by id, or a list (keyed by position). Adds the key and _file. A file is one value on its way, so read such files once and keep Parquet."""
    shape = row.simpleString() if isinstance(row, T.StructType) else (row if row.lower().startswith("struct<") else f"struct<{row}>")
    files = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    is_list = F.ltrim("value").startswith("[")
    by_key = files.filter(~is_list).select("_file", F.explode(F.from_json("value", f"map<string,{shape}>")).alias(key, "_v"))
    by_place = files.filter(is_list).select("_file", F.posexplode(F.from_json("value", f"array<{shape}>")).alias("_p", "_v")).select("_file", F.col("_p").cast("string").alias(key), "_v")
    return by_key.unionByName(by_place).filter(F.col("_v").isNotNull()).select(key, "_v.*", "_file")


def union_with_suffixes(key: str, *tables: DataFrame) -> DataFrame:
    """All rows, in the order of the tables; the second and later rows of a key get #1, #2 and so on. Adds source_no."""
    marked = [t.withColumn("source_no", F.lit(k)).withColumn(key, F.col(key).cast("string")) for k, t in enumerate(tables)]
    out = marked[0]
    for t in marked[1:]:
        out = out.unionByName(t)
    n = F.row_number().over(W.partitionBy(key).orderBy("source_no")) - 1
    return out.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 0, F.concat(key, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a sink doesn't have."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame, settings: dict[str, str], *counted: str) -> DataFrame:
    """One row: the settings, the number of rows, and value counts of columns, as JSON."""
    counts = None
    for c in counted:
        one = df.groupBy(F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias("value")).count().select(F.lit(c).alias("column"), "value", "count")
        counts = one if counts is None else counts.unionByName(one)
    packed = counts.groupBy().agg(F.to_json(F.sort_array(F.collect_list(F.struct("column", "value", "count")))).alias("counts"))
    return packed.join(df.groupBy().agg(F.count("*").alias("n_rows")), how="cross").withColumns({k: F.lit(v) for k, v in settings.items()})
