"""Input discovery as queries over a listing of files (path, modified)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.text import time_tag


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, modified) of files; their contents aren't read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"))


def newest_inputs(files: DataFrame, dataset: Column, tag: str | None = None) -> DataFrame:
    """One file for each dataset: with the tag if given, hard before single ones, enriched before plain, then by the time in the name, then by modification, then by name."""
    kept = files.filter(F.contains("path", F.lit(tag))) if tag else files
    rank = W.partitionBy("dataset").orderBy(F.contains("path", F.lit("hard")).desc(), F.contains("path", F.lit("enriched")).desc(), time_tag(F.col("path")).desc(), F.desc("modified"), F.desc("path"))
    return kept.withColumn("dataset", dataset).withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def split_inputs(spark: SparkSession, text: str) -> list[str]:
    """The paths of a comma list, in order; a part with a wild-card stands for its matches, sorted. Listed by the file system of each path."""
    out: list[str] = []
    for part in (p.strip() for p in (text or "").split(",")):
        if any(c in part for c in "*?["):
            path = spark._jvm.org.apache.hadoop.fs.Path(part)
            found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
            out += sorted(str(f.getPath()) for f in found or ())
        elif part:
            out.append(part)
    return out


def latest(files: DataFrame, tag: str | None = None) -> DataFrame:
    """The lexicographically last path, of those with the tag if there are any; raises on an empty listing."""
    tagged = F.contains("path", F.lit(tag)) if tag else F.lit(True)
    out = files.agg(F.max(F.struct(tagged.cast("int").alias("tagged"), "path")).path.alias("path"))
    if out.first().path is None:
        raise FileNotFoundError("no file matches")
    return out


def latest_manifest(files: DataFrame, tag: str | None = None) -> DataFrame:
    """The path of the newest manifest, tagged ones first."""
    tagged = F.contains("path", F.lit(tag)) if tag else F.lit(False)
    order = F.struct(tagged.cast("int").alias("tagged"), "modified", "path")
    return files.filter(F.endswith("path", F.lit(".manifest.json"))).agg(F.max(order).path.alias("path"))


def has_field(df: DataFrame, name: str) -> bool:
    """By schema alone."""
    return name in df.schema.fieldNames()


def looks_enriched(spark: SparkSession, path: str, name: str, rows: int = 8) -> bool:
    """Whether one of the first entries of a file of keyed JSON has the field."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "v")).limit(rows)
    return not entries.filter(F.get_json_object("v", f"$.{name}").isNotNull()).isEmpty()


def fingerprint(corpus: DataFrame, key: str, text: str, settings: str) -> DataFrame:
    """One row: a hash of rows in any order and of settings, by which a stored index is reused."""
    row = F.sha1(F.concat_ws("\x01", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    return corpus.agg(F.count("*").alias("n"), *[part(k).alias(f"p{k}") for k in range(5)]).select(F.sha1(F.concat_ws(":", F.lit(settings), "n", *[f"p{k}" for k in range(5)]).cast("binary")).alias("fingerprint"))


def cached(df: DataFrame, folder: str, print_of: DataFrame) -> DataFrame:
    """df as a written table in a folder named by a fingerprint: read if it is there, else written first. An empty table raises."""
    spark = df.sparkSession
    path = f"{folder}/{print_of.first()[0]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if out.isEmpty():
        raise ValueError("the corpus is empty")
    return out


def cached_vectors(corpus: DataFrame, key: str, model: str, folder: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(model, key, vector and more) of encode(corpus), kept by model and keys: texts aren't compared, and only keys without a vector of the model are encoded."""
    spark = corpus.sparkSession
    path = f"{folder}/vectors"
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    kept = spark.read.parquet(path).filter(F.col("model") == model) if exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists) else None
    new = corpus if kept is None else corpus.join(kept.select(key), key, "left_anti")
    if not new.isEmpty():
        encode(new).withColumn("model", F.lit(model)).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("model") == model).join(corpus.select(key), key, "left_semi")
