"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the key. A bucket of
depth d holds the rows whose hashes share d bits; only a bucket over the byte
limit splits on its next bit, so depths differ with the data. The directory
comes from a histogram of byte sums by prefix, never from rows in one task:
bucket totals at every depth are sums of the histogram, and a row's shard is
the shallowest bucket on its path that fits. Buckets that do not fit at the
histogram's depth, and those alone, get a histogram over further bits.

Defined results
  null or repeated keys   hash like any value; rows of one key share a bucket
  null text, empty text   0 bytes
  rows of one hash that exceed the limit together (repeated keys, a text over
                          the limit): depth HASH_BITS, cut into pages by a salt
                          of the text; a row over half the limit has a page of
                          its own, and only a single row can exceed the limit.
                          There are so many salts that one has about four pages
                          of the largest hash
  empty table             no shards, no rows
  extra columns           kept; the added names are SHARD_COLUMNS
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.llm.exprs import text_or_empty
from quarrywork.llm.scratch import Scratch

HASH_BITS = 60
SHARD_COLUMNS = ("shard", "shard_depth", "shard_bytes")
#: A directory of more entries is joined by a shuffle.
BROADCAST_ENTRIES = 100_000
#: Salts of the largest hash: at least so many, and one for so many limits of bytes.
LEAST_SALTS, SALT_PAGES = 64, 4


def text_hash(text: Column) -> Column:
    """60 bits of the MD5 of a text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def page_salts(largest: int, limit: int) -> int:
    return max(LEAST_SALTS, 1 << math.ceil(math.log2(max(1, largest / (SALT_PAGES * limit)))))


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(bits: int) -> Column:
    return F.shiftright("_h", HASH_BITS - bits)


def _directory(sizes: DataFrame, low: int, bits: int, limit: int) -> DataFrame:
    """(fine, depth, bucket, bytes): each prefix of so many bits, and the shallowest fitting bucket of depth low or more above it; nulls where none fits."""
    fine = sizes.groupBy(_prefix(bits).alias("fine")).agg(F.sum("_bytes").alias("bytes"))
    at = fine.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits)))).withColumn("bucket", F.expr(f"shiftright(fine, {bits} - depth)"))
    fits = at.groupBy("depth", "bucket").agg(F.sum("bytes").alias("total")).filter(F.col("total") <= limit)
    leaf = at.join(fits, ["depth", "bucket"]).groupBy("fine").agg(F.min(F.struct("depth", "bucket", "total")).alias("leaf"))
    return fine.select("fine").join(leaf, "fine", "left").select("fine", "leaf.*")


def _attach(rows: DataFrame, directory: DataFrame, bits: int, entries: int) -> DataFrame:
    named = directory.select(F.col("fine").alias("_fine"), F.struct("depth", "bucket", "total").alias(f"_leaf{bits}"))
    if entries <= BROADCAST_ENTRIES:
        named = F.broadcast(named)
    return rows.join(named, _prefix(bits) == F.col("_fine"), "left").drop("_fine")


def assign_shards(docs: DataFrame, limit_bytes: int = 256 << 20, key: str = "doc_id", text: str = "text", step_bits: int = 8) -> DataFrame:
    """The rows of docs with shard (depth and bucket, or depth, hash and page), shard_depth and shard_bytes."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    docs = docs.drop(*SHARD_COLUMNS)
    n_bytes = F.octet_length(text_or_empty(text)).cast("bigint")
    sizes = scratch.write(docs.select(key_hash(F.col(key)).alias("_h"), n_bytes.alias("_bytes")), "sizes")
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(24, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 4))
    rows, low, leaves = docs.withColumns({"_h": key_hash(F.col(key)), "_bytes": n_bytes}), 0, []
    while True:
        directory = scratch.write(_directory(sizes, low, bits, limit_bytes), f"directory{bits}")
        entries, over = directory.agg(F.count("*"), F.count(F.when(F.col("depth").isNull(), 1))).first()
        rows = _attach(rows, directory.filter(F.col("depth").isNotNull()), bits, entries)
        leaves.append(F.col(f"_leaf{bits}"))
        if not over or bits == HASH_BITS:
            break
        split = directory.filter(F.col("depth").isNull()).select("fine")
        split = F.broadcast(split) if over <= BROADCAST_ENTRIES else split
        sizes = sizes.join(split, _prefix(bits) == F.col("fine"), "left_semi")
        low, bits = bits + 1, min(HASH_BITS, bits + step_bits)
    leaf = F.coalesce(*leaves)
    rows = rows.withColumn("_leaf", leaf).drop(*[f"_leaf{b}" for b in range(HASH_BITS + 1)])
    named = {"shard": F.concat_ws("-", F.col("_leaf.depth").cast("string"), F.col("_leaf.bucket").cast("string")), "shard_depth": F.col("_leaf.depth"), "shard_bytes": F.col("_leaf.total")}
    fitting = rows.filter(F.col("_leaf").isNotNull()).withColumns(named) if over else rows.withColumns(named)
    helpers = ("_h", "_bytes", "_leaf", "_salt", "_page")
    if not over:
        return fitting.drop(*helpers)
    largest = sizes.join(directory.filter(F.col("depth").isNull()), F.col("_h") == F.col("fine"), "left_semi").groupBy("_h").agg(F.sum("_bytes").alias("n")).agg(F.max("n")).first()[0]
    one = W.partitionBy("_h", "_salt").orderBy("_bytes", text_hash(F.col(text)))
    alone = F.col("_bytes") * 2 > limit_bytes
    page = F.when(alone, F.concat(F.lit("own"), F.row_number().over(one).cast("string"))).otherwise(F.floor((F.sum("_bytes").over(one.rowsBetween(W.unboundedPreceding, 0)) - F.col("_bytes")) * 2 / limit_bytes).cast("string"))
    paged = rows.filter(F.col("_leaf").isNull()).withColumn("_salt", F.pmod(text_hash(F.col(text)), F.lit(page_salts(largest, limit_bytes)))).withColumn("_page", page)
    paged = paged.withColumns(
        {
            "shard": F.concat_ws("-", F.lit(str(HASH_BITS)), F.col("_h").cast("string"), F.col("_salt").cast("string"), "_page"),
            "shard_depth": F.lit(HASH_BITS),
            "shard_bytes": F.sum("_bytes").over(W.partitionBy("_h", "_salt", "_page")),
        }
    )
    return fitting.drop(*helpers).unionByName(paged.drop(*helpers))


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet files for each shard; a shard fits its limit, so each is one task's work."""
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


#: Production limit of the registered query. It is small beside the 256 MiB
#: default so that the test tables also split.
QUERY_LIMIT = 1 << 20


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n_bytes = F.octet_length(text_or_empty("text")).cast("bigint")
    return assign_shards(docs, QUERY_LIMIT).select("doc_id", n_bytes.alias("n_bytes"), "shard", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rowid_, doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, coalesce(text, '') AS x
  FROM documents),
a AS (SELECT d.*, CAST(depth AS INTEGER) AS depth, h >> (60 - depth) AS bucket FROM d, range(0, 61) r(depth)),
t AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS total FROM a GROUP BY ALL HAVING sum(n_bytes) <= {QUERY_LIMIT}),
s AS (SELECT doc_id, n_bytes, h, min(depth) AS depth FROM a JOIN t USING (depth, bucket) GROUP BY a.rowid_, doc_id, n_bytes, h),
u AS (SELECT d.*, CAST('0x' || substr(md5(x), 1, 15) AS BIGINT) AS th, sum(n_bytes) OVER (PARTITION BY h) AS whole FROM d WHERE h NOT IN (SELECT bucket FROM t WHERE depth = 60)),
p AS (SELECT *, th % CAST((SELECT greatest(64, pow(2, ceil(log2(greatest(1, max(whole) / {SALT_PAGES * QUERY_LIMIT}))))) FROM u) AS BIGINT) AS salt FROM u),
o AS (SELECT *, row_number() OVER w AS k, sum(n_bytes) OVER w - n_bytes AS before FROM p WINDOW w AS (PARTITION BY h, salt ORDER BY n_bytes, th ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, CASE WHEN n_bytes * 2 > {QUERY_LIMIT} THEN 'own' || k ELSE CAST(CAST(floor(before * 2 / {QUERY_LIMIT}) AS BIGINT) AS VARCHAR) END AS page FROM o)
SELECT doc_id, n_bytes, s.depth || '-' || (h >> (60 - s.depth)) AS shard, s.depth AS shard_depth, total AS shard_bytes
FROM s JOIN t ON t.depth = s.depth AND t.bucket = h >> (60 - s.depth)
UNION ALL SELECT doc_id, n_bytes, '60-' || h || '-' || salt || '-' || page, 60, CAST(sum(n_bytes) OVER (PARTITION BY h, salt, page) AS BIGINT) FROM g
"""
