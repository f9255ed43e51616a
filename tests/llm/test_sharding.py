import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from quarrywork.llm import sharding
from quarrywork.llm.sharding import HASH_BITS, assign_shards


def test_buckets_fit_and_follow_the_hash(docs, corpus):
    rows = assign_shards(docs, 4096).collect()
    assert len(rows) == len(corpus)
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += len((r.text or "").encode())
    for r in rows:
        assert total[r.shard] == r.shard_bytes
        if r.shard_depth < HASH_BITS:
            h = int(hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16)
            assert r.shard == f"{r.shard_depth}-{h >> (60 - r.shard_depth)}"
            assert r.shard_bytes <= 4096
    # Only a text over half the limit stands alone beyond it.
    over = {s: n for s, n in total.items() if n > 4096}
    assert all(sum(r.shard == s for r in rows) == 1 for s in over)


def test_only_oversized_buckets_split(docs):
    rows = assign_shards(docs, 20_000).select("shard_depth", "shard_bytes").distinct().collect()
    assert len({r.shard_depth for r in rows}) > 1


def test_repeated_keys_are_cut_into_pages(spark):
    df = spark.range(400).select(F.lit(1).alias("doc_id"), F.concat(F.lit("x" * 90), F.col("id").cast("string")).alias("text"), F.lit("?").alias("shard"))
    rows = assign_shards(df, 1000).groupBy("shard", "shard_bytes").agg(F.sum(F.length("text")).alias("n")).collect()
    assert all(r.n == r.shard_bytes <= 1000 for r in rows) and sum(r.n for r in rows) > 36_000


def test_empty(empty):
    assert assign_shards(empty, 10).count() == 0


def test_sql_covers_pages_and_repeated_rows(spark, docs):
    import duckdb

    more = spark.range(300).select(F.lit(9000).alias("doc_id"), F.concat(F.lit("y" * 90), F.col("id").cast("string")).alias("text"))
    rows = docs.select("doc_id", "text").unionByName(more)
    limit = 500
    got = assign_shards(rows, limit).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), "shard", "shard_depth", "shard_bytes").collect()
    documents = rows.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    sql = sharding.ORACLE.replace(str(sharding.SALT_PAGES * sharding.QUERY_LIMIT), str(sharding.SALT_PAGES * limit)).replace(str(sharding.QUERY_LIMIT), str(limit))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(sql).fetchall()))
    assert any(r.shard_depth == HASH_BITS for r in got)


def test_salts_grow_with_the_largest_hash():
    assert [sharding.page_salts(n, 1 << 20) for n in (0, 1 << 28, (1 << 28) + 1, 1 << 40)] == [64, 64, 128, 1 << 18]
