"""Records as retrieval sees them: weighted token bags, short texts for dense vectors, and the join of ranked rows to vectors.

A record is a row of line (the suspicious one), code (its function), nodes (an
array of structs with code and reason), file_name, file_path and project.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarrywork.functions.text import repeat_tokens, strip, tokenize
from quarrywork.functions.vectors import cosine

# Weights of a record's fields, and how much of each counts.
WEIGHTS = {"line": 3.0, "code": 0.6, "node": 1.2, "reason": 0.8, "file": 0.4, "project": 0.3}
CODE_TOKENS, NODES, NODE_TOKENS, REASON_TOKENS = 256, 5, 64, 32
DOCUMENT_REASONS, QUERY_REASONS, DOCUMENT_TOKENS = 3, 5, 120

Record = dict[str, Column]


def _head(nodes: Column, n: int) -> Column:
    return F.coalesce(F.slice(nodes, 1, n), F.array().cast("array<struct<code:string,reason:string>>"))


def weighted_tokens(record: Record, weights: dict[str, float] = WEIGHTS) -> Column:
    """The tokens of a record, each field as often as its weight says."""
    node = lambda n: F.concat(repeat_tokens(F.slice(tokenize(n["code"]), 1, NODE_TOKENS), weights["node"]), repeat_tokens(F.slice(tokenize(n["reason"]), 1, REASON_TOKENS), weights["reason"]))
    return F.concat(
        repeat_tokens(tokenize(record["line"]), weights["line"]),
        repeat_tokens(F.slice(tokenize(record["code"]), 1, CODE_TOKENS), weights["code"]),
        F.flatten(F.transform(_head(record["nodes"], NODES), node)),
        repeat_tokens(tokenize(record["file_name"]), weights["file"]),
        repeat_tokens(tokenize(record["file_path"]), weights["file"]),
        repeat_tokens(tokenize(record["project"]), weights["project"]),
    )


def _text(record: Record, reasons: int, *more: Column) -> Column:
    said = F.array_join(F.filter(F.transform(_head(record["nodes"], reasons), lambda n: strip(n["reason"])), lambda x: x != ""), " | ")
    parts = F.array(*[F.coalesce(c, F.lit("")) for c in (record["line"], record["file_name"], record["file_path"], said, *more)])
    return F.array_join(F.filter(parts, lambda x: x != ""), " \n ")


def document_text(record: Record) -> Column:
    """What a corpus vector is made of: the line, the file, three reasons and the first 120 tokens of the function."""
    return _text(record, DOCUMENT_REASONS, F.array_join(F.slice(tokenize(record["code"]), 1, DOCUMENT_TOKENS), " "))


def query_text(record: Record) -> Column:
    """What a query vector is made of: five reasons and no function."""
    return _text(record, QUERY_REASONS)


def batch_encoder(load: Callable[[], Callable], inputs: list[Column], key: str, vector: str, batch_size: int = 256) -> Callable[[DataFrame], DataFrame]:
    """An encoder for with_similarity: a model that each worker loads once (load returns a function of numpy batches) over batches of the inputs."""
    model = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return lambda missing: missing.select(key, model(*inputs).alias(vector))


def with_similarity(ranked: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, query: str, vector: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ranked (query, key and more) with cos, the cosine to the query's vector. Rows whose key has no stored vector are encoded: encode gets the distinct missing keys and returns (key, vector). Every ranked row stays; cos is null where a side has no vector."""
    missing = ranked.select(key).distinct().join(vectors.select(key), key, "left_anti")
    known = vectors.select(key, F.col(vector).alias("_v")).unionByName(encode(missing).select(key, F.col(vector).alias("_v")))
    asked = queries.select(query, F.col(vector).alias("_q"))
    return ranked.join(known, key, "left").join(asked, query, "left").withColumn("cos", cosine(F.col("_q"), F.col("_v"))).drop("_q", "_v")


def dense_rerank(ranked: DataFrame, query: str, key: str, sparse: str = "norm", weight: float = 0.6) -> DataFrame:
    """ranked (query, key, the sparse score from 0 to 1, cos) with dense, cos from 0 to 1 over each query's rows (0 without a vector, 0 for all if they are equal), fused, and rank; a query's rows are a top list, so few."""
    w = W.partitionBy(query)
    low, high = F.min("cos").over(w), F.max("cos").over(w)
    dense = F.coalesce(F.when(high > low, (F.col("cos") - low) / (high - low)), F.lit(0.0))
    fused = (1 - weight) * F.col(sparse) + weight * F.col("dense")
    return ranked.withColumn("dense", dense).withColumn("fused", fused).withColumn("rank", F.row_number().over(w.orderBy(F.desc("fused"), key)))
