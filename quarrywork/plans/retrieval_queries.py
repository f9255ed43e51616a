"""Queries of retrieval: documents are the corpus, benchmark items the queries, embeddings the dense vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions import text as T
from quarrywork.operators import dense
from quarrywork.operators import retrieval as R
from quarrywork.operators import selection
from quarrywork.session import table

#: How many the first stage keeps, and how many are returned.
TOP_M, TOP_K = 200, 10

def token_stats(spark, d):
    toks = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def token_document_frequency(spark, d):
    toks = table(spark, d, "documents").select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("tok"))
    return toks.groupBy("tok").agg(F.count("*").alias("df"))


def weighted_bag(spark, d):
    t = T.tokenize(F.col("text"))
    bag = F.concat(T.repeat_tokens(t, 3.0), T.repeat_tokens(F.slice(t, 1, 256), 0.6), T.repeat_tokens(F.slice(t, 1, 64), 1.2), T.repeat_tokens(t, 0.0))
    return table(spark, d, "benchmark").select("item_id", F.size(bag).cast("bigint").alias("n"), F.md5(F.array_join(bag, " ").cast("binary")).alias("bag_md5"))


def query_expansion(spark, d):
    line = F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(c) for c in ("x[i]", "len(a)", "d.get(k)", "try:", "x is None")]), (F.col("item_id") % 5 + 1).cast("int")))
    hints = F.element_at(F.array(*[F.lit(h) for h in ("IndexError: list index out of range", "KeyError and an index", "ZeroDivision", "boundary; off-by-one")]), (F.col("item_id") % 4 + 1).cast("int"))
    out = T.expand_tokens(T.tokenize(F.col("text")), hints, line)
    return table(spark, d, "benchmark").select("item_id", F.array_join(out, " ").alias("tokens"))


EXPANSION = """
WITH q AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS t,
    concat_ws(' ', text, ['x[i]', 'len(a)', 'd.get(k)', 'try:', 'x is None'][item_id % 5 + 1]) AS line,
    lower(['IndexError: list index out of range', 'KeyError and an index', 'ZeroDivision', 'boundary; off-by-one'][item_id % 4 + 1]) AS hints FROM benchmark),
j AS (SELECT *, line || chr(10) || array_to_string(t, ' ') AS both_texts FROM q),
e AS (SELECT item_id, t
  || CASE WHEN contains(hints, 'indexerror') THEN ['index', 'out', 'range', 'len', 'range', 'bounds'] ELSE [] END
  || CASE WHEN contains(hints, 'out of range') THEN ['index', 'range', 'bounds', 'len'] ELSE [] END
  || CASE WHEN contains(hints, 'off-by-one') THEN ['index', 'range', 'len'] ELSE [] END
  || CASE WHEN contains(hints, 'keyerror') THEN ['dict', 'get', 'in', 'keys'] ELSE [] END
  || CASE WHEN contains(hints, 'zerodivision') THEN ['divide', 'zero', 'float'] ELSE [] END
  || CASE WHEN contains(hints, 'boundary') THEN ['min', 'max', 'clip'] ELSE [] END
  || CASE WHEN contains(both_texts, 'range(') THEN ['index', 'len'] ELSE [] END
  || CASE WHEN contains(both_texts, 'len(') THEN ['index', 'empty'] ELSE [] END
  || CASE WHEN contains(both_texts, '[') THEN ['index'] ELSE [] END
  || CASE WHEN contains(both_texts, '.get(') THEN ['dict', 'key'] ELSE [] END
  || CASE WHEN contains(both_texts, 'try:') THEN ['except'] ELSE [] END
  || CASE WHEN contains(both_texts, 'except') THEN ['try'] ELSE [] END
  || CASE WHEN contains(both_texts, 'is None') THEN ['none'] ELSE [] END
  || CASE WHEN contains(both_texts, '== None') THEN ['none'] ELSE [] END AS w FROM j),
u AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM e),
f AS (SELECT item_id, w[i] AS x, min(i) AS i FROM u GROUP BY item_id, w[i])
SELECT item_id, string_agg(x, ' ' ORDER BY i) AS tokens FROM f GROUP BY item_id"""


def _scores(spark, d) -> DataFrame:
    return R.bm25_scores(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


BM25 = r"""
WITH t AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
dt AS (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM t),
r AS (SELECT tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM dt, s GROUP BY tok, n),
i AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
qt AS (SELECT item_id, tok, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+')) AS tok FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, dl, tok, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS tok FROM t) WHERE tok IN (SELECT tok FROM qt) GROUP BY ALL),
b AS (SELECT item_id, doc_id, round(sum(qf * idf * (tf * 2.6 / (tf + 1.6 * (0.3 + 0.7 * dl / avgdl)))), 4) AS score FROM tf JOIN qt USING (tok) JOIN i USING (tok), s GROUP BY item_id, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM b)"""


def bm25_topk(spark, d):
    return R.top_k(_scores(spark, d), "item_id", "score", "doc_id", TOP_K)


def _ranked(spark, d) -> DataFrame:
    ranked = R.top_k(_scores(spark, d), "item_id", "score", "doc_id", TOP_M)
    return ranked.withColumn("scaled", F.round(R.min_max("score", "item_id"), 4))


def bm25_minmax(spark, d):
    return _ranked(spark, d).filter(F.col("rank") <= TOP_K).select("item_id", "doc_id", "rank", "scaled")


SCALED = BM25 + """,
m AS (SELECT *, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 4) AS scaled
  FROM k WHERE rank <= 200 WINDOW w AS (PARTITION BY item_id))"""


def _beside_texts(spark, d, found: DataFrame, most: int, *columns: str) -> DataFrame:
    """found (item_id, doc_id, and more; most rows of each item) with dt and qt, the words of both. While found is small it goes to the texts, and only its documents' texts are cut into words."""
    docs = table(spark, d, "documents").select("doc_id", "text", *columns)
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("_asked"))
    n = asked.limit(R.BROADCAST_ROWS + 1).count()
    both = docs.join(F.broadcast(found) if n * most <= R.BROADCAST_ROWS else found, "doc_id")
    both = both.join(F.broadcast(asked) if n <= R.BROADCAST_ROWS else asked, "item_id")
    return both.withColumns({"dt": T.tokenize(F.col("text")), "qt": T.tokenize(F.col("_asked"))}).drop("text", "_asked")


def _reranked(spark, d) -> DataFrame:
    both = _beside_texts(spark, d, _ranked(spark, d), TOP_M, "source")
    same = F.col("source") == F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    return R.rule_rerank(both, "item_id", "scaled", "doc_id", same, F.col("doc_id") % 3 == F.col("item_id") % 3, T.token_jaccard(F.col("dt"), F.col("qt")))


def bm25_rule_rerank(spark, d):
    return _reranked(spark, d).filter(F.col("final_rank") <= TOP_K).select("item_id", "doc_id", "final", "final_rank")


RERANKED = SCALED + """,
f AS (SELECT item_id, doc_id, round(scaled + CASE WHEN source = 'src' || (item_id % 20) THEN 0.10 ELSE 0 END + CASE WHEN doc_id % 3 = item_id % 3 THEN 0.05 ELSE 0 END
    + 0.5 * CASE WHEN len(toks) = 0 OR len(qs) = 0 THEN 0 ELSE len(list_intersect(toks, qs)) / len(list_distinct(toks || qs)) END, 4) AS final
  FROM m JOIN t USING (doc_id) JOIN (SELECT item_id, list(tok) AS qs FROM qt GROUP BY item_id) q USING (item_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY final DESC, doc_id) AS final_rank FROM f)"""


def retrieval_margin(spark, d):
    return R.confidence(_reranked(spark, d), "item_id", "final", "final_rank")


def dense_cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return R.cosine_top_k(v.filter("vec_id % 100 = 0"), v, "vec_id", "embedding", TOP_K).withColumnRenamed("query", "query_id")


COS = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS query_label,
  round(list_dot_product(q.v, e.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-12) * (sqrt(list_dot_product(e.v, e.v)) + 1e-12)), 4) AS cos
  FROM e q JOIN e ON q.vec_id % 100 = 0)"""


def _dense(spark, d) -> DataFrame:
    """The TOP_M best of all vectors, itself included, for a stated query set, with a label score as the sparse side."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.col("label").alias("query_label"))
    both = dense.nearest(asked, v, "query_id", "qv", "vec_id", "embedding", TOP_M)
    scored = both.select("query_id", "vec_id", "cos", (F.lit(1.0) / (1 + F.abs(F.col("label") - F.col("query_label")))).alias("sparse"))
    return R.top_k(scored, "query_id", "cos", "vec_id", TOP_M)


def fused_topk(spark, d):
    top = _dense(spark, d)
    fused = top.withColumn("fused", F.round(R.fuse(R.min_max("sparse", "query_id"), R.min_max("cos", "query_id")), 4))
    return R.top_k(fused, "query_id", "fused", "vec_id", TOP_K, "fused_rank").select("query_id", "vec_id", "fused", "fused_rank")


def self_excluded_neighbours(spark, d):
    """The query's own row is scaled with the others and only then left out."""
    top = _dense(spark, d).withColumn("scaled", F.round(R.min_max("cos", "query_id"), 4))
    return R.top_k(top.filter("vec_id != query_id"), "query_id", "scaled", "vec_id", 5, "place").select("query_id", "vec_id", "scaled", "place")


FUSED = COS + """,
k AS (SELECT *, 1.0 / (1 + abs(label - query_label)) AS sparse, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS r FROM p),
m AS (SELECT *, CASE WHEN max(cos) OVER w > min(cos) OVER w THEN (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) ELSE 0 END AS dn,
  CASE WHEN max(sparse) OVER w > min(sparse) OVER w THEN (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) ELSE 0 END AS sn
  FROM k WHERE r <= 200 WINDOW w AS (PARTITION BY query_id))"""


def exact_dup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    return selection.keep_first(docs, F.col("h"), "doc_id")


def normalized_hash_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", T.normalized_hash(F.col("text")).alias("h"))
    w = W.partitionBy("source")
    return selection.keep_first(docs, F.struct("source", "h"), "doc_id").select("source", "doc_id", F.count("*").over(w).alias("kept_n"))


def project_overlap_pairs(spark, d):
    """Shared words of the query set's texts and their best match."""
    best = R.top_k(_scores(spark, d), "item_id", "score", "doc_id", 1)
    both = _beside_texts(spark, d, best, 1)
    return both.select("item_id", "doc_id", F.round(T.token_jaccard(F.col("dt"), F.col("qt")), 6).alias("jaccard"))


QUERIES = {
    "token_stats": (token_stats, "WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM t"),
    "token_document_frequency": (token_document_frequency, "SELECT tok, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+')) AS tok FROM documents) GROUP BY tok"),
    "weighted_bag": (weighted_bag, "WITH t AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS t FROM benchmark), b AS (SELECT item_id, t || t || t || CASE WHEN len(t) > 0 THEN t[1:greatest(1, CAST(floor(least(len(t), 256) * 0.6) AS INTEGER))] ELSE [] END || t[1:64] || CASE WHEN len(t) > 0 THEN t[1:greatest(1, CAST(floor(least(len(t), 64) * (1.2::DOUBLE - 1)) AS INTEGER))] ELSE [] END AS b FROM t) SELECT item_id, len(b) AS n, md5(array_to_string(b, ' ')) AS bag_md5 FROM b"),
    "query_expansion": (query_expansion, EXPANSION),
    "bm25_topk": (bm25_topk, BM25 + " SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 10"),
    "bm25_minmax": (bm25_minmax, SCALED + " SELECT item_id, doc_id, rank, scaled FROM m WHERE rank <= 10"),
    "bm25_rule_rerank": (bm25_rule_rerank, RERANKED + " SELECT item_id, doc_id, final, final_rank FROM g WHERE final_rank <= 10"),
    "retrieval_margin": (retrieval_margin, RERANKED + ", c AS (SELECT item_id, max(CASE WHEN final_rank = 1 THEN final END) AS top1, coalesce(max(CASE WHEN final_rank = 2 THEN final END), 0) AS top2 FROM g GROUP BY item_id), x AS (SELECT *, round(top1 - top2, 4) AS margin FROM c) SELECT *, CASE WHEN margin >= 0.5 THEN 'high' WHEN margin >= 0.2 THEN 'med' ELSE 'low' END AS level FROM x"),
    "best_match_overlap": (project_overlap_pairs, BM25 + " SELECT item_id, doc_id, round(CASE WHEN len(toks) = 0 OR len(qs) = 0 THEN 0 ELSE len(list_intersect(toks, qs)) / len(list_distinct(toks || qs)) END, 6) AS jaccard FROM k JOIN t USING (doc_id) JOIN (SELECT item_id, list(tok) AS qs FROM qt GROUP BY item_id) q USING (item_id) WHERE rank = 1"),
    "dense_cosine_topk": (dense_cosine_topk, COS + ", k AS (SELECT query_id, vec_id, cos, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM p WHERE query_id <> vec_id) SELECT * FROM k WHERE rank <= 10"),
    "fused_topk": (fused_topk, FUSED + ", f AS (SELECT query_id, vec_id, round(0.4 * sn + 0.6 * dn, 4) AS fused FROM m), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS fused_rank FROM f) SELECT * FROM g WHERE fused_rank <= 10"),
    "self_excluded_neighbours": (self_excluded_neighbours, FUSED + ", f AS (SELECT query_id, vec_id, round(dn, 4) AS scaled FROM m WHERE query_id <> vec_id), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scaled DESC, vec_id) AS place FROM f) SELECT * FROM g WHERE place <= 5"),
    "exact_dup_keep_first": (exact_dup_keep_first, "SELECT min(doc_id) AS doc_id, sha1(coalesce(text, '')) AS h FROM documents GROUP BY 2"),
    "normalized_hash_dedup": (normalized_hash_dedup, r"WITH h AS (SELECT source, min(doc_id) AS doc_id FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS n FROM documents) GROUP BY source, n) SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS kept_n FROM h"),
}
