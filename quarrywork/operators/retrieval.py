"""Ranked retrieval: BM25 over an inverted index, score normalisation, rule and dense reranking.

A corpus is tokenised once, into a written table. Only postings of words that some query has reach
the join; document frequencies and lengths are aggregates of the whole corpus.
The query side is broadcast while it is small by count, and joined by a shuffle
on the word otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.text import TOKEN, tokenize
from quarrywork.operators import dense
from quarrywork.sources import discovery
from quarrywork.sources.work_folders import work_folder

#: Parameters of the ranking function, and the share of the mean idf that negative ones get.
K1, B, FLOOR = 1.6, 0.7, 0.25
BROADCAST_ROWS = 200_000
#: Pairs of a query and a document that one task scores at most, about.
PAIRS = 1_000_000
#: Scores are rounded before ties are broken, as sums differ with their order.
PLACES = 4


def small(df: DataFrame) -> DataFrame:
    """Broadcast, if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def token_table(corpus: DataFrame, doc: str, text: str, folder: str | None = None) -> DataFrame:
    """(doc, toks), written: every later pass reads tokens, not texts. folder keeps it by the corpus's fingerprint, for other runs."""
    spark = corpus.sparkSession
    bags = corpus.select(F.col(doc).alias("doc"), tokenize(F.col(text)).alias("toks"))
    if folder:
        return discovery.cached(bags, folder, discovery.fingerprint(corpus, doc, text, f"tokens:{TOKEN}"))
    path = work_folder(spark, "tokens")
    bags.write.parquet(path)
    return spark.read.schema(bags.schema).parquet(path)


def corpus_statistics(bags: DataFrame) -> tuple[DataFrame, int, float, float]:
    """(tok, df) of every word, written; the number of documents, their mean length, and the words' mean raw idf."""
    spark, path = bags.sparkSession, work_folder(bags.sparkSession, "df")
    bags.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").agg(F.count("*").alias("df")).write.parquet(path)
    frequencies = spark.read.parquet(path)
    n, length = bags.agg(F.count("*"), F.avg(F.size("toks"))).first()
    mean = frequencies.agg(F.avg(_raw_idf(n))).first()[0]
    return frequencies, n, length or 0.0, mean or 0.0


def _raw_idf(n: int) -> Column:
    return F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def bm25_scores(corpus: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", folder: str | None = None) -> DataFrame:
    """(query, doc, score) of all pairs that share a word. Repeated query words count repeatedly."""
    bags = token_table(corpus, doc, text, folder)
    asked = queries.select(F.col(query).alias("query"), F.explode(tokenize(F.col(text))).alias("tok")).groupBy("query", "tok").agg(F.count("*").alias("qf"))
    frequencies, n, length, mean = corpus_statistics(bags)
    # Only the queries' words need an idf; one count, of the queries' own rows, decides on both broadcasts.
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    near = F.broadcast if few else (lambda df: df)
    raw = _raw_idf(n)
    idf = frequencies.join(near(asked.select("tok").distinct()), "tok", "left_semi").select("tok", F.when(raw < 0, mean * FLOOR).otherwise(raw).alias("idf"))
    weighed = asked.join(idf, "tok")
    # Tokens are dealt by document once: with the queries broadcast, both aggregates and the first cut of top_k find their rows in the task already, and no pair is shuffled.
    tasks = max(int(bags.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * queries.count() // PAIRS)) if few else 0
    dealt = bags.select("doc", "toks").repartition(tasks, "doc") if few else bags
    postings = dealt.select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("tok")).join(near(asked.select("tok").distinct()), "tok", "left_semi").groupBy("doc", "dl", "tok").agg(F.count("*").alias("tf"))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / length))
    scored = postings.join(near(weighed), "tok").groupBy("query", "doc").agg(F.sum(F.col("qf") * F.col("idf") * part).alias("score"))
    return scored.select(F.col("query").alias(query), F.col("doc").alias(doc), F.round("score", PLACES).alias("score"))


def top_k(scored: DataFrame, by: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best of each group; equal scores in the order of tie."""
    order = W.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def min_max(score: str, by: str) -> Column:
    """Scaled to 0 and 1 inside a group; 0 where all are equal."""
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(0.0))


def rule_rerank(ranked: DataFrame, by: str, base: str, tie: str, same_project: Column, same_extension: Column, overlap: Column) -> DataFrame:
    """Adds final: the base score, 0.10 for the project, 0.05 for the extension, half the overlap; and its rank."""
    final = F.col(base) + F.when(same_project, 0.10).otherwise(0.0) + F.when(same_extension, 0.05).otherwise(0.0) + 0.5 * overlap
    out = ranked.withColumn("final", F.round(final, PLACES))
    return out.withColumn("final_rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc("final"), tie)))


def confidence(ranked: DataFrame, by: str, score: str, rank: str) -> DataFrame:
    """(by, top1, top2, margin, level): high from a margin of 0.5, med from 0.2, else low."""
    out = ranked.groupBy(by).agg(
        F.max(F.when(F.col(rank) == 1, F.col(score))).alias("top1"),
        F.coalesce(F.max(F.when(F.col(rank) == 2, F.col(score))), F.lit(0.0)).alias("top2"),
    )
    out = out.withColumn("margin", F.round(F.col("top1") - F.col("top2"), PLACES))
    return out.withColumn("level", F.when(F.col("margin") >= 0.5, "high").when(F.col("margin") >= 0.2, "med").otherwise("low"))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, cos, rank). A stated query set against all other rows, by dense.nearest: a block keeps its own k best before they meet."""
    asked = queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("qv"))
    scored = dense.nearest(asked, vectors.filter(F.col(key).isNotNull()).select(key, vector), "query", "qv", key, vector, k, PLACES, itself=False)
    return top_k(scored, "query", "cos", key, k)


def fuse(sparse: Column, dense: Column, weight: float = 0.6) -> Column:
    return (1 - weight) * sparse + weight * dense
