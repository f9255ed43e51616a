"""The iterative loop: all open items advance a round together.

A round generates, drops empty, unchanged and seen candidates, evaluates the
others, and chooses the seed of the next round and the feedback that goes with it. Rounds are few (a parameter); each is written to the given folder, which
cuts lineage and makes a run resumable: rounds that are there are read, not run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.text import failure_priority, feedback_strategy
from quarrywork.operators import selection

ATTEMPT = "id, iteration, sample, code, outcome, family, failing, rank, place"
Generate = Callable[[DataFrame, int], DataFrame]
Evaluate = Callable[[DataFrame], DataFrame]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _next_state(state: DataFrame, attempts: DataFrame, done: DataFrame, drafts: DataFrame, memory: int, rotate: bool) -> DataFrame:
    """(id, seed, outcome, family) after a round: its best attempt, where it has one.

    Where all drafts of an item were codes that it had already, feedback moves
    nothing: with rotate, the first other code of the memory (the best distinct
    codes of all rounds) takes the seed's place, if the memory has two.
    """
    first = W.partitionBy("id").orderBy(F.col("rank").desc(), "sample")
    best = done.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("id", F.struct("code", "outcome", "family").alias("_best"))
    kept = selection.memory(attempts, "id", "code", F.col("rank"), "place", memory)
    seeds = state.select("id", "seed")
    other = kept.join(seeds, "id").filter(F.col("code") != F.col("seed")).groupBy("id").agg(F.min_by(F.struct("code", "outcome", "family"), "memory_rank").alias("_other"))
    sizes = kept.groupBy("id").agg(F.count("*").alias("_kept"))
    stuck = drafts.groupBy("id").agg((F.count("*") == F.count_if("seen")).alias("_stuck"))
    joined = state.join(best, "id", "left").join(other, "id", "left").join(sizes, "id", "left").join(stuck, "id", "left")
    turn = F.lit(rotate) & F.coalesce(F.col("_stuck"), F.lit(False)) & (F.coalesce("_kept", F.lit(0)) >= 2) & F.col("outcome").isNotNull()
    held = F.struct(F.col("seed").alias("code"), "outcome", "family")
    now = F.coalesce("_best", F.when(turn, F.col("_other")), held)
    return joined.select("id", now["code"].alias("seed"), now["outcome"].alias("outcome"), now["family"].alias("family"))


def run_rounds(items: DataFrame, generate: Generate, evaluate: Evaluate, folder: str, rounds: int = 3, memory: int = 3, rotate: bool = True) -> DataFrame:
    """(id, iteration, sample, code, outcome, family, failing, rank, place) of all evaluated candidates.

    items: (id, base). generate gets (id, base, seed, strategy) of open items and
    the round's number and returns (id, sample, code); strategy is what feedback
    the seed's outcome asks for, null in the first round. evaluate gets (id,
    sample, code) and adds outcome and failing, and may add family (of a compile
    failure) and similarity. An item is open until a candidate's outcome is pass;
    a code is evaluated once.
    """
    spark = items.sparkSession
    attempts: DataFrame | None = None
    state = items.select("id", F.col("base").alias("seed"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("family"))
    for k in range(1, rounds + 1):
        path = f"{folder}/round{k}"
        if not _exists(spark, f"{path}/state"):
            left = items if attempts is None else items.join(attempts.filter("outcome = 'pass'").select("id").distinct(), "id", "left_anti")
            told = state.select("id", "seed", F.when(F.col("outcome").isNotNull(), feedback_strategy(F.col("outcome"), F.col("family"))).alias("strategy"))
            # Drafts are written first: a generator need not return the same ones twice.
            generate(left.join(told, "id"), k).select("id", "sample", "code").write.mode("overwrite").parquet(f"{path}/drafts")
            drafts = spark.read.parquet(f"{path}/drafts").join(items.select("id", "base"), "id")
            known = items.select("id", F.lit("").alias("code")).limit(0) if attempts is None else attempts.select("id", "code").distinct()
            drafts = drafts.join(known.withColumn("seen", F.lit(True)), ["id", "code"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
            first = W.partitionBy("id", "code").orderBy("sample")
            fresh = drafts.filter((F.trim("code") != "") & (F.col("code") != F.col("base")) & ~F.col("seen")).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
            done = evaluate(fresh.select("id", "sample", "code"))
            for c, kind in (("family", "string"), ("similarity", "double")):
                done = done if c in done.columns else done.withColumn(c, F.lit(None).cast(kind))
            rank = selection.ranking(failure_priority(F.col("outcome"), F.col("family")), F.col("failing"), F.col("similarity"))
            place = F.lit(k).cast("bigint") * 1_000_000_000 + F.col("sample")
            done.withColumns({"rank": rank, "iteration": F.lit(k), "place": place}).select(*ATTEMPT.split(", ")).write.mode("overwrite").parquet(f"{path}/attempts")
            now = spark.read.parquet(f"{path}/attempts")
            every = now if attempts is None else attempts.unionByName(now)
            _next_state(state, every, now, drafts, memory, rotate).write.mode("overwrite").parquet(f"{path}/state")
        now, state = spark.read.parquet(f"{path}/attempts"), spark.read.parquet(f"{path}/state")
        attempts = now if attempts is None else attempts.unionByName(now)
    return attempts


def summary(items: DataFrame, attempts: DataFrame) -> DataFrame:
    """(id, solved, solving_iteration, n_candidates) of every item."""
    per = attempts.groupBy("id").agg(F.min(F.when(F.col("outcome") == "pass", F.col("iteration"))).alias("solving_iteration"), F.count("*").alias("n_candidates"))
    return items.select("id").join(per, "id", "left").select("id", F.col("solving_iteration").isNotNull().alias("solved"), "solving_iteration", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
