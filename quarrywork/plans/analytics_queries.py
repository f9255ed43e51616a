"""Queries of experiment analytics: events stand for runs, users for bugs, conversations for iteration logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.stats import fisher_combined, rate
from quarrywork.functions.text import short_hash
from quarrywork.operators import analytics, selection
from quarrywork.session import table
from quarrywork.sources import keyed_json

STRATEGY_NAMES = ("one_shot", "blind_retry", "error_aware")


def runs(spark, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
        F.element_at(F.array(*[F.lit(x) for x in STRATEGY_NAMES]), k % 3 + 1).alias("strategy"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 30)).alias("solved"),
    )


RUNS = """
WITH runs AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
    ['one_shot', 'blind_retry', 'error_aware'][CAST(json_extract(props, '$.k') AS INTEGER) % 3 + 1] AS strategy,
    event_type = 'purchase' AND value > 30 AS solved
  FROM events)"""


def strategy_solve_rate(spark, d):
    return analytics.solve_rates(runs(spark, d), "strategy")


def numbered(spark, d) -> DataFrame:
    return runs(spark, d).withColumn("iteration", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


NUMBERED = RUNS + """,
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration FROM runs),
bugs AS (SELECT user_id, min(CASE WHEN solved THEN iteration END) AS solving_iteration, arg_min(event_type, iteration) AS family FROM n GROUP BY user_id)"""


def bugs(spark, d) -> DataFrame:
    return numbered(spark, d).groupBy("user_id").agg(F.min(F.when(F.col("solved"), F.col("iteration"))).alias("solving_iteration"), F.min_by("event_type", "iteration").alias("family"))


def solved_by_iteration_cumulative(spark, d):
    counts = bugs(spark, d).groupBy(F.coalesce("solving_iteration", F.lit(0)).cast("bigint").alias("solving_iteration")).agg(F.count("*").alias("n"))
    return analytics.cumulative(counts, "solving_iteration", "n", "cumulative_n")


def first_last_iteration(spark, d):
    return analytics.first_and_last(table(spark, d, "conversations"), "conv_id", "turn", "role")


def error_family_recovery(spark, d):
    b = bugs(spark, d)
    return analytics.recovery(b, F.col("family"), F.col("solving_iteration").isNotNull(), F.col("solving_iteration"))


def failure_category_breakdown(spark, d):
    b = bugs(spark, d).withColumn("category", F.when(F.col("solving_iteration") == 1, "solved_first").otherwise(F.concat(F.lit("fail:"), "family")))
    out = b.rollup("category").agg(F.count("*").alias("total"), F.count_if(F.col("solving_iteration").isNotNull()).alias("solved_n"))
    return out.withColumn("category", F.coalesce("category", F.lit("total")))


def projects(spark, d) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


def project_breakdown(spark, d):
    hit = F.count_if(F.col("o_orderstatus") == "F")
    return projects(spark, d).groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("total"), hit.alias("solved_n"), F.round(rate(hit, F.count("*")), 6).alias("solve_rate"))


def project_pivot_multi(spark, d):
    """Customers as items of their nation, orders of a status as the outcomes of a run."""
    meta = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).filter("n_nationkey % 5 != 1 OR c_custkey % 2 = 0")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lower("o_orderstatus").alias("run"), (F.col("o_orderkey") % 7 != 0).alias("valid"), (F.col("o_totalprice") > 200000).alias("solved"))
    return analytics.project_runs(meta, o, "c_custkey", "n_name", ["f", "o", "p"])


PIVOT = """WITH m AS (SELECT c_custkey, n_name AS project FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 1 OR c_custkey % 2 = 0),
x AS (SELECT o_custkey AS c_custkey, lower(o_orderstatus) AS run, CAST(bool_or(o_orderkey % 7 <> 0) AS INTEGER) AS v, CAST(bool_or(o_orderkey % 7 <> 0 AND o_totalprice > 200000) AS INTEGER) AS s FROM orders GROUP BY ALL),
g AS (SELECT project, count(DISTINCT m.c_custkey) AS total, """ + ", ".join(f"CAST(coalesce(sum(v) FILTER (run = '{r}'), 0) AS BIGINT) AS {r}_valid_n, CAST(coalesce(sum(s) FILTER (run = '{r}'), 0) AS BIGINT) AS {r}_solved_n" for r in "fop") + """ FROM m LEFT JOIN x USING (c_custkey) GROUP BY project)
SELECT *, """ + ", ".join(f"round({r}_solved_n / greatest({r}_valid_n, 1), 4) AS {r}_rate" for r in "fop") + """ FROM g WHERE greatest(f_valid_n, o_valid_n, p_valid_n) > 0"""


def project_strategy_pivot(spark, d):
    """Event types as projects: each strategy's solved runs over the runs of one."""
    return analytics.shared_denominator(runs(spark, d), "event_type", "strategy", "solved", "error_aware", list(STRATEGY_NAMES))


SHARED = RUNS + """, g AS (SELECT event_type AS project, count(*) FILTER (strategy = 'error_aware') AS total, """ + ", ".join(f"count(*) FILTER (strategy = '{n}' AND solved) AS {n}_n" for n in STRATEGY_NAMES) + """ FROM runs GROUP BY 1)
SELECT *, """ + ", ".join(f"round({n}_n / greatest(total, 1), 4) AS {n}_rate" for n in STRATEGY_NAMES) + """ FROM g WHERE total > 0"""


def paired_outcomes(spark, d):
    """Users' outcomes under two strategies, counted by pair."""
    sets = _solved_sets(spark, d)
    both = analytics.paired(sets.select("user_id", F.col("error_aware").alias("x")), sets.select("user_id", F.col("one_shot").alias("x")), "user_id", "x")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def _solved_sets(spark, d) -> DataFrame:
    flags = [F.max((F.col("strategy") == s) & F.col("solved")).alias(s) for s in STRATEGY_NAMES]
    return runs(spark, d).groupBy("user_id").agg(*flags)


SETS = RUNS + """,
sets AS (SELECT user_id, bool_or(strategy = 'one_shot' AND solved) AS one_shot, bool_or(strategy = 'blind_retry' AND solved) AS blind_retry,
  bool_or(strategy = 'error_aware' AND solved) AS error_aware FROM runs GROUP BY user_id)"""


def only_target_solved(spark, d):
    solved = runs(spark, d).filter("solved").select("user_id", "strategy").distinct()
    mine = solved.filter("strategy = 'error_aware'").select("user_id")
    return mine.join(solved.filter("strategy != 'error_aware'"), "user_id", "left_anti")


def solved_union(spark, d):
    r = runs(spark, d).filter("solved")
    return r.filter("strategy = 'one_shot'").select("user_id").union(r.filter("strategy = 'blind_retry'").select("user_id")).distinct()


def solved_intersect(spark, d):
    r = runs(spark, d).filter("solved")
    return r.filter("strategy = 'error_aware'").select("user_id").intersect(r.filter("strategy = 'blind_retry'").select("user_id"))


def solved_difference(spark, d):
    r = runs(spark, d).filter("solved")
    return r.filter("strategy = 'error_aware'").select("user_id").subtract(r.filter("strategy = 'one_shot'").select("user_id"))


PAIRS = (("error_aware", "one_shot"), ("error_aware", "blind_retry"), ("blind_retry", "one_shot"))


def _pairs(sets: DataFrame, *keep: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in PAIRS]))
    return sets.select(*keep, each.alias("x")).select(*keep, "x.*")


def mcnemar_pairs(spark, d):
    return analytics.discordant(_pairs(_solved_sets(spark, d)), "pair")


P_VALUE = "round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0)) FOR i IN range(0, least(only_a, only_b) + 1)])) END, 6)"
UNPIVOT = " UNION ALL ".join(f"SELECT user_id, '{a} vs {b}' AS pair, {a} AS a, {b} AS b FROM sets" for a, b in PAIRS)
MCNEMAR = SETS + f""",
pairs AS ({UNPIVOT}),
counts AS (SELECT pair, count(*) AS n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM pairs GROUP BY pair)
SELECT pair, n, only_a, only_b, {P_VALUE} AS p_value FROM counts"""


def _by_category(spark, d) -> DataFrame:
    sets = _solved_sets(spark, d).join(bugs(spark, d).select("user_id", "family"), "user_id")
    return analytics.discordant(_pairs(sets, "family"), "family", "pair").filter("n >= 3")


def mcnemar_by_category(spark, d):
    return _by_category(spark, d)


CATEGORY = NUMBERED + """,
sets AS (SELECT user_id, bool_or(strategy = 'one_shot' AND solved) AS one_shot, bool_or(strategy = 'blind_retry' AND solved) AS blind_retry,
  bool_or(strategy = 'error_aware' AND solved) AS error_aware FROM runs GROUP BY user_id),
pairs AS (SELECT p.*, family FROM (""" + UNPIVOT + f""") p JOIN bugs USING (user_id)),
counts AS (SELECT family, pair, count(*) AS n, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM pairs GROUP BY family, pair HAVING count(*) >= 3),
tested AS (SELECT family, pair, n, only_a, only_b, {P_VALUE} AS p_value FROM counts)
"""


def fisher_by_pair(spark, d):
    return _by_category(spark, d).groupBy("pair").agg(F.count("*").alias("k"), F.round(fisher_combined(F.array_sort(F.collect_list("p_value"))), 6).alias("combined_p"))


def run_cost(spark, d):
    v = F.coalesce("value", F.lit(0.0))
    return runs(spark, d).groupBy("strategy").agg(F.round(F.avg(v), 4).alias("mean_sec"), F.round(F.sum(v), 2).alias("total_sec"), F.round(F.avg(F.coalesce("k", F.lit(0))), 6).alias("mean_calls"))


def cross_seed_consistency(spark, d):
    solved = runs(spark, d).filter("solved").select("strategy", (F.col("user_id") % 2).alias("seed"), F.floor(F.col("user_id") / 2).alias("bug")).distinct()
    per = solved.groupBy("strategy", "bug").agg(F.max((F.col("seed") == 0).cast("int")).alias("s0"), F.max((F.col("seed") == 1).cast("int")).alias("s1"))
    return per.groupBy("strategy").agg(
        F.sum(F.col("s0") * F.col("s1")).alias("both_seeds"), F.sum("s0").alias("seed0"), F.sum("s1").alias("seed1"),
        F.round((F.sum("s0") + F.sum("s1")) / 2, 6).alias("mean_n"), F.round(F.abs(F.sum("s0") - F.sum("s1")) / 2, 6).alias("half_range"),
    )


def mean_solving_iteration(spark, d):
    return bugs(spark, d).agg(F.round(F.avg("solving_iteration"), 6).alias("mean_iteration"), F.count("solving_iteration").alias("solved_n"))


def stagnation_rows(spark, d):
    out = selection.stagnant(table(spark, d, "conversations"), "conv_id", "turn", short_hash(F.col("role")))
    return out.select("conv_id", "turn", "stagnant")


def iteration_quality_counts(spark, d):
    """A source's first document is its base: texts that are empty, equal the base, came before, or are new."""
    docs = table(spark, d, "documents").withColumn("h", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    firsts, bases = docs.groupBy("h").agg(F.min("doc_id").alias("first_id")), docs.groupBy("source").agg(F.min_by("h", "doc_id").alias("base"), F.min("doc_id").alias("base_id"))
    marked = docs.join(firsts, "h").join(F.broadcast(bases), "source")
    empty, dup = F.trim(F.coalesce("text", F.lit(""))) == "", F.col("doc_id") != F.col("first_id")
    same = (F.col("h") == F.col("base")) & (F.col("doc_id") != F.col("base_id"))
    return marked.groupBy("source").agg(F.count_if(empty).alias("empty_n"), F.count_if(~empty & same).alias("equals_base_n"), F.count_if(~empty & ~same & dup).alias("duplicate_n"), F.count_if(~empty & ~same & ~dup).alias("valid_n"))


QUALITY = """WITH m AS (SELECT *, trim(coalesce(text, '')) = '' AS e, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS dup, first_value(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id) = coalesce(text, '') AND doc_id <> min(doc_id) OVER (PARTITION BY source) AS b FROM documents)
SELECT source, count(*) FILTER (e) AS empty_n, count(*) FILTER (NOT e AND b) AS equals_base_n, count(*) FILTER (NOT e AND NOT b AND dup) AS duplicate_n, count(*) FILTER (NOT e AND NOT b AND NOT dup) AS valid_n FROM m WHERE source IS NOT NULL GROUP BY source"""


def drop_reason_topn(spark, d):
    counts = analytics.value_counts(table(spark, d, "events"), "event_type")
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "event_type"))).filter("rank <= 3")


def resume_remaining(spark, d):
    r = runs(spark, d)
    return keyed_json.remaining(r.select("user_id", "event_id"), r.filter("event_type = 'purchase' AND k > 90"), "user_id")


def value_counts_manifest(spark, d):
    docs = table(spark, d, "documents")
    return keyed_json.manifest(docs, {"stage": "retrieval"}, "lang")


def single_or_mixed(spark, d):
    return analytics.single_or_mixed(table(spark, d, "documents"), "source", "lang")


def counter_map_merge(spark, d):
    m = runs(spark, d).select(F.create_map("event_type", F.col("k").cast("bigint")).alias("m"))
    return analytics.merge_counters(m, "m")


def key_collision_union(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return keyed_json.union_with_suffixes("p_partkey", p, p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 9 = 0"))


def status_filter(spark, d):
    o = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "P", "infra_fail"))
    return analytics.solve_rates(analytics.valid_runs(o.withColumn("solved", F.col("o_totalprice") > 250000)), "o_orderpriority")


def temperature_schedule(spark, d):
    at = F.element_at(F.array(F.lit(0.0), F.lit(0.4), F.lit(0.8)), F.least(F.col("turn").cast("int") + 1, F.lit(3)))
    return table(spark, d, "conversations").groupBy(at.alias("temperature")).agg(F.count("*").alias("n"))


QUERIES = {
    "strategy_solve_rate": (strategy_solve_rate, RUNS + " SELECT strategy, count(*) AS total, count(*) FILTER (solved) AS solved_n, round(count(*) FILTER (solved) / greatest(count(*), 1), 6) AS solve_rate FROM runs GROUP BY strategy"),
    "solved_by_iteration_cumulative": (solved_by_iteration_cumulative, NUMBERED + ", c AS (SELECT CAST(coalesce(solving_iteration, 0) AS BIGINT) AS solving_iteration, count(*) AS n FROM bugs GROUP BY 1) SELECT *, CAST(sum(n) OVER (ORDER BY solving_iteration) AS BIGINT) AS cumulative_n FROM c"),
    "first_last_iteration": (first_last_iteration, "SELECT conv_id, arg_min(role, turn) AS first_value, arg_max(role, turn) AS last_value, count(*) AS n_steps FROM conversations GROUP BY conv_id"),
    "error_family_recovery": (error_family_recovery, NUMBERED + " SELECT family, count(*) AS total, count(*) FILTER (solving_iteration > 1) AS recovered, round(count(*) FILTER (solving_iteration > 1) / count(*), 6) AS recovery_rate FROM bugs GROUP BY family"),
    "failure_category_breakdown": (failure_category_breakdown, NUMBERED + ", c AS (SELECT CASE WHEN solving_iteration = 1 THEN 'solved_first' ELSE 'fail:' || family END AS category, solving_iteration FROM bugs) SELECT coalesce(category, 'total') AS category, count(*) AS total, count(solving_iteration) AS solved_n FROM c GROUP BY ROLLUP (category)"),
    "project_breakdown": (project_breakdown, "SELECT n_name AS project, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS solved_n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS solve_rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"),
    "project_pivot_multi": (project_pivot_multi, PIVOT),
    "project_strategy_pivot": (project_strategy_pivot, SHARED),
    "paired_outcomes": (paired_outcomes, SETS + " SELECT error_aware AS a, one_shot AS b, count(*) AS n FROM sets GROUP BY ALL"),
    "only_target_solved": (only_target_solved, SETS + " SELECT user_id FROM sets WHERE error_aware AND NOT one_shot AND NOT blind_retry"),
    "solved_union": (solved_union, SETS + " SELECT user_id FROM sets WHERE one_shot OR blind_retry"),
    "solved_intersect": (solved_intersect, SETS + " SELECT user_id FROM sets WHERE error_aware AND blind_retry"),
    "solved_difference": (solved_difference, SETS + " SELECT user_id FROM sets WHERE error_aware AND NOT one_shot"),
    "mcnemar_pairs": (mcnemar_pairs, MCNEMAR),
    "mcnemar_by_category": (mcnemar_by_category, CATEGORY + "SELECT family, pair, n, only_a, only_b, p_value FROM tested"),
    "fisher_by_pair": (fisher_by_pair, CATEGORY + ", f AS (SELECT pair, count(*) AS k, -sum(ln(p_value)) AS h FROM tested GROUP BY pair) SELECT pair, k, round(exp(-h) * list_sum([pow(h, i) / factorial(CAST(i AS INTEGER)) FOR i IN range(0, k)]), 6) AS combined_p FROM f"),
    "run_cost": (run_cost, RUNS + " SELECT strategy, round(avg(coalesce(value, 0)), 4) AS mean_sec, round(sum(coalesce(value, 0)), 2) AS total_sec, round(avg(coalesce(k, 0)), 6) AS mean_calls FROM runs GROUP BY strategy"),
    "cross_seed_consistency": (cross_seed_consistency, RUNS + ", p AS (SELECT strategy, user_id // 2 AS bug, max(CAST(user_id % 2 = 0 AS INTEGER)) AS s0, max(CAST(user_id % 2 = 1 AS INTEGER)) AS s1 FROM runs WHERE solved GROUP BY ALL) SELECT strategy, CAST(sum(s0 * s1) AS BIGINT) AS both_seeds, CAST(sum(s0) AS BIGINT) AS seed0, CAST(sum(s1) AS BIGINT) AS seed1, round((sum(s0) + sum(s1)) / 2, 6) AS mean_n, round(abs(sum(s0) - sum(s1)) / 2, 6) AS half_range FROM p GROUP BY strategy"),
    "mean_solving_iteration": (mean_solving_iteration, NUMBERED + " SELECT round(avg(solving_iteration), 6) AS mean_iteration, count(solving_iteration) AS solved_n FROM bugs"),
    "stagnation_rows": (stagnation_rows, "SELECT conv_id, turn, coalesce(role <> '' AND role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS stagnant FROM conversations"),
    "iteration_quality_counts": (iteration_quality_counts, QUALITY),
    "drop_reason_topn": (drop_reason_topn, "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 3"),
    "resume_remaining": (resume_remaining, RUNS + " SELECT user_id, event_id FROM runs WHERE user_id NOT IN (SELECT user_id FROM runs WHERE event_type = 'purchase' AND k > 90)"),
    "value_counts_manifest": (value_counts_manifest, """WITH c AS (SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS v, count(*) AS n FROM documents GROUP BY 1)
SELECT '[' || string_agg('{"column":"lang","value":"' || v || '","count":' || n || '}', ',' ORDER BY v) || ']' AS counts, (SELECT count(*) FROM documents) AS n_rows, 'retrieval' AS stage FROM c"""),
    "single_or_mixed": (single_or_mixed, "SELECT source, CASE count(DISTINCT nullif(trim(lang), '')) WHEN 0 THEN 'unknown' WHEN 1 THEN max(nullif(trim(lang), '')) ELSE 'mixed' END AS lang FROM documents GROUP BY source"),
    "counter_map_merge": (counter_map_merge, RUNS + " SELECT event_type AS key, CAST(sum(k) AS BIGINT) AS n FROM runs GROUP BY 1"),
    "key_collision_union": (key_collision_union, "WITH u AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, 0 AS source_no FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 2 FROM part WHERE p_partkey % 9 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY source_no) - 1 AS k FROM u) SELECT CASE WHEN k > 0 THEN p_partkey || '#' || k ELSE p_partkey END AS p_partkey, p_name, source_no FROM n"),
    "status_filter": (status_filter, "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_totalprice > 250000) AS solved_n, round(count(*) FILTER (o_totalprice > 250000) / count(*), 6) AS solve_rate FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
    "temperature_schedule": (temperature_schedule, "SELECT CAST([0.0, 0.4, 0.8][least(turn + 1, 3)] AS DOUBLE) AS temperature, count(*) AS n FROM conversations GROUP BY 1"),
}
