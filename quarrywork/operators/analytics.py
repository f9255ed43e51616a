"""Experiment analytics: conditional aggregates, breakdowns, paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.stats import mcnemar_p, rate


def valid_runs(runs: DataFrame, status: str = "status", error: str | None = None) -> DataFrame:
    """Without rows whose status is a failure of the harness; with error, also without rows that have one."""
    kept = runs.filter(~F.coalesce(F.col(status), F.lit("")).isin("infra_fail", "error"))
    return kept.filter(F.coalesce(F.col(error), F.lit("")) == "") if error else kept


def solve_rates(runs: DataFrame, *by: str, solved: str = "solved") -> DataFrame:
    """(by, total, solved_n, solve_rate)."""
    hit = F.count_if(F.coalesce(F.col(solved), F.lit(False)))
    return runs.groupBy(*by).agg(F.count("*").alias("total"), hit.alias("solved_n"), F.round(rate(hit, F.count("*")), 6).alias("solve_rate"))


def first_and_last(steps: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, first_value, last_value, n_steps) in one pass."""
    return steps.groupBy(by).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count("*").alias("n_steps"))


def cumulative(counts: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running totals over an aggregate of few rows."""
    return counts.withColumn(name, F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def recovery(first: DataFrame, family: Column, solved: Column, iteration: Column) -> DataFrame:
    """(family, total, recovered, recovery_rate): solved at a later iteration than the first."""
    hit = F.count_if(solved & (iteration > 1))
    return first.groupBy(family.alias("family")).agg(F.count("*").alias("total"), hit.alias("recovered"), F.round(rate(hit, F.count("*")), 6).alias("recovery_rate"))


def discordant(pairs: DataFrame, *by: str, a: str = "a", b: str = "b") -> DataFrame:
    """(by, n, only_a, only_b, p_value) of paired outcomes."""
    grouped = pairs.groupBy(*by) if by else pairs.groupBy()
    counts = grouped.agg(F.count("*").alias("n"), F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    return counts.withColumn("p_value", F.round(mcnemar_p(F.col("only_a"), F.col("only_b")), 6))


def single_or_mixed(rows: DataFrame, by: str, value: str, default: str = "unknown") -> DataFrame:
    """(by, value): the only value of a group, mixed, or the default where all are blank."""
    v = F.nullif(F.trim(F.col(value)), F.lit(""))
    n = F.count_distinct(v)
    return rows.groupBy(by).agg(F.when(n == 0, default).when(n == 1, F.max(v)).otherwise("mixed").alias(value))


def value_counts(rows: DataFrame, value: str) -> DataFrame:
    v = F.coalesce(F.nullif(F.trim(F.col(value)), F.lit("")), F.lit("unknown"))
    return rows.groupBy(v.alias(value)).agg(F.count("*").alias("n"))


def merge_counters(rows: DataFrame, counters: str) -> DataFrame:
    """(key, n): sums of map values by key."""
    return rows.select(F.explode(counters).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("n"))


def project_runs(meta: DataFrame, outcomes: DataFrame, key: str, project: str, runs: list[str]) -> DataFrame:
    """(project, total and each run's valid_n, solved_n, rate): all items of meta, with each run's own denominators; projects valid in no run are left out.

    outcomes: (key, run, valid, solved), a row for each item and run, or none.
    """
    per = outcomes.groupBy(key).pivot("run", runs).agg(F.max(F.col("valid").cast("int")).alias("valid"), F.max((F.col("valid") & F.col("solved")).cast("int")).alias("solved"))
    per = per.withColumnsRenamed({f"{r}_valid": f"_v{k}" for k, r in enumerate(runs)} | {f"{r}_solved": f"_s{k}" for k, r in enumerate(runs)})
    joined = meta.select(key, F.col(project).alias("project")).join(per, key, "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    columns = [x for k, r in enumerate(runs) for x in (count(f"_v{k}").alias(f"{r}_valid_n"), count(f"_s{k}").alias(f"{r}_solved_n"), F.round(rate(count(f"_s{k}"), count(f"_v{k}")), 4).alias(f"{r}_rate"))]
    out = joined.groupBy("project").agg(F.count("*").alias("total"), *columns)
    return out.filter(F.greatest(*[F.col(f"{r}_valid_n") for r in runs]) > 0) if len(runs) > 1 else out.filter(F.col(f"{runs[0]}_valid_n") > 0)


def shared_denominator(rows: DataFrame, project: str, strategy: str, solved: str, reference: str, names: list[str]) -> DataFrame:
    """(project, total and each strategy's solved_n and rate): every rate over the reference strategy's items."""
    of = lambda name: F.count_if((F.col(strategy) == name) & F.coalesce(F.col(solved), F.lit(False)))
    total = F.count_if(F.col(strategy) == reference)
    each = [x for n in names for x in (of(n).alias(f"{n}_n"), F.round(rate(of(n), total), 4).alias(f"{n}_rate"))]
    return rows.groupBy(F.col(project).alias("project")).agg(total.alias("total"), *each).filter("total > 0")


def paired(a: DataFrame, b: DataFrame, key: str, outcome: str) -> DataFrame:
    """(key, a, b): both runs' outcomes of a's items; raises if b lacks one."""
    out = a.select(key, F.col(outcome).alias("a")).join(b.select(key, F.col(outcome).alias("b")), key, "inner")
    missing = a.select(key).join(b.select(key), key, "left_anti").count()
    if missing:
        raise KeyError(f"{missing} items have no outcome in the second run")
    return out


def run_summary(items: DataFrame) -> DataFrame:
    """(dimension, key, n, recovered, rate, avg_calls, avg_candidates) of a run's items, in one pass: all of them, solved ones by iteration, first error families, and why others stayed unsolved.

    items: (status, solved, solving_iteration, calls, candidates, first_family,
    first_reason, final_reason, n_iterations). Items whose status is infra_fail
    or error don't count. rate is the share of solved items for all, and for a
    family that of items that a retry recovered.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    solved = F.coalesce("solved", F.lit(False))
    family = F.when(text("first_family") != "", text("first_family")).when(text("first_reason") == "compile_fail", "unknown_compile").when(text("first_reason") != "pass", text("first_reason"))
    at = F.coalesce("solving_iteration", F.lit(1))
    recovered = solved & (at > 1) & (F.coalesce("n_iterations", F.lit(0)) >= 2) & (text("first_family") != "")
    place = lambda name, key: F.struct(F.lit(name).alias("dimension"), key.cast("string").alias("key"))
    places = F.array_compact(
        F.array(
            place("all", F.lit("")),
            F.when(solved, place("solved_at_iteration", at)),
            F.when((F.coalesce("n_iterations", F.lit(0)) > 0) & family.isNotNull(), place("error_family", family)),
            F.when(~solved, place("unsolved_fail_reason", F.coalesce("final_reason", F.lit("unknown")))),
        )
    )
    counted = items.filter(~text("status").isin("infra_fail", "error")).select(solved.alias("_solved"), recovered.alias("_back"), F.coalesce("calls", F.lit(0)).alias("_calls"), F.coalesce("candidates", F.lit(0)).alias("_found"), F.explode(places).alias("_at"))
    out = counted.groupBy("_at.dimension", "_at.key").agg(F.count("*").alias("n"), F.count_if("_back").alias("recovered"), F.count_if("_solved").alias("_s"), F.round(F.sum("_calls") / F.count("*"), 2).alias("avg_calls"), F.round(F.sum("_found") / F.count("*"), 2).alias("avg_candidates"))
    rate = F.when(F.col("dimension") == "all", F.round(F.col("_s") / F.col("n"), 4)).when(F.col("dimension") == "error_family", F.round(F.col("recovered") / F.col("n"), 3))
    return out.select("dimension", "key", "n", "recovered", rate.alias("rate"), "avg_calls", "avg_candidates")
