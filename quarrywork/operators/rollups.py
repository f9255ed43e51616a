"""Roll-ups of a run: fill rates, validity counters, stage counts, and the metrics of a data set in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywork.functions.stats import rate

# Why a candidate may not be valid.
VALIDITY_REASONS = (
    "unbalanced_delimiters",
    "decl_kind_mismatch",
    "signature_mismatch",
    "wrapper_mismatch",
    "model_artifact",
    "broad_rewrite",
    "new_helper_call",
    "new_type_reference",
    "new_constant_reference",
    "new_identifier_reference",
    "api_signature_drift",
    "compile_fail",
)
# The classes of first failures, in the order of the breakdown.
CATEGORIES = (
    "solved_iter0",
    "test_fail",
    "parse_fail",
    "compile:cannot_find_symbol",
    "compile:syntax_or_parse",
    "compile:type_mismatch",
    "compile:method_signature",
    "compile:other_compile_fail",
    "timeout",
    "infra_fail",
)


def fill_rates(items: DataFrame, key: str, target: str, valid: str, k: int) -> DataFrame:
    """(key, source_target, source_valid, source_rate, valid, fill_rate): how far an item's candidates fill its own target, and the k of the final cut."""
    goal, have = F.coalesce(F.nullif(F.col(target), F.lit(0)), F.col(valid)), F.col(valid)
    kept = F.least(have, F.lit(max(1, k)))
    return items.select(
        key,
        goal.alias("source_target"),
        have.alias("source_valid"),
        F.round(have / F.greatest(F.lit(1), goal), 4).alias("source_rate"),
        kept.alias("valid"),
        F.round(kept / max(1, k), 4).alias("fill_rate"),
    )


def validity_counts(rows: DataFrame, *by: str, checked: str = "checked", valid: str = "valid", rejected: str = "rejected", reranked: str = "reranked") -> DataFrame:
    """(by, checked_n, valid_n, invalid_n, rejected_n, reranked_n) of checked rows; what isn't true is invalid."""
    seen = F.coalesce(F.col(checked), F.lit(False))
    yes = lambda c: seen & F.coalesce(F.col(c), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count_if(seen).alias("checked_n"),
        F.count_if(yes(valid)).alias("valid_n"),
        F.count_if(seen & ~F.coalesce(F.col(valid), F.lit(False))).alias("invalid_n"),
        F.count_if(yes(rejected)).alias("rejected_n"),
        F.count_if(yes(reranked)).alias("reranked_n"),
    )


def list_counts(rows: DataFrame, values: str, known: Sequence[str] = ()) -> DataFrame:
    """(value, n) over array values, blanks left out; with known, those alone, also where none occurs."""
    # The outer form, as the other one would put a filter with the whole expression of values below it.
    found = rows.select(F.explode_outer(values).alias("value")).select(F.trim("value").alias("value")).filter("value != ''").groupBy("value").agg(F.count("*").alias("n"))
    if not known:
        return found
    every = rows.sparkSession.createDataFrame([(x,) for x in known], "value string")
    return F.broadcast(every).join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def stage_counts(rows: DataFrame, tried: Column, found: Column, failed: Column) -> DataFrame:
    """One row: total, enriched, errors, no_checkout (a source was tried and not found) and source_available."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(~failed).alias("enriched"),
        F.count_if(failed).alias("errors"),
        F.count_if(tried & ~found).alias("no_checkout"),
        F.count_if(found & ~failed).alias("source_available"),
    )


def run_metrics(items: DataFrame, flags: Sequence[str] = (), sums: Sequence[str] = (), elapsed: str = "elapsed", target: str = "target", valid: str = "valid") -> DataFrame:
    """One row: items, candidate sums and rates, the mean time, and a count for each flag and a sum for each counter."""
    yes = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(f"{c}_items") for c in flags]
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_total") for c in sums]
    rows, goal, have = F.count("*"), F.coalesce(F.sum(target), F.lit(0)), F.coalesce(F.sum(valid), F.lit(0))
    return items.agg(rows.alias("items"), goal.alias("target_total"), have.alias("valid_total"), F.round(rate(have, goal), 4).alias("fill_rate"), F.round(F.coalesce(F.avg(F.coalesce(F.col(elapsed), F.lit(0.0))), F.lit(0.0)), 4).alias("mean_elapsed"), *yes, *total)


def category_table(rows: DataFrame, category: str, runs: Sequence[str]) -> DataFrame:
    """(place, category, n and each run's solved_n): the fixed classes in their order, those without an item left out, and their total at the end. runs: Boolean columns."""
    places = F.create_map(*[F.lit(x) for pair in zip(CATEGORIES, range(1, len(CATEGORIES) + 1), strict=True) for x in pair])
    solved = [F.count_if(F.coalesce(F.col(r), F.lit(False))).alias(f"{r}_n") for r in runs]
    known = rows.withColumn("place", F.try_element_at(places, F.col(category))).filter("place IS NOT NULL")
    each = known.groupBy("place", F.col(category).alias("category")).agg(F.count("*").alias("n"), *solved)
    total = known.agg(F.count("*").alias("n"), *solved).select(F.lit(len(CATEGORIES) + 1).alias("place"), F.lit("total").alias("category"), "*")
    return each.unionByName(total)


def by_size(table: DataFrame, size: str, name: str) -> DataFrame:
    """Rows of an aggregate, largest first, then by name."""
    return table.orderBy(F.desc(size), name)


def require(rows: DataFrame, n: int, what: str) -> DataFrame:
    """rows, if there are n of them; else an error."""
    found = rows.count()
    if found != n:
        raise ValueError(f"{what}: {found} rows, not {n}")
    return rows
