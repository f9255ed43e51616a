"""Runs of one task merged into one: a policy for each field, and candidates judged, scored and ranked again.

One aggregate by item carries all fields; POLICIES says how each combines over
the runs, in their order. Candidates aren't gathered: equal code is one
candidate, its first valid one in the order of runs, by window functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.functions.text import canonical, let
from quarrywork.operators import candidates, java_validity
from quarrywork.operators.rollups import VALIDITY_REASONS

# The fields of a run's item by how runs combine, and what a field is where no run has it.
FIRST = ("code", "file_path", "function_name")
SUMS = (
    "llm_calls_total elapsed_seconds plan_fill_added_n java_survivor_backoff_added_count java_sentinel_extract_hit java_decl_salvage_used "
    "java_explanation_tail_stripped java_decl_recovery_used java_compile_feedback_attempted_n java_compile_feedback_applied_n"
).split()
LARGEST = "target_candidates gen_n max_gen_passes bm25_top1 bm25_margin plan_fill_penalty".split()
ANY = (
    "plan_fill_used java_semantic_rerank_enabled java_branch_no_fill java_survivor_backoff_used zero_candidate_after_filter java_compile_feedback_once java_compile_feedback_available"
).split()
JOINED = ("temperature_used", "top_p_used")
DISTINCT = ("profiles_tried",)
LAST = {
    "scheduler": "fixed",
    "conf_level": "low",
    "language": "",
    "language_branch": "",
    "repair_branch": "",
    "repair_branch_requested": "auto",
    "repair_branch_effective": "",
    "repair_branch_source": "auto",
    "profile": "MED",
    "plan_source": "fallback_default",
    "plan_enforcement": "filter_then_fill",
    "plan_target_match": "overlap",
    "java_survivor_backoff_mode": "off",
    "backend_selected": "auto",
    "hf_model_name": "",
    "allowed_edit_types": ["REPLACE"],
    "java_semantic_rerank_features": [],
}
VIOLATIONS = ("edit_type", "out_of_target", "changed_lines_exceed", "other")
COUNTED = {"drop_counts": candidates.DROP_REASONS, "plan_violation_breakdown": VIOLATIONS, "java_decl_recovery_mode_counts": None}
LARGEST_BY_KEY = ("unique_after_stage",)

RUN = "run_no"
#: Candidates of a task, about.
TASK_ROWS = 250_000
Policy = Callable[[str], Column]


def _in_order(name: str) -> Column:
    """The values that runs have, by run."""
    return F.transform(F.sort_array(F.collect_list(F.when(F.col(name).isNotNull(), F.struct(RUN, name)))), lambda x: x[name])


def first_given(name: str) -> Column:
    return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(RUN)))


def total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def largest(name: str) -> Column:
    return F.coalesce(F.max(name), F.lit(0))


def any_true(name: str) -> Column:
    return F.coalesce(F.bool_or(name), F.lit(False))


def joined(name: str) -> Column:
    return F.flatten(_in_order(name))


def distinct(name: str) -> Column:
    return F.array_distinct(joined(name))


def last_given(default: str | list) -> Policy:
    """The last value that isn't blank or empty, else the default."""

    def policy(name: str) -> Column:
        given = F.size(name) > 0 if isinstance(default, list) else F.trim(name) != ""
        other = F.array(*map(F.lit, default)).cast("array<string>") if isinstance(default, list) else F.lit(default)
        return F.coalesce(F.max_by(name, F.when(given, F.col(RUN))), other)

    return policy


def _by_key(name: str, best: Callable[[Column, Column], Column]) -> Column:
    """A map of all runs' keys, in their order, with best over the values."""
    entries = F.flatten(F.collect_list(F.map_entries(name)))

    def of(all_: Column) -> Column:
        keys = F.sort_array(F.array_distinct(F.transform(all_, lambda e: e["key"])))
        value = lambda k: F.aggregate(F.filter(all_, lambda e: e["key"] == k), F.lit(0).cast("bigint"), lambda n, e: best(n, e["value"].cast("bigint")))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(k))))

    return let(entries, of)


def counted(known: Sequence[str] | None) -> Policy:
    """Sums by key: of the known keys, each there and 0 at least; of all, if none are known."""

    def policy(name: str) -> Column:
        if known is None:
            return _by_key(name, lambda n, v: n + F.coalesce(v, F.lit(0)))
        return F.create_map(*[x for k in known for x in (F.lit(k), F.coalesce(F.sum(F.try_element_at(name, F.lit(k))), F.lit(0)).cast("bigint"))])

    return policy


def largest_by_key(name: str) -> Column:
    return _by_key(name, lambda n, v: F.greatest(n, v))


POLICIES: dict[str, Policy] = (
    dict.fromkeys(FIRST, first_given) | dict.fromkeys(SUMS, total) | dict.fromkeys(LARGEST, largest) | dict.fromkeys(ANY, any_true) | dict.fromkeys(JOINED, joined) | dict.fromkeys(DISTINCT, distinct)
    | {n: last_given(d) for n, d in LAST.items()} | {n: counted(k) for n, k in COUNTED.items()} | dict.fromkeys(LARGEST_BY_KEY, largest_by_key)
)


def _stacked(runs: Sequence[DataFrame]) -> DataFrame:
    out = runs[0].withColumn(RUN, F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn(RUN, F.lit(k)), allowMissingColumns=True)
    return out


def _dealt(rows: DataFrame, by: str, tasks: int | None) -> DataFrame:
    """All rows of an item in one task, once for every later window, aggregate and join by item."""
    return rows.repartition(tasks, by) if tasks else rows.repartition(by)


def _tasks(runs: Sequence[DataFrame]) -> int:
    """So many that a task's rows are bounded, however many rows the runs have."""
    return max(int(runs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.count() for r in runs) // TASK_ROWS))


def merge_items(runs: Sequence[DataFrame], by: str, tasks: int | None = None) -> DataFrame:
    """A row for each item of any run, with the fields of POLICIES that a run has; runs in order."""
    rows = _dealt(_stacked(runs), by, tasks)
    return rows.groupBy(by).agg(F.count_distinct(RUN).alias("n_runs"), *[POLICIES[n](n).alias(n) for n in rows.columns if n in POLICIES])


Judge = Callable[[DataFrame], DataFrame]


def java_judge(filtering: bool = False, reranking: bool = True) -> Judge:
    """Of rows (base, code, name, and what there is of java_validity.CONTEXT): problem, by the rules for all candidates and, with filtering, those that may not compile; and the score with validity's and the features' points, from base_score."""

    def judge(rows: DataFrame) -> DataFrame:
        seen = java_validity.judged(java_validity.analysed(rows), filtering=filtering)
        plain = candidates.candidate_problem(F.col("code"), F.col("base"), F.col("name"), F.col("decl.name"))
        late = F.when(~F.col("valid"), "java_compile_invalid") if filtering else F.lit(None).cast("string")
        scored = seen.withColumn("score", java_validity.validity_rerank(F.col("base_score"), F.lit(reranking), F.col("valid"), F.col("reasons")))
        return java_validity.reranked(scored).withColumn("problem", F.coalesce(plain, late))

    return judge


def merge_candidates(runs: Sequence[DataFrame], by: str, order: str, judge: Judge, most: int, rerank: bool = True, tasks: int | None = None) -> DataFrame:
    """Candidates (by, order, code, greedy) of all runs with run_no, problem (null for those kept or cut) and pick (null for those that aren't kept).

    Blank code and code that the judge names a problem of is out; of code that
    is equal but for comments and white space the first is kept. Greedy ones
    come first, then by score (0 counts as none); so many of each item are kept.
    """
    rows = judge(_dealt(_stacked(runs).filter(F.trim(F.coalesce("code", F.lit(""))) != ""), by, tasks))
    same = W.partitionBy(by, F.col("problem").isNull(), F.sha1(canonical(F.col("code")).cast("binary"))).orderBy(RUN, order)
    marked = rows.withColumn("problem", F.when(F.col("problem").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("problem")))
    score = F.coalesce(F.nullif(F.col("score"), F.lit(0)), F.lit(-1_000_000_000))
    best = (~F.coalesce("greedy", F.lit(False)), score.desc(), RUN, order) if rerank else (RUN, order)
    place = F.row_number().over(W.partitionBy(by, F.col("problem").isNull()).orderBy(*best))
    return marked.withColumn("pick", F.when(F.col("problem").isNull() & (place <= most), place))


def merge_runs(items: Sequence[DataFrame], found: Sequence[DataFrame], by: str, order: str, judge: Judge, most: int) -> tuple[DataFrame, DataFrame]:
    """Merged items, with valid_candidates, fill_rate and, for each known problem of the judge, drop_counts; and the candidates that are kept."""
    tasks = _tasks(found)
    all_ = merge_candidates(found, by, order, judge, most, tasks=tasks)
    counts = all_.groupBy(by).agg(F.count("pick").alias("valid_candidates"), F.count_if(F.col("problem") == "java_compile_invalid").alias("_invalid"))
    rows = merge_items(items, by, tasks).join(counts, by, "left").withColumn("valid_candidates", F.coalesce("valid_candidates", F.lit(0)))
    goal = F.coalesce(F.nullif("target_candidates", F.lit(0)), F.lit(most)) if "target_candidates" in rows.columns else F.lit(most)
    rows = rows.withColumn("fill_rate", F.round(F.col("valid_candidates") / F.greatest(F.lit(1), goal), 4))
    if "drop_counts" in rows.columns:
        more = lambda k, n: n + F.when(k == "java_compile_invalid", F.coalesce("_invalid", F.lit(0))).otherwise(0)
        rows = rows.withColumn("drop_counts", F.transform_values("drop_counts", more))
    return rows.drop("_invalid"), all_.filter(F.col("pick").isNotNull())


def dataset_metrics(items: DataFrame, reasons: str = "java_validity_reason_counts") -> DataFrame:
    """One row over merged items, in one aggregate: sums, maxima, how many items have each flag, sums by known keys of the count maps (validity reasons too), mean fill rate and time."""
    have = set(items.columns)
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n if n.endswith("total") else f"{n}_total") for n in (*SUMS, "target_candidates", "valid_candidates") if n in have]
    flags = [F.count_if(n).alias(f"{n}_items") for n in ANY if n in have]
    maxima = [F.max(n).alias(f"{n}_max") for n in LARGEST[1:] if n in have]
    known = {n: keys for n, keys in {**COUNTED, reasons: VALIDITY_REASONS}.items() if keys and n in have}
    maps = [counted(keys)(n).alias(n) for n, keys in known.items()]
    means = [F.round(F.avg(n), 4).alias(f"{n}_mean") for n in ("fill_rate", "elapsed_seconds") if n in have]
    return items.agg(F.count("*").alias("items"), *sums, *flags, *maxima, *maps, *means)
