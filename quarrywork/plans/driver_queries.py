"""Queries of samples, staged runs, fragments and merged runs; a lineitem row stands for a candidate of its order, a line status for a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.operators import candidates as C
from quarrywork.operators import analytics, pooling, sampling
from quarrywork.operators.stages import Driver, Stage
from quarrywork.session import table
from quarrywork.sources.work_folders import work_folder


def seeded_sample(spark, d):
    """60 of the orders that are finished, always the same ones."""
    failed = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return sampling.seeded_sample(failed, "o_orderkey", 60, 42)


SAMPLE = "SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 60"


def _enriched(pages: DataFrame) -> DataFrame:
    """Pages with their titles; a table without an end is an error."""
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    return pages.select("page_id", title.alias("title"), F.length(html).alias("size"), F.when(F.contains(html, F.lit("<table")) & ~F.contains(html, F.lit("</table>")), "open table").when(F.trim(html) == "", "no source").alias("error"))


def _totals(pages: DataFrame, orders: DataFrame) -> DataFrame:
    return pages.join(orders, F.col("page_id") == F.col("o_orderkey"), "left").groupBy((F.col("size") % 3).alias("size")).agg(F.count("*").alias("n"), F.count("o_orderkey").alias("known"), F.sum((F.col("title") != "").cast("int")).alias("titled"))


def stages(spark) -> list[Stage]:
    return [
        Stage("totals", _totals, ("enriched", "orders"), {"pages": F.sum("n"), "known": F.sum("known")}),
        Stage("enriched", _enriched, ("pages",), {"titled": F.count_if(F.col("title") != ""), "open_tables": F.count_if(F.col("error") == "open table")}),
    ]


def stage_driver(spark, d):
    """A graph of two stages, run twice: the counts of the pass that wrote, what was quarantined, and what the second run read."""
    sources = {"pages": table(spark, d, "pages"), "orders": table(spark, d, "orders").select("o_orderkey")}
    driver = Driver(spark, work_folder(spark, "stages"), sources, stages(spark))
    driver.run()
    report = driver.run()
    held = driver.quarantined("enriched").groupBy("error").agg(F.count("*").alias("n")).select(F.concat(F.lit("quarantined "), "error").alias("what"), "n")
    counted = report.select("stage", F.explode(F.map_concat("counts", F.create_map(F.lit("rows"), "rows", F.lit("failed"), "failed", F.lit("reused"), F.col("reused").cast("bigint")))).alias("k", "n"))
    return counted.select(F.concat("stage", F.lit(" "), "k").alias("what"), "n").unionByName(held)


STAGED = r"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, regexp_extract(coalesce(html, ''), '(?is)<title>(.*?)</title>', 1) AS title FROM pages),
e AS (SELECT *, CASE WHEN contains(h, '<table') AND NOT contains(h, '</table>') THEN 'open table' WHEN trim(h) = '' THEN 'no source' END AS error FROM p),
t AS (SELECT length(h) % 3 AS size, count(*) AS n, count(o_orderkey) AS known FROM e LEFT JOIN orders ON o_orderkey = page_id WHERE error IS NULL GROUP BY 1)
SELECT 'enriched rows' AS what, count(*) AS n FROM e UNION ALL SELECT 'enriched failed', count(error) FROM e UNION ALL SELECT 'enriched reused', 1 UNION ALL SELECT 'enriched titled', count(*) FILTER (title <> '') FROM e
UNION ALL SELECT 'enriched open_tables', count(*) FILTER (error = 'open table') FROM e UNION ALL SELECT 'totals rows', count(*) FROM t UNION ALL SELECT 'totals failed', 0 UNION ALL SELECT 'totals reused', 1
UNION ALL SELECT 'totals pages', CAST(sum(n) AS BIGINT) FROM t UNION ALL SELECT 'totals known', CAST(sum(known) AS BIGINT) FROM t UNION ALL SELECT 'quarantined ' || error, count(*) FROM e WHERE error IS NOT NULL GROUP BY 1"""

BASE = "public int f(int a) {\n    int one = first(a);\n    if (one > 2) {\n        use(one);\n    }\n    return one;\n}"


def fragment_merges(spark, d):
    """Texts inside fragments of a method: lines between two anchors, behind weak lines, a method of their own, nothing that is known, and a part whose braces close later."""
    text, k = F.coalesce("text", F.lit("")), F.col("turn") % 5
    fragment = (
        F.when(k == 0, F.concat(F.lit("int one = first(a);\n"), text, F.lit("\nif (one > 2) {")))
        .when(k == 1, F.concat(F.lit("{\nint one = first(a);\n"), text))
        .when(k == 2, F.concat(F.lit("public int g() {\n"), text, F.lit("\n}")))
        .when(k == 3, text)
        .otherwise("return one;\n}")
    )
    base = F.lit(BASE)
    response = F.concat(F.lit("Here:\n```java\n"), fragment, F.lit("\n```\n"))
    return table(spark, d, "conversations").select("conv_id", "turn", C.merged(base, fragment).alias("merged"), C.extract_and_merge(response, base).alias("extracted"))


FRAGMENTS = r"""WITH t AS (SELECT conv_id, turn, turn % 5 AS k, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '\s+$', '') AS tail FROM conversations),
l AS (SELECT *, regexp_replace(x, '(?m)^(.*\S.*)$', '    \1', 'g') AS moved, 'public int f(int a) {' || chr(10) || '    int one = first(a);' || chr(10) AS head, '    if (one > 2) {' || chr(10) AS cond, '        use(one);' || chr(10) || '    }' || chr(10) || '    return one;' || chr(10) || '}' AS rest FROM t),
m AS (SELECT *, CASE k WHEN 0 THEN head || moved || chr(10) || cond || rest WHEN 1 THEN '{' || chr(10) || 'int one = first(a);' || CASE WHEN tail = '' THEN '' ELSE chr(10) || tail END || chr(10) || cond || rest WHEN 2 THEN 'public int g() {' || chr(10) || x || chr(10) || '}'
  WHEN 4 THEN head || cond || '        use(one);' || chr(10) || '    }' || chr(10) || '    return one;' || chr(10) || '    }' END AS merged FROM l)
SELECT conv_id, turn, merged, CASE WHEN k = 0 THEN 'int one = first(a);' || chr(10) || x || chr(10) || 'if (one > 2) {' ELSE merged END AS extracted FROM m"""

STATUSES = ("O", "F")


def _run(spark, d, status: str) -> tuple[DataFrame, DataFrame]:
    """The items of a run with fields of all policies, and its candidates."""
    lines = table(spark, d, "lineitem").filter(F.col("l_linestatus") == status)
    late = F.lit(status == "F")
    tag = F.min("l_returnflag")
    counts = lambda *pairs: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("bigint").alias("v")) for k, v in pairs]), lambda e: e["v"] > 0))
    items = lines.groupBy("l_orderkey").agg(
        F.when(late | (F.min("l_partkey") % 2 == 0), F.concat(F.lit("f"), F.min("l_partkey").cast("string"))).alias("function_name"),
        F.count("*").alias("llm_calls_total"), F.sum("l_linenumber").cast("double").alias("elapsed_seconds"), F.max("l_linenumber").alias("target_candidates"), F.max("l_quantity").cast("int").alias("gen_n"),
        F.bool_or(F.col("l_returnflag") == "R").alias("plan_fill_used"), F.array(F.min("l_suppkey"), F.max("l_suppkey")).alias("temperature_used"), F.sort_array(F.collect_set("l_returnflag")).alias("profiles_tried"),
        F.when(F.min("l_partkey") % 3 == 0, "").when(F.min("l_partkey") % 3 == 1, tag).alias("scheduler"), F.when(late, F.array(tag)).otherwise(F.array().cast("array<string>")).alias("allowed_edit_types"),
        counts(("duplicate", F.count_if(F.col("l_returnflag") == "R")), ("syntax_fail", F.count_if(F.col("l_returnflag") == "A")), ("unheard_of", F.count("*"))).alias("drop_counts"),
        counts(("wrap", F.count_if(F.col("l_linenumber") > 2)), ("none", F.count("*"))).alias("java_decl_recovery_mode_counts"), counts(("stage1", F.count("*")), ("stage2", F.count_if(F.col("l_linenumber") > 3))).alias("unique_after_stage"),
    )
    found = lines.select(
        "l_orderkey", F.concat_ws(":", F.lpad("l_linenumber", 2, "0"), F.lpad("l_partkey", 8, "0"), F.lpad("l_suppkey", 8, "0")).alias("place"), (F.col("l_linenumber") == 1).alias("greedy"),
        F.when(F.col("l_partkey") % 7 == 0, " ").otherwise(F.concat(F.lit("x  = "), (F.col("l_partkey") % 4).cast("string"), F.lit("  # "), "l_returnflag")).alias("code"),
        F.col("l_quantity").cast("int").alias("q"),
    )
    return items, found


def _judge(rows: DataFrame) -> DataFrame:
    """Scores by quantity; some candidates may not compile."""
    return rows.withColumns({"score": F.col("q") % 10, "problem": F.when(F.col("q") % 5 == 0, "java_compile_invalid")})


def merged_runs(spark, d):
    """Two runs of each order as one: every policy, and candidates judged again."""
    runs = [_run(spark, d, s) for s in STATUSES]
    rows, _ = pooling.merge_runs([i for i, _ in runs], [c for _, c in runs], "l_orderkey", "place", _judge, 3)
    shown = lambda c: F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    kept = F.array_join(F.transform(F.sort_array(F.map_entries(F.map_filter("drop_counts", lambda _, v: v > 0))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.select(
        "l_orderkey", "n_runs", "function_name", "llm_calls_total", "elapsed_seconds", "target_candidates", "gen_n", "plan_fill_used", joined("temperature_used").alias("temperature_used"), joined("profiles_tried").alias("profiles_tried"), "scheduler",
        joined("allowed_edit_types").alias("allowed_edit_types"), kept.alias("drop_counts"), F.size("drop_counts").alias("n_reasons"), shown("java_decl_recovery_mode_counts").alias("recovery"), shown("unique_after_stage").alias("unique_after_stage"), "valid_candidates", "fill_rate",
    )


def merged_candidates(spark, d):
    """What became of each candidate of two runs: its problem, or its place among those that are kept."""
    found = pooling.merge_candidates([_run(spark, d, s)[1] for s in STATUSES], "l_orderkey", "place", _judge, 3)
    return found.select("l_orderkey", "place", "run_no", "problem", "pick")


def dataset_metrics(spark, d):
    """The merged runs as one row of totals."""
    runs = [_run(spark, d, s) for s in STATUSES]
    rows, _ = pooling.merge_runs([i for i, _ in runs], [c for _, c in runs], "l_orderkey", "place", _judge, 3)
    out = pooling.dataset_metrics(rows)
    return out.select(*[c for c in out.columns if c != "drop_counts"], *[F.col("drop_counts")[k].alias(f"drop_{k}") for k in ("duplicate", "syntax_fail", "java_compile_invalid")])


_NOTE = "CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE 'x = ' || (l_partkey % 4) END"
_CANDIDATES = f"""c AS (SELECT l_orderkey, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS place, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS run_no, l_linenumber = 1 AS greedy, {_NOTE} AS code, CAST(l_quantity AS INTEGER) % 10 AS score,
    CASE WHEN CAST(l_quantity AS INTEGER) % 5 = 0 THEN 'java_compile_invalid' END AS bad FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, code, bad IS NULL ORDER BY run_no, place) AS k FROM c WHERE code <> ' '), j AS (SELECT *, coalesce(bad, CASE WHEN k > 1 THEN 'duplicate' END) AS problem FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, problem IS NULL ORDER BY NOT greedy, coalesce(nullif(score, 0), -1000000000) DESC, run_no, place) AS n FROM j)"""
CANDIDATES = f"WITH {_CANDIDATES} SELECT l_orderkey, place, run_no, problem, CASE WHEN problem IS NULL AND n <= 3 THEN CAST(n AS INTEGER) END AS pick FROM r"
_ITEMS = f"""WITH {_CANDIDATES},
i AS (SELECT l_orderkey, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS run, CASE WHEN l_linestatus = 'F' OR min(l_partkey) % 2 = 0 THEN 'f' || min(l_partkey) END AS f, count(*) AS calls, sum(l_linenumber) AS secs, max(l_linenumber) AS target, CAST(max(l_quantity) AS INTEGER) AS gen, bool_or(l_returnflag = 'R') AS fill,
    [min(l_suppkey), max(l_suppkey)] AS temps, list_sort(list_distinct(list(l_returnflag))) AS tags, CASE min(l_partkey) % 3 WHEN 1 THEN min(l_returnflag) END AS sched, CASE WHEN l_linestatus = 'F' THEN min(l_returnflag) END AS edit, count(*) FILTER (l_returnflag = 'R') AS dup, count(*) FILTER (l_returnflag = 'A') AS syn,
    count(*) FILTER (l_linenumber > 2) AS wrap, count(*) FILTER (l_linenumber > 3) AS st2 FROM lineitem GROUP BY l_orderkey, l_linestatus),
a AS (SELECT l_orderkey, count(DISTINCT run) AS n_runs, first(f ORDER BY run) FILTER (f IS NOT NULL) AS function_name, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(secs) AS DOUBLE) AS secs, max(target) AS target, max(gen) AS gen, bool_or(fill) AS fill, flatten(list(temps ORDER BY run)) AS temps, flatten(list(tags ORDER BY run)) AS tags,
    coalesce(last(sched ORDER BY run) FILTER (sched IS NOT NULL), 'fixed') AS sched, coalesce(max(edit), 'REPLACE') AS edit, CAST(sum(dup) AS BIGINT) AS dup, CAST(sum(syn) AS BIGINT) AS syn, CAST(sum(wrap) AS BIGINT) AS wrap, max(calls) AS st1, max(st2) AS st2 FROM i GROUP BY l_orderkey),
v AS (SELECT l_orderkey, count(*) FILTER (problem IS NULL AND n <= 3) AS valid, count(*) FILTER (problem = 'java_compile_invalid') AS bad FROM r GROUP BY 1),
m AS (SELECT a.*, coalesce(valid, 0) AS valid, coalesce(bad, 0) AS bad, round(coalesce(valid, 0) / greatest(1, target), 4) AS rate FROM a LEFT JOIN v USING (l_orderkey))"""
MERGED = _ITEMS + """ SELECT l_orderkey, n_runs, function_name, calls AS llm_calls_total, secs AS elapsed_seconds, target AS target_candidates, gen AS gen_n, fill AS plan_fill_used, array_to_string(temps, ',') AS temperature_used,
  array_to_string(list_transform(list_filter(list_zip(tags, range(len(tags))), lambda x: list_position(tags, x[1]) = x[2] + 1), lambda x: x[1]), ',') AS profiles_tried, sched AS scheduler, edit AS allowed_edit_types,
  concat_ws(';', CASE WHEN dup > 0 THEN 'duplicate=' || dup END, CASE WHEN bad > 0 THEN 'java_compile_invalid=' || bad END, CASE WHEN syn > 0 THEN 'syntax_fail=' || syn END) AS drop_counts, 18 AS n_reasons, concat_ws(';', 'none=' || calls, CASE WHEN wrap > 0 THEN 'wrap=' || wrap END) AS recovery,
  concat_ws(';', 'stage1=' || st1, CASE WHEN st2 > 0 THEN 'stage2=' || st2 END) AS unique_after_stage, valid AS valid_candidates, rate AS fill_rate FROM m"""
METRICS = _ITEMS + """ SELECT count(*) AS items, CAST(sum(calls) AS BIGINT) AS llm_calls_total, sum(secs) AS elapsed_seconds_total, CAST(sum(target) AS BIGINT) AS target_candidates_total, CAST(sum(valid) AS BIGINT) AS valid_candidates_total, count(*) FILTER (fill) AS plan_fill_used_items, max(gen) AS gen_n_max,
  round(avg(rate), 4) AS fill_rate_mean, round(avg(secs), 4) AS elapsed_seconds_mean, CAST(sum(dup) AS BIGINT) AS drop_duplicate, CAST(sum(syn) AS BIGINT) AS drop_syntax_fail, CAST(sum(bad) AS BIGINT) AS drop_java_compile_invalid FROM m"""

def run_summary(spark, d):
    """Orders as a run's items, their lines as rounds."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("l_linestatus") == "O", F.col("l_linenumber"))).alias("at"), F.sum("l_linenumber").alias("candidates"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("flag"), F.min("l_partkey").alias("part"),
    )
    k = F.col("part") % 5
    items = lines.select(
        F.when(F.col("part") % 11 == 0, "infra_fail").alias("status"), F.col("at").isNotNull().alias("solved"), F.col("at").alias("solving_iteration"), F.col("n").alias("calls"), "candidates", F.when(k == 0, "cannot_find_symbol").when(k == 1, "").alias("first_family"),
        F.when(k == 1, "compile_fail").when(k == 2, "pass").otherwise(F.concat(F.lit("test_"), "flag")).alias("first_reason"), F.when(k > 2, F.concat(F.lit("at_"), "flag")).alias("final_reason"), (F.col("n") - 1).alias("n_iterations"),
    )
    return analytics.run_summary(items)


SUMMARY = """WITH l AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) FILTER (l_linestatus = 'O') AS at_, sum(l_linenumber) AS found, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS flag, min(l_partkey) AS part FROM lineitem GROUP BY 1),
i AS (SELECT *, CASE part % 5 WHEN 0 THEN 'cannot_find_symbol' WHEN 1 THEN 'unknown_compile' WHEN 2 THEN NULL ELSE 'test_' || flag END AS fam, CASE WHEN part % 5 = 0 AND at_ > 1 AND n > 2 THEN 1 ELSE 0 END AS back FROM l WHERE part % 11 <> 0),
u AS (SELECT 'all' AS dimension, '' AS key, * FROM i UNION ALL SELECT 'solved_at_iteration', CAST(at_ AS VARCHAR), * FROM i WHERE at_ IS NOT NULL UNION ALL SELECT 'error_family', fam, * FROM i WHERE fam IS NOT NULL AND n > 1 UNION ALL SELECT 'unsolved_fail_reason', CASE WHEN part % 5 > 2 THEN 'at_' || flag ELSE 'unknown' END, * FROM i WHERE at_ IS NULL)
SELECT dimension, key, count(*) AS n, CAST(sum(back) AS BIGINT) AS recovered, CASE dimension WHEN 'all' THEN round(count(at_) / count(*), 4) WHEN 'error_family' THEN round(sum(back) / count(*), 3) END AS rate, round(sum(n) / count(*), 2) AS avg_calls, round(sum(found) / count(*), 2) AS avg_candidates FROM u GROUP BY 1, 2"""

QUERIES = {
    "seeded_sample": (seeded_sample, SAMPLE),
    "stage_driver": (stage_driver, STAGED),
    "fragment_merges": (fragment_merges, FRAGMENTS),
    "run_summary": (run_summary, SUMMARY),
    "merged_runs": (merged_runs, MERGED),
    "merged_candidates": (merged_candidates, CANDIDATES),
    "dataset_metrics": (dataset_metrics, METRICS),
}
