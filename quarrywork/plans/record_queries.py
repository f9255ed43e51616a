"""Queries of records, inference and roll-ups: pages and documents stand for records, events and lineitem for runs and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import inference as I
from quarrywork.operators import records, rollups
from quarrywork.plans.analytics_queries import RUNS, runs
from quarrywork.session import table

CODE = ("int f(int a) {\n return a;\n}", "def f(a):\n  return a", "public class A {", "x = 1")


def dataset_labels(spark, d):
    """Data set, language, public id and project of pages, whose url and text name some."""
    k = F.col("page_id")
    named = F.when(k % 5 == 0, F.lit(" Defects4J ")).when(k % 5 == 1, F.lit("other"))
    text = F.concat(F.coalesce("url", F.lit("")), F.when(k % 7 == 0, F.lit("/BugsInPy/x")).otherwise(F.lit("")))
    label = I.dataset_label([named], [text], F.when(k % 11 == 0, k), F.when(k % 13 == 0, k), F.when(k % 17 == 0, F.lit("bugsinpy")), F.lit("runs/defects4j_meta.json"))
    path = F.concat(F.lit("src/a"), F.element_at(F.array(*[F.lit(x) for x in (".JAVA", ".py", ".txt", "")]), (k % 4 + 1).cast("int")))
    code = F.element_at(F.array(*[F.lit(c) for c in CODE]), (F.floor(k / 4) % 4 + 1).cast("int"))
    repository = F.element_at(F.array(*[F.lit(x) for x in ("jfreechart", "joda-time", "gson", "pandas")]), (k % 4 + 1).cast("int"))
    return table(spark, d, "pages").select(
        "page_id", label.alias("dataset"), I.candidate_id(F.when(k % 3 == 0, F.concat(F.lit("BugsInPy:"), k.cast("string"))).otherwise(k.cast("string")), label).alias("candidate_id"),
        I.language(path, named).alias("language"), I.language(path, code=code).alias("by_code"), I.project_name(repository).alias("project"),
    )


LABELS = """WITH p AS (SELECT page_id, page_id % 4 AS m, CASE WHEN page_id % 5 = 0 THEN 'defects4j' WHEN page_id % 7 = 0 OR contains(lower(coalesce(url, '')), 'bugsinpy') THEN 'bugsinpy' WHEN contains(lower(coalesce(url, '')), 'defects4j') OR page_id % 11 = 0 THEN 'defects4j' WHEN page_id % 13 = 0 OR page_id % 17 = 0 THEN 'bugsinpy' ELSE 'defects4j' END AS dataset FROM pages)
SELECT page_id, dataset, CASE WHEN page_id % 3 = 0 THEN 'BugsInPy:' || page_id ELSE dataset || ':' || page_id END AS candidate_id, CASE WHEN m = 0 THEN 'java' ELSE 'python' END AS language,
  CASE WHEN m = 0 OR (m > 1 AND page_id // 4 % 4 IN (0, 2)) THEN 'java' ELSE 'python' END AS by_code, ['Chart', 'Time', 'Gson', 'pandas'][CAST(m AS INTEGER) + 1] AS project FROM p"""


def skipped_and_limited(spark, d):
    """The first five ids of each data set, without those whose reference solution fails."""
    p = table(spark, d, "part").withColumn("dataset", F.when(F.col("p_partkey") % 2 == 0, "bugsinpy").otherwise("defects4j"))
    kept = I.without_skipped(I.subset(p, "p_partkey", "p_partkey", listed=p.filter("p_size > 10").select("p_partkey")), "p_partkey", F.col("dataset"))
    return I.first_of_each(kept, "dataset", F.col("p_partkey"), 5).select("dataset", "p_partkey")


SKIPPED = """WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'bugsinpy' ELSE 'defects4j' END AS dataset, p_partkey FROM part WHERE p_size > 10),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p_partkey) AS n FROM p WHERE NOT (dataset = 'bugsinpy' AND p_partkey IN (1, 12, 13, 14, 15, 40, 55, 56, 57, 58, 59, 62, 63, 64, 65))) SELECT dataset, p_partkey FROM r WHERE n <= 5"""


def _record(spark, d) -> tuple[DataFrame, dict]:
    """Documents as records: the whole text is the function, its source the project and the file."""
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    node = lambda k: F.struct(F.concat(F.lit(f"call{k} "), F.coalesce("lang", F.lit(""))).alias("code"), F.when(F.col("doc_id") % 4 != k, F.concat(F.lit(f" type=Call{k}; dist="), (F.col("doc_id") % 9).cast("string"))).otherwise(F.lit(" ")).alias("reason"))
    path = F.concat(F.lit("lib/"), F.coalesce("source", F.lit("")), F.lit(".py"))
    line = F.when(F.col("doc_id") % 3 != 0, F.lit("return x + 1"))
    return docs, {"line": line, "code": F.col("t"), "nodes": F.array(*[node(k) for k in range(6)]), "file_name": F.when(F.col("doc_id") % 2 == 0, F.lit("a.py")), "file_path": path, "project": F.col("source")}


def record_texts(spark, d):
    docs, record = _record(spark, d)
    return docs.select("doc_id", F.md5(records.document_text(record).cast("binary")).alias("document_md5"), records.query_text(record).alias("query"))


RECORDS = """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'return x + 1' ELSE '' END AS line, CASE WHEN doc_id % 2 = 0 THEN 'a.py' ELSE '' END AS name, 'lib/' || coalesce(source, '') || '.py' AS path, coalesce(source, '') AS source, coalesce(lang, '') AS lang, regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9_]+') AS t,
  [CASE WHEN doc_id % 4 <> k THEN 'type=Call' || k || '; dist=' || (doc_id % 9) ELSE '' END FOR k IN range(0, 6)] AS said FROM documents)"""
RECORD_TEXTS = RECORDS + """, s AS (SELECT *, array_to_string(list_filter(said[1:3], lambda x: x <> ''), ' | ') AS three, array_to_string(list_filter(said[1:5], lambda x: x <> ''), ' | ') AS five FROM r)
SELECT doc_id, md5(array_to_string(list_filter([line, name, path, three, array_to_string(t[1:120], ' ')], lambda x: x <> ''), ' ' || chr(10) || ' ')) AS document_md5, array_to_string(list_filter([line, name, path, five], lambda x: x <> ''), ' ' || chr(10) || ' ') AS query FROM s"""


def record_bags(spark, d):
    """The weighted tokens of a record: the line three times, half of the function, and so on."""
    docs, record = _record(spark, d)
    bag = records.weighted_tokens(record)
    return docs.select("doc_id", F.size(bag).cast("bigint").alias("n"), F.md5(F.array_join(bag, " ").cast("binary")).alias("bag_md5"))


def _part(tokens: str, share: str) -> str:
    return f"CASE WHEN len({tokens}) > 0 THEN ({tokens})[1:greatest(1, CAST(floor(len({tokens}) * {share}) AS INTEGER))] ELSE [] END"


def _bags_sql() -> str:
    tok = lambda x: f"regexp_extract_all(lower({x}), '[A-Za-z0-9_]+')"
    nodes = " || ".join(f"c{k} || {_part(f'c{k}', '(1.2::DOUBLE - 1)')} || {_part(f'q{k}', '0.8::DOUBLE')}" for k in range(5))
    parts = ", ".join(f"{tok(f"'call{k} ' || lang")} AS c{k}, {tok(f'said[{k + 1}]')} AS q{k}" for k in range(5))
    return RECORDS + f""", s AS (SELECT *, {tok("line")} AS l, {tok("name")} AS f, {tok("path")} AS p, {tok("source")} AS o, t[1:256] AS body, {parts} FROM r),
b AS (SELECT doc_id, l || l || l || {_part("body", "0.6::DOUBLE")} || {nodes} || {_part("f", "0.4::DOUBLE")} || {_part("p", "0.4::DOUBLE")} || {_part("o", "0.3::DOUBLE")} AS bag FROM s)
SELECT doc_id, len(bag) AS n, md5(array_to_string(bag, ' ')) AS bag_md5 FROM b"""


def _one_hot():
    """A stub of a model: each key as the first unit vector."""
    import numpy as np

    def predict(keys, sizes):
        return np.eye(1, int(sizes[0])).repeat(len(keys), axis=0)

    return predict


def encoded_on_miss(spark, d):
    """Every hundredth vector against rows near it by id, as a top list; every third vector isn't stored, and a stub encodes it, but for some that it doesn't know: they stay, without a cosine."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v"))
    ranked = asked.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 12)).alias("vec_id")).join(v.select("vec_id"), "vec_id", "left_semi")
    ranked = ranked.withColumn("norm", 1 - (F.col("vec_id") - F.col("query_id") - 1) / 11)
    encode = records.batch_encoder(_one_hot, [F.col("vec_id"), F.col("_size")], "vec_id", "v")
    known = lambda missing: missing.filter("vec_id % 5 != 0").join(v.select("vec_id", F.size("v").alias("_size")), "vec_id")
    found = records.with_similarity(ranked, v.filter("vec_id % 3 != 0"), asked, "vec_id", "query_id", "v", lambda missing: encode(known(missing)))
    out = records.dense_rerank(found.withColumn("cos", F.round("cos", 6)), "query_id", "vec_id")
    return out.select("query_id", "vec_id", F.round("cos", 4).alias("cos"), F.round("fused", 3).alias("fused"), "rank")


MISSES = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN v WHEN vec_id % 5 <> 0 THEN list_transform(v, lambda x, i: CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS v FROM e),
c AS (SELECT q.vec_id AS query_id, s.vec_id, round(list_dot_product(q.v, s.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-12) * (sqrt(list_dot_product(s.v, s.v)) + 1e-12)), 6) AS cos FROM e q JOIN s ON q.vec_id % 100 = 0 AND s.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 12),
n AS (SELECT *, 0.4 * (1 - (vec_id - query_id - 1) / 11) + 0.6 * coalesce(CASE WHEN max(cos) OVER w > min(cos) OVER w THEN (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) END, 0) AS fused FROM c WINDOW w AS (PARTITION BY query_id))
SELECT query_id, vec_id, round(cos, 4) AS cos, round(fused, 3) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS INTEGER) AS rank FROM n"""


def fill_rates(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("target"), F.count_if(F.col("l_returnflag") != "R").alias("valid"))
    return rollups.fill_rates(items, "l_orderkey", "target", "valid", 3)


def validity_counters(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 5 != 0).alias("checked"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_linestatus") == "O").alias("valid"), (F.col("l_quantity") > 40).alias("rejected"), (F.col("l_quantity") < 10).alias("reranked"))
    return rollups.validity_counts(rows, "l_returnflag")


VALIDITY = """SELECT l_returnflag, count(*) FILTER (c) AS checked_n, count(*) FILTER (c AND v) AS valid_n, count(*) FILTER (c AND NOT v) AS invalid_n, count(*) FILTER (c AND l_quantity > 40) AS rejected_n, count(*) FILTER (c AND l_quantity < 10) AS reranked_n
FROM (SELECT *, l_linenumber % 5 <> 0 AS c, l_partkey % 3 <> 0 AND l_linestatus = 'O' AS v FROM lineitem) GROUP BY 1"""


def validity_reasons(spark, d):
    """Counts of the fixed reasons, also of those that don't occur; others are left out."""
    reasons = F.array(F.when(F.col("l_linenumber") % 2 == 0, F.lit("broad_rewrite")).otherwise(F.lit(" compile_fail ")), F.when(F.col("l_returnflag") == "R", F.lit("unheard_of")).otherwise(F.lit("")))
    return rollups.list_counts(table(spark, d, "lineitem").select(reasons.alias("reasons")), "reasons", rollups.VALIDITY_REASONS).withColumnRenamed("value", "reason")


REASONS = """SELECT v.reason, count(l_linenumber) AS n FROM (SELECT unnest(['unbalanced_delimiters', 'decl_kind_mismatch', 'signature_mismatch', 'wrapper_mismatch', 'model_artifact', 'broad_rewrite', 'new_helper_call', 'new_type_reference', 'new_constant_reference', 'new_identifier_reference', 'api_signature_drift', 'compile_fail']) AS reason) v
LEFT JOIN lineitem ON v.reason = CASE WHEN l_linenumber % 2 = 0 THEN 'broad_rewrite' ELSE 'compile_fail' END GROUP BY v.reason"""


def stage_counts(spark, d):
    p = table(spark, d, "pages")
    html = F.coalesce(F.trim("html"), F.lit(""))
    return rollups.stage_counts(p, F.col("page_id") % 4 != 0, (html != "") & (F.col("page_id") % 4 != 0) & (F.length(html) % 3 != 0), F.contains(html, F.lit("<table")))


STAGES = """WITH p AS (SELECT page_id % 4 <> 0 AS tried, coalesce(trim(html), '') <> '' AND page_id % 4 <> 0 AND length(trim(coalesce(html, ''))) % 3 <> 0 AS found, contains(coalesce(html, ''), '<table') AS failed FROM pages)
SELECT count(*) AS total, count(*) FILTER (NOT failed) AS enriched, count(*) FILTER (failed) AS errors, count(*) FILTER (tried AND NOT found) AS no_checkout, count(*) FILTER (found AND NOT failed) AS source_available FROM p"""


def run_metrics(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("target"), F.count("*").alias("valid"), F.sum("l_tax").alias("elapsed"), (F.max("l_returnflag") == "R").alias("rescued"), F.sum(F.col("l_partkey") % 3).alias("calls"))
    return rollups.run_metrics(items, flags=["rescued"], sums=["calls"])


METRICS = """WITH i AS (SELECT l_orderkey, max(l_linenumber) AS target, count(*) AS valid, sum(l_tax) AS elapsed, max(l_returnflag) = 'R' AS rescued, sum(l_partkey % 3) AS calls FROM lineitem GROUP BY 1)
SELECT count(*) AS items, CAST(sum(target) AS BIGINT) AS target_total, CAST(sum(valid) AS BIGINT) AS valid_total, round(sum(valid) / sum(target), 4) AS fill_rate, round(avg(elapsed), 4) AS mean_elapsed, count(*) FILTER (rescued) AS rescued_items, CAST(sum(calls) AS BIGINT) AS calls_total FROM i"""


def _first_failures(spark, d) -> DataFrame:
    """Users' first classes, and what three strategies solved."""
    first = runs(spark, d).groupBy("user_id").agg(F.min_by(F.struct("event_type", "k"), "event_id").alias("x"), *[F.max((F.col("strategy") == s) & F.col("solved")).alias(s) for s in ("one_shot", "blind_retry", "error_aware")])
    names = F.create_map(*[F.lit(x) for pair in {"purchase": "pass", "view": "compile_fail", "click": "no_valid_candidates", "error": "timeout"}.items() for x in pair])
    family = F.element_at(F.array(*[F.lit(x) for x in ("cannot_find_symbol", "", "syntax_or_parse")]), F.col("x.k") % 3 + 1)
    reason = F.coalesce(F.try_element_at(names, F.col("x.event_type")), F.col("x.event_type"))
    return first.withColumn("category", I.first_failure_class(F.col("user_id") % 9, reason, family, F.when(F.col("user_id") % 2 == 0, F.lit("x"))))


def failure_classes(spark, d):
    return _first_failures(spark, d).groupBy("category").agg(F.count("*").alias("n"))


CLASSES = RUNS + """, f AS (SELECT user_id, arg_min(event_type, event_id) AS e, arg_min(k, event_id) AS k, bool_or(strategy = 'one_shot' AND solved) AS one_shot, bool_or(strategy = 'blind_retry' AND solved) AS blind_retry, bool_or(strategy = 'error_aware' AND solved) AS error_aware FROM runs GROUP BY user_id),
c AS (SELECT *, CASE WHEN user_id % 9 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'infra_fail' ELSE 'no_iters' END WHEN e = 'purchase' THEN 'solved_iter0' WHEN e = 'view' THEN 'compile:' || ['cannot_find_symbol', 'other', 'syntax_or_parse'][k % 3 + 1] WHEN e = 'click' THEN 'parse_fail' WHEN e = 'error' THEN 'timeout' ELSE 'other:' || e END AS category FROM f)"""


def category_table(spark, d):
    return rollups.category_table(_first_failures(spark, d), "category", ("one_shot", "blind_retry", "error_aware"))


TABLE = CLASSES + """, p AS (SELECT *, list_position(['solved_iter0', 'test_fail', 'parse_fail', 'compile:cannot_find_symbol', 'compile:syntax_or_parse', 'compile:type_mismatch', 'compile:method_signature', 'compile:other_compile_fail', 'timeout', 'infra_fail'], category) AS place FROM c),
g AS (SELECT CAST(place AS INTEGER) AS place, category, one_shot, blind_retry, error_aware FROM p WHERE place > 0 UNION ALL SELECT 11, 'total', one_shot, blind_retry, error_aware FROM p WHERE place > 0)
SELECT place, category, count(*) AS n, count(*) FILTER (one_shot) AS one_shot_n, count(*) FILTER (blind_retry) AS blind_retry_n, count(*) FILTER (error_aware) AS error_aware_n FROM g GROUP BY place, category"""


def qualitative_cases(spark, d):
    """Users that the target solved after two runs or more and no baseline did, the first by number."""
    r = runs(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), *[F.max((F.col("strategy") == s) & F.col("solved")).alias(s) for s in ("one_shot", "blind_retry", "error_aware")])
    return r.filter(F.col("error_aware") & ~F.col("one_shot") & (F.col("n") >= 2)).orderBy("user_id").limit(5).select("user_id", "n")


QUERIES = {
    "dataset_labels": (dataset_labels, LABELS),
    "skipped_and_limited": (skipped_and_limited, SKIPPED),
    "record_texts": (record_texts, RECORD_TEXTS),
    "record_bags": (record_bags, _bags_sql()),
    "encoded_on_miss": (encoded_on_miss, MISSES),
    "fill_rates": (fill_rates, "WITH i AS (SELECT l_orderkey, max(l_linenumber) AS t, count(*) FILTER (l_returnflag <> 'R') AS v FROM lineitem GROUP BY 1), g AS (SELECT *, CASE WHEN t = 0 THEN v ELSE t END AS g FROM i) SELECT l_orderkey, g AS source_target, v AS source_valid, round(v / greatest(1, g), 4) AS source_rate, least(v, 3) AS valid, round(least(v, 3) / 3, 4) AS fill_rate FROM g"),
    "validity_counters": (validity_counters, VALIDITY),
    "validity_reasons": (validity_reasons, REASONS),
    "stage_counts": (stage_counts, STAGES),
    "run_metrics": (run_metrics, METRICS),
    "failure_classes": (failure_classes, CLASSES + " SELECT category, count(*) AS n FROM c GROUP BY category"),
    "category_table": (category_table, TABLE),
    "qualitative_cases": (qualitative_cases, RUNS + ", u AS (SELECT user_id, count(*) AS n, bool_or(strategy = 'one_shot' AND solved) AS a, bool_or(strategy = 'error_aware' AND solved) AS c FROM runs GROUP BY 1) SELECT user_id, n FROM u WHERE c AND NOT a AND n >= 2 ORDER BY user_id LIMIT 5"),
}
