"""Queries of Java text: conversations' whole texts stand in code, as statements, comments or candidates of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import java
from quarrywork.operators import java_validity as V
from quarrywork.operators import rollups
from quarrywork.session import spread, table


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: SQL of a text's distinct words, and of what sorts of names they are.
WORDS = r"list_distinct(list_filter(string_split_regex(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda w: w <> ''))"
TYPES = "list_filter(w, lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9_]*'))"
CONSTANTS = "list_filter(w, lambda x: regexp_full_match(x, '[A-Z][A-Z0-9_]+'))"
LOWER = f"list_filter(w, lambda x: regexp_full_match(x, '[a-z_][A-Za-z0-9_]+') AND NOT list_contains({_list(java.KEYWORDS)}, x))"


def java_symbols(spark, d):
    """A method with comments, strings and calls of other objects, and a text behind it."""
    head = 'int f(int a, List<Map<String,Integer>> b) throws X {\n if (a > MAX_N) { g(h(a)); obj.run(a); }\n String s = "call(x)"; /* old(a) */ int ID = new Bar(b); // gone(a)\n'
    code = F.concat(F.lit(head), F.coalesce("text", F.lit("")), F.lit("\n}"))
    h = java.contract(code)
    joined = lambda x: F.array_join(x, ",")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", h["name"].alias("name"), h["kind"].alias("kind"), h["arity"].alias("arity"), h["throws"].alias("throws"), joined(java.calls(code)).alias("calls"), joined(java.types(code)).alias("types"),
        joined(java.constants(code)).alias("constants"), joined(java.lower_names(code)).alias("lower_names"), java.balanced(code).alias("balanced"), java.declarations(code).alias("declarations"),
    )


def _sorted(sql: str, more) -> str:
    return f"array_to_string(list_sort(list_distinct({sql} || {_list(more)})), ',')"


SYMBOLS = f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations)
SELECT conv_id, turn, 'f' AS name, 'method' AS kind, 2 AS arity, 'X' AS throws, 'f,g,h' AS calls, {_sorted(TYPES, ("List", "Map", "String", "Integer", "X", "MAX_N", "ID", "Bar"))} AS types,
  {_sorted(CONSTANTS, ("MAX_N", "ID"))} AS constants, {_sorted(LOWER, ("obj", "run"))} AS lower_names, true AS balanced, 1 AS declarations FROM t"""


def allow_lists(spark, d):
    """Symbols that a part's function may refer to, and what supports each."""
    base = F.concat(F.lit("int f(List a) { this."), F.substring_index("p_name", " ", 1), F.lit(" = Helper.make(a); // gone(a)\n return g(a); }"))
    summary = "- Referenced helper methods in this method: one, two(x, y)\n- Types referenced in this method: Map<A, B>, util.C\nOther: d2"
    rows = spread(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").select(
        "p_partkey", base.alias("base"), F.lit("int f(List a, Other bb)").alias("signature"), F.lit(summary).alias("summary"), F.array(F.lit("g"), F.lit(" this.h() ")).alias("helper_calls"), F.array("p_brand", F.lit("")).alias("type_names"),
        F.split("p_name", " ").alias("fields"), F.lit("Referenced instance fields: pf").alias("prompt"),
    )
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(V.supports(F.array_distinct(F.transform("a.support", lambda p: p["symbol"])), F.col("a.support")))), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")
    return rows.withColumn("a", V.allowed(True)).select("p_partkey", entries.alias("allowed"), F.size("a.types").alias("n_types"))


ALLOWED = f"""WITH s AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS s, 'instance_fields' AS v FROM part UNION ALL SELECT p_partkey, p_brand, 'types' FROM part
  UNION ALL SELECT p_partkey, unnest(['f', 'g', 'h']), 'helper_calls' FROM part UNION ALL SELECT p_partkey, unnest(['Helper', 'List']), 'types' FROM part UNION ALL SELECT p_partkey, unnest(['List', 'Other', 'a', 'bb']), 'method_signature' FROM part
  UNION ALL SELECT p_partkey, unnest(['one', 'two(x, y)', 'Map<A, B>', 'C', 'two', 'methods', 'method', 'helper', 'in', 'd2', 'util', 'referenced']), 'context_summary' FROM part UNION ALL SELECT p_partkey, 'pf', 'instance_fields' FROM part),
g AS (SELECT p_partkey, s, string_agg(v, '+' ORDER BY v) AS v FROM (SELECT DISTINCT * FROM s) GROUP BY ALL), n AS (SELECT p_partkey, count(DISTINCT s) AS n FROM (SELECT p_partkey, s FROM s WHERE v IN ('types') OR s IN ('List', 'Other', 'Map<A, B>', 'C') UNION ALL SELECT p_partkey, unnest({_list(java.COMMON_TYPES)}) FROM part) GROUP BY 1)
SELECT p_partkey, string_agg(s || '=' || v, ';' ORDER BY s) AS allowed, CAST(any_value(n) AS INTEGER) AS n_types FROM g JOIN n USING (p_partkey) GROUP BY p_partkey"""


def _candidates(spark, d) -> DataFrame:
    """A function and what a text makes of it: a statement more, a header with a parameter more, another name and an open bracket, another return value, or the text alone."""
    text, k = F.coalesce("text", F.lit("")), F.col("turn") % 5
    base = "int f(int a) throws X {\n  return g(a);\n}"
    code = (
        F.when(k == 0, F.concat(F.lit("int f(int a) throws X {\n"), text, F.lit("\n  return g(a);\n}")))
        .when(k == 1, F.concat(F.lit("int f(int a, Map<String,Integer> b) throws X {\n  return g(a); // "), F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\n}")))
        .when(k == 2, F.concat(F.lit("int h(int a) throws X {\n  return g(a;\n"), text, F.lit("\n}")))
        .when(k == 3, F.concat(F.lit("int f(int a) throws X {\n  return zap(a) + "), text, F.lit(";\n}")))
        .otherwise(text)
    )
    line: Column = F.when(F.col("conv_id") % 3 == 1, 2).when(F.col("conv_id") % 3 == 2, 20)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.lit(base).alias("base"), code.alias("code"), F.lit("f").alias("name"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("this.zap()"))).alias("helper_calls"), F.array(F.regexp_extract(text, "[A-Za-z]+", 0)).alias("type_names"),
        line.cast("int").alias("bug_line"), (F.col("turn") % 2 == 0).alias("plan_ok"), (F.col("conv_id") % 8).cast("int").alias("violations"), (F.col("conv_id") % 5 == 0).alias("filled"), F.lit(100.0).alias("score"),
    )


def candidate_validity(spark, d):
    """Reasons, those that are hard, and the combinations that made them so."""
    found = V.judged(V.analysed(_candidates(spark, d)), filtering=True, promote=True)
    joined = lambda x: F.array_join(x, ",")
    return found.select("conv_id", "turn", joined("reasons").alias("reasons"), joined(F.array_sort("hard_reasons")).alias("hard_reasons"), joined(F.transform("combinations", lambda c: c["detail"])).alias("combinations"), "valid", "compile_problem", joined("drift.new_types").alias("new_types"), joined("drift.new_identifiers").alias("new_identifiers"), joined("drift.new_calls").alias("new_calls"))


def validity_by_role(spark, d):
    """How many candidates have each reason: what the rules name, the counters count."""
    found = V.judged(V.analysed(_candidates(spark, d)))
    return rollups.list_counts(found, "reasons", rollups.VALIDITY_REASONS)


def semantic_rerank(spark, d):
    """Scores by all features; what each feature earns or costs."""
    found = V.reranked(V.analysed(_candidates(spark, d)))
    points = F.array_join(F.transform(F.array_sort(F.map_entries("points")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ";")
    return found.select("conv_id", "turn", "score", points.alias("points"), "features.*")


_DECLARED = r"\b(?:final\s+)?(?:[A-Z][\p{L}\p{N}_$<>\[\],.?&\s]*|boolean|byte|short|int|long|float|double|char)\s+([a-z_][A-Za-z0-9_$]*)\s*[=;,)]"
_ARTIFACT = r"(?i)this is the corrected version|changed line|replace if|buggy line|rest of the code|rest of the function|rest of the method|todo\b"
_HINT = r"(?i)corrected\b|fixed(\s+line)?\b|patched(\s+line)?\b|omitted for brevity"
#: What the texts make of the function, step by step: words by sort, what is allowed, what is new, reasons.
DRIFT = rf"""WITH t AS (SELECT conv_id, turn, turn % 5 AS k, turn % 2 = 0 AS plan, coalesce(text, '') AS x, {WORDS} AS w, regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS sym,
    length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n FROM conversations),
s AS (SELECT *, CASE WHEN k = 1 THEN ['Map', 'String', 'Integer'] ELSE {TYPES} END AS ty, CASE WHEN k = 1 THEN [] ELSE {CONSTANTS} END AS co, CASE WHEN k = 1 THEN [] WHEN k = 3 THEN {LOWER} || ['zap'] ELSE {LOWER} END AS lo,
    CASE WHEN k = 1 THEN [] ELSE list_distinct(regexp_extract_all(CASE WHEN k = 3 THEN 'return zap(a) + ' || x || ';' ELSE x END, '{_DECLARED}', 1)) END AS de,
    {_list(java.COMMON_TYPES)} || ['X', sym] AS oktypes, CASE WHEN conv_id % 2 = 0 THEN ['f', 'g', 'a', 'zap'] ELSE ['f', 'g', 'a'] END AS oknames,
    CASE k WHEN 0 THEN n / 3 WHEN 1 THEN 2 / 3 WHEN 2 THEN (2 + n) / 3 WHEN 3 THEN n / 3 ELSE greatest(3, CASE WHEN x = '' THEN 0 ELSE n END) / 3 END AS frac FROM t),
v AS (SELECT *, list_filter(ty, lambda i: NOT list_contains(oktypes, i) AND i <> 'X') AS ntypes, list_filter(ty, lambda i: list_contains(oktypes, i) AND i <> 'X') AS oty,
    list_filter(co, lambda i: NOT list_contains(oktypes, i)) AS nco, list_filter(co, lambda i: list_contains(oktypes, i)) AS oco,
    CASE WHEN k = 2 THEN ['h'] WHEN k = 3 AND conv_id % 2 = 1 THEN ['zap'] ELSE [] END AS ncalls FROM s),
c AS (SELECT *, list_filter(lo, lambda i: NOT list_contains(oktypes || oknames || de || ncalls, i)) AS nid, list_filter(lo, lambda i: list_contains(oktypes || oknames, i)) AS oid, k IN (1, 2) AS drift,
    CASE WHEN k = 4 AND trim(x, chr(10) || chr(9) || ' ') = '' THEN 'empty_code' WHEN k = 2 THEN 'unbalanced_delimiters' WHEN k = 4 THEN 'no_java_declaration' END AS problem FROM v),
r AS (SELECT *, list_filter([CASE WHEN regexp_matches(x, '[^\x00-\x7F]') OR regexp_matches(x, '{_ARTIFACT}') OR regexp_matches(x, '{_HINT}') THEN 'model_artifact' END, CASE WHEN k = 2 THEN 'unbalanced_delimiters' END, CASE WHEN k IN (1, 2) THEN 'signature_mismatch' END,
    CASE WHEN frac > 0.6 OR (frac > 0.45 AND NOT plan) THEN 'broad_rewrite' END, CASE WHEN len(ncalls) > 0 THEN 'new_helper_call' END, CASE WHEN len(ntypes) > 0 THEN 'new_type_reference' END, CASE WHEN len(nco) > 0 THEN 'new_constant_reference' END,
    CASE WHEN len(nid) > 0 THEN 'new_identifier_reference' END, CASE WHEN drift THEN 'api_signature_drift' END, CASE WHEN problem IS NOT NULL THEN 'compile_fail' END], lambda i: i IS NOT NULL) AS reasons,
    list_filter([CASE WHEN len(ncalls) > 0 THEN 'new_helper_call' END, CASE WHEN len(ntypes) > 0 THEN 'new_type_reference' END, CASE WHEN len(nco) > 0 THEN 'new_constant_reference' END, CASE WHEN len(nid) > 0 THEN 'new_identifier_reference' END], lambda i: i IS NOT NULL) AS refs FROM c)"""
VALIDITY = DRIFT + """, b AS (SELECT *, CASE WHEN frac > 0.6 AND len(refs) >= 2 THEN 1 END AS c1, CASE WHEN frac > 0.45 AND NOT plan AND len(refs) >= 3 THEN 1 END AS c2, CASE WHEN len(ncalls) + len(ntypes) + len(nco) + len(nid) >= 4 THEN 1 END AS c3,
    CASE WHEN len(ntypes) > 0 AND len(nid) > 0 AND NOT plan THEN 1 END AS c4, CASE WHEN len(nco) > 0 AND len(nid) > 0 AND NOT plan THEN 1 END AS c5 FROM r),
h AS (SELECT *, list_sort(list_distinct(list_filter(reasons, lambda i: i IN ('model_artifact', 'unbalanced_delimiters', 'signature_mismatch', 'api_signature_drift', 'compile_fail')) || CASE WHEN c1 = 1 OR c2 = 1 THEN ['broad_rewrite'] || refs ELSE [] END || CASE WHEN c3 = 1 THEN refs ELSE [] END
    || CASE WHEN c4 = 1 THEN ['new_type_reference', 'new_identifier_reference'] ELSE [] END || CASE WHEN c5 = 1 THEN ['new_constant_reference', 'new_identifier_reference'] ELSE [] END)) AS hard FROM b)
SELECT conv_id, turn, array_to_string(reasons, ',') AS reasons, array_to_string(hard, ',') AS hard_reasons, array_to_string(list_filter([CASE WHEN c1 = 1 THEN 'broad_rewrite_severe+new_refs' END, CASE WHEN c2 = 1 THEN 'broad_rewrite_moderate+new_ref_categories_ge_3' END,
    CASE WHEN c3 = 1 THEN 'new_ref_total_ge_4' END, CASE WHEN c4 = 1 THEN 'type_plus_identifier' END, CASE WHEN c5 = 1 THEN 'constant_plus_identifier_without_plan_ok' END], lambda i: i IS NOT NULL), ',') AS combinations, len(hard) = 0 AS valid, problem AS compile_problem,
    array_to_string(list_sort(ntypes), ',') AS new_types, array_to_string(list_sort(nid), ',') AS new_identifiers, array_to_string(ncalls, ',') AS new_calls FROM h"""
COUNTED = DRIFT + f""", u AS (SELECT unnest(reasons) AS value FROM r) SELECT k.value, count(u.value) AS n FROM (SELECT unnest({_list(rollups.VALIDITY_REASONS)}) AS value) k LEFT JOIN u USING (value) GROUP BY 1"""
RERANK = DRIFT + rf""", i AS (SELECT *, list_distinct(list_filter(w, lambda j: regexp_matches(j, '^[A-Za-z_]') AND NOT list_contains({_list(java.KEYWORDS)}, j)) || CASE k WHEN 0 THEN ['f', 'a', 'X', 'g'] WHEN 1 THEN ['f', 'a', 'X', 'g', 'Map', 'String', 'Integer', 'b'] WHEN 2 THEN ['h', 'a', 'X', 'g'] WHEN 3 THEN ['f', 'a', 'X', 'zap'] ELSE [] END) AS ids,
    (CASE WHEN frac > 0.5 OR (frac > 0.35 AND NOT plan) THEN 1 ELSE 0 END) AS broad, len(oty) + len(oco) + len(oid) AS reused, CAST(conv_id % 8 AS INTEGER) AS viol FROM r),
f AS (SELECT *, CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda j: j IN ('f', 'a', 'X', 'g'))) / len(ids) ELSE 0 END AS reuse, broad + (len(ntypes) > 0)::INT + (len(nco) > 0)::INT + (len(nid) > 0)::INT AS pen,
    CASE conv_id % 3 WHEN 1 THEN abs(CASE k WHEN 1 THEN 1.5 WHEN 2 THEN 1.5 ELSE 2 END - 2) WHEN 2 THEN abs(CASE k WHEN 1 THEN 1.5 WHEN 2 THEN 1.5 ELSE 2 END - 20) END AS dist,
    regexp_matches(x, '{_ARTIFACT}') OR regexp_matches(x, '(?i)omitted for brevity') AS art, regexp_matches(x, '(?i)\b(explanation|analysis|reasoning)\b') AS tail FROM i),
g AS (SELECT *, broad = 1 AND pen >= 2 AS combo, CASE WHEN reused > 0 AND broad = 0 AND pen < 3 THEN reused ELSE 0 END AS rewarded FROM f),
p AS (SELECT *, list_filter([{{'n': 'api_signature_drift', 'p': CASE WHEN drift THEN -20 ELSE 0 END}}, {{'n': 'broad_rewrite_combo', 'p': CASE WHEN combo THEN -8 ELSE 0 END}}, {{'n': 'exact_signature_preservation', 'p': CASE WHEN k IN (0, 3) THEN 20 ELSE 0 END}},
    {{'n': 'high_violation_count', 'p': -least(16, 3 * viol)}}, {{'n': 'markdown_or_explanation_tail', 'p': CASE WHEN tail THEN -25 ELSE 0 END}}, {{'n': 'model_artifact', 'p': CASE WHEN art THEN -40 ELSE 0 END}},
    {{'n': 'near_bug_region', 'p': CASE WHEN dist <= 2 THEN 12 WHEN dist <= 5 THEN 6 WHEN dist >= 12 THEN -4 ELSE 0 END}}, {{'n': 'new_constant_reference_count', 'p': -least(12, 4 * len(nco))}}, {{'n': 'new_helper_call_count', 'p': -least(24, 8 * len(ncalls))}},
    {{'n': 'new_identifier_reference_count', 'p': -least(12, 3 * len(nid))}}, {{'n': 'new_type_reference_count', 'p': -least(18, 6 * len(ntypes))}}, {{'n': 'no_violation', 'p': CASE WHEN viol = 0 THEN 8 ELSE 0 END}},
    {{'n': 'original_identifier_reuse', 'p': CASE WHEN reuse >= 0.9 THEN 12 WHEN reuse >= 0.75 THEN 8 WHEN reuse < 0.45 THEN -8 ELSE 0 END}}, {{'n': 'penalty_only_reason_count', 'p': CASE WHEN pen >= 3 THEN -14 WHEN pen >= 2 THEN -6 ELSE 0 END}},
    {{'n': 'plan_fill_selected', 'p': CASE WHEN conv_id % 5 = 0 THEN -8 ELSE 0 END}}, {{'n': 'plan_ok', 'p': CASE WHEN plan THEN 15 ELSE 0 END}}, {{'n': 'rewarded_reuse', 'p': least(6, 2 * rewarded)}}, {{'n': 'rewrite', 'p': CASE WHEN frac > 0.5 THEN -20 WHEN frac > 0.35 THEN -10 WHEN frac > 0.25 THEN -4 ELSE 0 END}},
    {{'n': 'risky_rewrite', 'p': CASE WHEN pen > 0 AND frac > 0.28 THEN -5 WHEN pen > 0 AND frac > 0.18 THEN -2 ELSE 0 END}}, {{'n': 'throws_clause_kept', 'p': CASE WHEN k < 4 THEN 8 ELSE 0 END}}], lambda e: e.p <> 0) AS points FROM g)
SELECT conv_id, turn, CAST(100 + coalesce(list_sum(list_transform(points, lambda e: e.p)), 0) AS DOUBLE) AS score, array_to_string(list_transform(points, lambda e: e.n || '=' || e.p), ';') AS points, k IN (0, 3) AS exact_signature_preservation, k < 4 AS throws_clause_preservation, reuse AS original_identifier_reuse,
  len(ncalls) AS new_helper_call_count, len(ntypes) AS new_type_reference_count, len(nco) AS new_constant_reference_count, len(nid) AS new_identifier_reference_count, drift AS api_signature_drift, pen AS penalty_only_reason_count, combo AS broad_rewrite_combo,
  CAST(CASE WHEN combo THEN 8 ELSE 0 END + CASE WHEN pen >= 3 THEN 14 WHEN pen >= 2 THEN 6 ELSE 0 END AS DOUBLE) AS risk_combo_penalty, CAST(CASE WHEN pen > 0 AND frac > 0.28 THEN 5 WHEN pen > 0 AND frac > 0.18 THEN 2 ELSE 0 END AS DOUBLE) AS change_fraction_risk_penalty, reused AS context_supported_reuse,
  CAST(least(6, 2 * rewarded) AS DOUBLE) AS context_supported_reuse_bonus, plan AS plan_ok, viol AS low_violation_count, viol AS high_violation_count, CAST(dist AS DOUBLE) AS near_bug_region, art AS model_artifact, tail AS markdown_or_explanation_tail, false AS invented_helper_declaration, 0 AS extra_nested_declaration,
  conv_id % 5 = 0 AS plan_fill_selected, round(frac, 4) AS broad_rewrite, frac > 0.5 AS broad_rewrite_severe, CASE WHEN drift THEN 3 ELSE least(2, pen) END AS risk_tier FROM p"""

QUERIES = {
    "java_symbols": (java_symbols, SYMBOLS),
    "allow_lists": (allow_lists, ALLOWED),
    "candidate_validity": (candidate_validity, VALIDITY),
    "validity_by_role": (validity_by_role, COUNTED),
    "semantic_rerank": (semantic_rerank, RERANK),
}
