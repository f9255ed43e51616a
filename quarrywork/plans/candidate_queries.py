"""Queries of candidates: lineitem rows stand for scored candidates of an order, conversations for responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import text as T
from quarrywork.operators import candidates as C
from quarrywork.session import table


def _rows(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        "l_orderkey", F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "R").alias("violates"), (F.col("l_linestatus") == "O").alias("survives"), F.col("l_tax").cast("double").alias("change"),
        F.concat_ws(":", F.lpad("l_linenumber", 2, "0"), F.lpad("l_partkey", 8, "0"), F.lpad("l_suppkey", 8, "0")).alias("signature"), (F.col("l_linenumber") == 1).alias("greedy"), "l_linenumber", "l_partkey", "l_suppkey",
    )


ROWS = """
WITH r AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS score, l_returnflag = 'R' AS violates, l_linestatus = 'O' AS survives, l_tax AS change, l_linenumber = 1 AS greedy, l_linenumber, l_partkey, l_suppkey,
  lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || ':' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS signature FROM lineitem)"""


def plan_refill(spark, d):
    """Signatures that repeat, and empty ones, which are always new."""
    short = F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string")))
    rows = _rows(spark, d).withColumn("signature", short)
    return C.refill(rows, "l_orderkey", 4, "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "violates", "signature", "fill_score", "pick")


REFILL = ROWS + """, s AS (SELECT * REPLACE (CASE WHEN l_partkey % 5 <> 0 THEN 's' || (l_partkey % 3) END AS signature), score - CASE WHEN violates THEN 25 ELSE 0 END AS fill_score FROM r),
k AS (SELECT l_orderkey, signature FROM s WHERE NOT violates AND signature IS NOT NULL GROUP BY ALL),
o AS (SELECT s.*, row_number() OVER (PARTITION BY s.l_orderkey, violates, s.signature ORDER BY fill_score DESC, change, l_linenumber, l_partkey, l_suppkey) AS n, k.signature IS NOT NULL AS known FROM s LEFT JOIN k ON k.l_orderkey = s.l_orderkey AND k.signature = s.signature),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY violates, fill_score DESC, change, coalesce(signature, ''), l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pick FROM o WHERE NOT violates OR signature IS NULL OR (n = 1 AND NOT known))
SELECT l_orderkey, l_linenumber, l_partkey, violates, signature, fill_score, pick FROM p WHERE NOT violates OR pick <= 4"""


def rescue_selection(spark, d):
    """Eligible are even scores; signatures repeat, and empty ones are all different."""
    short = F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("s"), (F.col("l_partkey") % 3).cast("string"))).otherwise("")
    rows = _rows(spark, d).withColumns({"eligible": F.col("score") % 2 == 0, "signature": short, "own": F.concat_ws(":", F.lpad("l_linenumber", 2, "0"), F.lpad("l_partkey", 8, "0"))})
    return C.rescue(rows, "l_orderkey", "own").select("l_orderkey", "own", "signature", "pick")


RESCUED = ROWS + """, n AS (SELECT *, bool_or(survives) OVER (PARTITION BY l_orderkey) AS live, CASE WHEN l_partkey % 5 <> 0 THEN 's' || (l_partkey % 3) ELSE '' END AS sig, left(signature, 11) AS own FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, own) AS k FROM n WHERE NOT live AND score % 2 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, sig ORDER BY k) AS again FROM s WHERE k <= 5),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS INTEGER) AS pick FROM g WHERE sig = '' OR again = 1)
SELECT l_orderkey, own, sig AS signature, pick FROM p WHERE pick <= 3"""


def rescue_supports(spark, d):
    """What stands behind each symbol of a part's name: allowed sources only."""
    words = F.split("p_name", " ")
    sources = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.when(F.length(w) % 2 == 0, F.array(F.lit("types"), F.lit("changed_lines"), F.lit("helper_calls"))).otherwise(F.array(F.lit("instance_fields"))).alias("v"))))
    reason = F.element_at(F.array(*[F.lit(x) for x in ("new_identifier_reference", "new_type_reference", "new_helper_call", "broad_rewrite")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    items = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("unheard_of"))).otherwise(words)
    found = C.rescue_support(reason, items, sources)
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";")
    return table(spark, d, "part").select("p_partkey", shown.alias("support"))


SUPPORTS = """WITH p AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS w FROM part),
s AS (SELECT p_partkey, w, [x || '=' || CASE WHEN length(x) % 2 = 0 THEN 'helper_calls+types' ELSE 'instance_fields' END FOR x IN w] AS e FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 AND p_partkey % 7 <> 0 AND len(w) <= 4 THEN array_to_string(e, ';') END AS support FROM s"""


def run_pooling(spark, d):
    rows = _rows(spark, d).withColumn("code", F.concat(F.lit("x  = "), F.col("score").cast("string")))
    a, b = rows.filter("NOT violates"), rows.filter("violates")
    return C.pool([a, b], "l_orderkey", "code", 3).select("l_orderkey", "code", "run", "pick")


def response_extraction(spark, d):
    """A text as the body of a function behind the marker, or behind nothing, or too short, or blank."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[`#]|\s+", " ")
    body = F.concat(F.lit("int f(int a) {\n  // "), text, F.lit("\n  return a + "), F.col("turn").cast("string"), F.lit("; // longer than thirty\n}"))
    given = F.when(F.col("turn") % 4 == 0, F.concat(text, F.lit("\n##correct\n```java\n"), body, F.lit("\n```\nmore"))).when(F.col("turn") % 4 == 1, F.concat(body, F.lit("\n### Notes\nxyz"))).when(F.col("turn") % 4 == 2, F.lit("##correct\nint a;")).otherwise(F.lit("  "))
    r = C.response_code(given)
    return table(spark, d, "conversations").select("conv_id", "turn", r["code"].alias("code"), r["problem"].alias("problem"))


FORM = r"'int f(int a) {' || chr(10) || '  // ' || regexp_replace(coalesce(text, ''), '[`#]|[ \t\n\x0B\f\r]+', ' ', 'g') || chr(10) || '  return a + ' || turn || '; // longer than thirty' || chr(10) || '}'"


def _candidate() -> tuple:
    """(code, base, own_name): a text in a comment of a function, changed in one of several ways."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9é ]", " ")
    base = F.concat(F.lit("def f(x):  # "), F.substring(text, 1, 20), F.lit("\n    y = x + 1\n    z = y * 2\n    return z"))
    k = F.col("turn") % 7
    code = (
        F.when(k == 0, F.replace(base, F.lit("x + 1"), F.lit("x - 1"))).when(k == 1, F.concat(base, F.lit("  # same")))
        .when(k == 2, F.replace(base, F.lit("x + 1"), F.lit("é + 'é'"))).when(k == 3, F.replace(base, F.lit("x + 1"), F.lit("a<>b")))
        .when(k == 4, F.lit("   ")).when(k == 5, F.replace(base, F.lit("x + 1"), F.concat(F.lit("1 # this is the Corrected version of "), text))).otherwise(F.replace(base, F.lit("x + 1"), text))
    )
    return code, base, F.when(F.col("conv_id") % 5 == 0, "g").when(F.col("conv_id") % 5 == 1, "").otherwise("f")


def candidate_problems(spark, d):
    """What is wrong with a candidate, and how often by role."""
    code, base, own = _candidate()
    rows = table(spark, d, "conversations").withColumn("reason", C.candidate_problem(code, base, F.lit("f"), own))
    return C.drop_counts(rows, "role", "reason")


PROBLEMS = r"""WITH t AS (SELECT role, turn % 7 AS k, conv_id % 5 AS c, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9é ]', ' ', 'g') AS x FROM conversations),
n AS (SELECT *, 'y = ' || CASE k WHEN 2 THEN 'é + ""' WHEN 3 THEN 'a<>b' WHEN 5 THEN '1 # this is the Corrected version of ' || x WHEN 6 THEN x ELSE 'x - 1' END AS new FROM t),
r AS (SELECT role, CASE WHEN k = 4 THEN 'empty_code' WHEN k = 1 THEN 'no_change' WHEN c = 1 THEN 'no_def_or_class' WHEN c = 0 THEN 'name_mismatch'
  WHEN regexp_matches(new, '(?i)this is the corrected version|changed line|replace if|buggy line|rest of the code|rest of the function|rest of the method|todo\b|omitted for brevity|corrected\b|fixed(\s+line)?\b|patched(\s+line)?\b') THEN 'introduced_model_artifact'
  WHEN regexp_matches(new, '[^\x00-\x7F]') THEN 'introduced_non_ascii' WHEN contains(new, '<>') THEN 'introduced_java_incompatible_syntax' END AS reason FROM n)
SELECT role, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL"""


def candidate_scores(spark, d):
    code, base, own = _candidate()
    score = C.heuristic_score(code, base, F.lit("y = x + 1"), F.lit("f"), own, F.col("turn") % 11 != 10, F.lit("z = y * 2"))
    return table(spark, d, "conversations").select("conv_id", "turn", score.alias("score"), C.merged(base, F.lit("y = x + 1\nz = 3\nreturn z")).alias("merged"), C.length_ratio(base, code).alias("length_ratio"), F.md5(T.canonical(code).cast("binary")).alias("code_md5"))


def marked_responses(spark, d):
    """Texts between marks: several, of which the longest counts, or a body that the base's header wraps."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[@`#{}]|\s+", " ")
    given = F.concat(F.lit("@@BEGIN_JAVA_CODE@@ x @@END_JAVA_CODE@@ so\n@@begin_java_code@@\nint f() { // "), text, F.lit("\n}\n@@END_JAVA_CODE@@"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n@@BEGIN_JAVA_BODY@@\n return "), F.col("turn").cast("string"), F.lit(";\n@@END_JAVA_BODY@@"))).otherwise(F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", C.marked_code(given).alias("code"), C.marked_code(given, F.lit(" int g(int a)\n{ return a; }")).alias("wrapped"), C.marked_code(text).alias("unmarked"))


MARKED = r"""WITH t AS (SELECT conv_id, turn, 'int f() { // ' || regexp_replace(coalesce(text, ''), '[@`#{}]|[ \t\n\x0B\f\r]+', ' ', 'g') || chr(10) || '}' AS code FROM conversations)
SELECT conv_id, turn, code, CASE WHEN turn % 2 = 0 THEN 'int g(int a) {' || chr(10) || 'return ' || turn || ';' || chr(10) || '}' ELSE code END AS wrapped, CAST(NULL AS VARCHAR) AS unmarked FROM t"""


def admission_pipeline(spark, d):
    """A conversation's texts as responses to one task: why each is dropped, by the first check it fails."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", " ")
    base = F.lit("int f(int a) {\n  return a;\n}")
    short = F.concat(F.lit("int f(int a) {\n  return a + "), (F.col("turn") % 2).cast("string"), F.lit("; // a comment\n}"))
    response = F.when(F.col("turn") % 5 == 0, F.lit("")).when(F.col("turn") % 5 == 1, short).when(F.col("turn") % 5 == 2, F.concat(F.lit("int g(int a) {\n  return 1; // "), text, F.lit("\n}"))).when(F.col("turn") % 5 == 3, F.concat(F.lit("int f(int a) {\n  return 1; // TODO "), text, F.lit("\n}"))).otherwise(F.concat(F.lit("```java\n"), short, F.lit("\n```")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", response.alias("response"), base.alias("base"), F.lit("f").alias("name"))
    out = C.admit(rows, "conv_id", "turn", plan_ok=F.col("turn") % 3 != 0)
    return out.select("conv_id", "turn", F.coalesce("reason", F.lit("kept")).alias("reason"))


ADMISSION = """WITH r AS (SELECT conv_id, turn, turn % 5 AS k, turn % 2 AS p, row_number() OVER (PARTITION BY conv_id, turn % 5 IN (1, 4), turn % 2 ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN k = 0 THEN 'extraction_failed_empty' WHEN k = 3 THEN 'introduced_model_artifact' WHEN k = 2 THEN 'name_mismatch' WHEN n > 1 THEN 'duplicate' WHEN turn % 3 = 0 THEN 'plan_violation' ELSE 'kept' END AS reason FROM r"""


def declaration_choice(spark, d):
    """Texts with two functions around them, of which one has the name, or with one of another name, which gets the base's header; cleaned of remarks."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", " ")
    two = F.concat(F.lit("Java\n"), F.lit("int g() {\n  return 1;\n}\nint f(int a) {\n  // a "), text, F.lit("\n  // fixed line\n  return a; // corrected here\n}\nthe end"))
    one = F.concat(F.lit("int g() {\n  // a "), text, F.lit(" }\n  return 1;\n}\nthe end"))
    given = C.plain_lines(F.when(F.col("turn") % 2 == 0, two).otherwise(one))
    return table(spark, d, "conversations").select("conv_id", "turn", C.chosen_declaration(given, F.lit("f"), F.lit(" int f(int a)\n{ return a; }")).alias("code"))


CHOSEN = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') AS x FROM conversations), l AS (SELECT *, '  // a ' || x AS line FROM t)
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'int f(int a) {' || chr(10) || CASE WHEN regexp_matches(x, '(?i)corrected\b|fixed\b|patched\b') THEN '' ELSE regexp_replace(line, '\s+$', '') || chr(10) END || '  return a;' || chr(10) || '}'
  ELSE 'int f(int a) {' || chr(10) || CASE WHEN regexp_matches(x, '(?i)corrected\b|fixed\b|patched\b') THEN '' ELSE line || ' }' || chr(10) END || '  return 1;' || chr(10) || '}' END AS code FROM l"""


def dispatched_runs(spark, d):
    """Orders as inputs, their customers' rows as prompts, two runs' settings."""
    inputs = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("code"))
    prompts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(F.lit("")).alias("function_before"))
    runs = spark.createDataFrame([("A", 42), ("B", 43)], "tag string, seed int")
    return C.dispatch(inputs, prompts, "id", runs).select("o_orderkey", "tag", "seed", "base")


DISPATCHED = """SELECT o_orderkey, tag, CAST(seed AS INTEGER) AS seed, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'x' END AS base FROM orders LEFT JOIN customer ON c_custkey = o_custkey, (VALUES ('A', 42), ('B', 43)) r(tag, seed) WHERE coalesce(c_custkey % 4 = 0, false) OR o_orderkey % 3 <> 0"""

QUERIES = {
    "marked_responses": (marked_responses, MARKED),
    "admission_pipeline": (admission_pipeline, ADMISSION),
    "declaration_choice": (declaration_choice, CHOSEN),
    "dispatched_runs": (dispatched_runs, DISPATCHED),
    "plan_refill": (plan_refill, REFILL),
    "rescue_selection": (rescue_selection, RESCUED),
    "rescue_supports": (rescue_supports, SUPPORTS),
    "run_pooling": (run_pooling, ROWS + ", u AS (SELECT *, 'x  = ' || score AS code, CASE WHEN violates THEN 1 ELSE 0 END AS run FROM r), o AS (SELECT l_orderkey, code, run, score, greedy, row_number() OVER (PARTITION BY l_orderkey, code ORDER BY run, greedy DESC) AS n FROM u), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT greedy, coalesce(nullif(score, 0), -1000000000) DESC, run, code) AS pick FROM o WHERE n = 1) SELECT l_orderkey, code, run, pick FROM p WHERE pick <= 3"),
    "response_extraction": (response_extraction, f"SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN {FORM} END AS code, CASE turn % 4 WHEN 2 THEN 'too_short' WHEN 3 THEN 'empty' END AS problem FROM conversations"),
    "candidate_problems": (candidate_problems, PROBLEMS),
    "candidate_scores": (candidate_scores, None),
}
