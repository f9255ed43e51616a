"""Queries of prompt text, feedback, settings, discovery and admission rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import feedback as B
from quarrywork.functions import inference as I
from quarrywork.functions import prompts as P
from quarrywork.functions import text as T
from quarrywork.operators import analytics
from quarrywork.plans.rule_queries import STRATEGY, WITH_FAMILY, _logs
from quarrywork.session import table
from quarrywork.sources import discovery


def prompt_sections(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", P.sections(("Role", F.col("role")), ("Blank", F.lit("  ")), ("Text", F.col("text")), ("Turn", F.col("turn").cast("string"))).alias("prompt"))


def node_reasons(spark, d):
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    return p.select("p_partkey", P.reason(F.col("p_type"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")), words, F.array().cast("array<string>")).alias("reason"))


def marked_lines(spark, d):
    """A line of the text marked by its number, or, where there is none, by what it holds."""
    text = F.concat(F.lit("a b\n"), F.coalesce("text", F.lit("")), F.lit("\nc"))
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", P.mark_line(text, F.col("turn").cast("int"), F.lit(" b")).alias("marked"), P.mark_line(text, F.lit(None).cast("int"), F.lit(" c ")).alias("last"))


MARKED = """WITH t AS (SELECT conv_id, turn, string_split('a b' || chr(10) || coalesce(text, '') || chr(10) || 'c', chr(10)) AS s FROM conversations),
p AS (SELECT *, CASE WHEN turn BETWEEN 1 AND len(s) THEN turn ELSE coalesce(nullif(list_position(list_transform(s, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') = 'b'), true), 0), nullif(list_position(list_transform(s, lambda x: contains(x, 'b')), true), 0)) END AS i,
  coalesce(nullif(list_position(list_transform(s, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') = 'c'), true), 0), nullif(list_position(list_transform(s, lambda x: contains(x, 'c')), true), 0)) AS j FROM t)
SELECT conv_id, turn, array_to_string([s[k] || CASE WHEN k = i THEN '  // <--- BUGGY LINE' ELSE '' END FOR k IN range(1, len(s) + 1)], chr(10)) AS marked,
  array_to_string([s[k] || CASE WHEN k = j THEN '  // <--- BUGGY LINE' ELSE '' END FOR k IN range(1, len(s) + 1)], chr(10)) AS last FROM p"""


def first_failures(spark, d):
    """The text is what a test said, before frames of the virtual machine, of the test library and of the code."""
    frames = "\n at java.base/j.X\n at own.Y.z\n at org.apache.tools.ant.T\n at java.util.List\n at Own.Z"
    log = F.concat(F.lit("x\n--- t.A::b"), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(frames), F.lit("\n--- other::c\nno"))
    f = P.first_failure(log)
    return table(spark, d, "conversations").select("conv_id", "turn", f["test"].alias("test"), f["message"].alias("message"), F.array_join(f["frames"], ",").alias("frames"))


FAILURES = r"""WITH l AS (SELECT conv_id, turn, regexp_split_to_array('--- t.A::b' || turn || chr(10) || coalesce(text, '') || chr(10) || ' at java.base/j.X' || chr(10) || ' at own.Y.z' || chr(10) || ' at org.apache.tools.ant.T' || chr(10) || ' at java.util.List' || chr(10) || ' at Own.Z' || chr(10) || '--- other::c', '\r\n|\r|\n') AS s FROM conversations),
b AS (SELECT conv_id, turn, s[1:list_position(list_transform(s[2:], lambda x: starts_with(x, '--- ')), true)] AS s FROM l),
r AS (SELECT conv_id, turn, s[1][5:] AS test, list_filter(list_transform(s[2:], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS e FROM b),
f AS (SELECT *, list_filter(e, lambda x: starts_with(x, 'at ')) AS a, list_filter(e, lambda x: starts_with(x, 'at ') AND NOT regexp_matches(lower(x), 'junit\.framework|org\.apache\.tools\.ant|jdk\.internal\.reflect|java\.base/|java\.lang\.reflect|sun\.reflect')) AS o FROM r)
SELECT conv_id, turn, test, coalesce(list_filter(e, lambda x: NOT starts_with(x, 'at '))[1], '') AS message, array_to_string(CASE WHEN len(o) > 0 THEN o[1:3] ELSE a[1:3] END, ',') AS frames FROM f"""


def _attempt() -> dict:
    n = F.when(F.col("page_id") % 3 != 0, (F.col("page_id") % 9).cast("int"))
    return {
        "code": F.col("url"), "log": F.col("log"), "failing_count": n, "failing_names": F.when(F.col("page_id") % 2 == 0, F.array("url", F.lit(" "), F.lit("a::b"))), "test_log": F.lit("one  \n\ntwo"),
        "first_test": F.lit("a::b"), "first_message": F.when(F.col("page_id") % 4 == 0, F.lit("wrong")), "first_stack": F.lit("at x\nnone\nat y"), "first_log": F.col("line"), "line": F.lit("return 1;"), "base": F.col("html"),
        "siblings": F.array(*[F.lit(f"int f{k}()") for k in range(7)]), "imports": F.array().cast("array<string>"),
    }


def retry_feedback(spark, d):
    rows = _logs(spark, d).withColumn("family", T.compile_error_family(F.col("log")))
    strategy = T.feedback_strategy(F.col("reason"), F.col("family"))
    told = B.retry_prompt(F.lit("Fix it.\n##correct\n"), B.feedback(strategy, _attempt()), F.col("page_id") % 5)
    hidden, blind = B.feedback(strategy, _attempt(), test_facts=False), B.feedback(strategy, _attempt(), blind=True)
    return rows.select("page_id", F.md5(told.cast("binary")).alias("told_md5"), hidden.alias("hidden"), blind.alias("blind"))


RETRY = WITH_FAMILY + r""", s AS (SELECT *, """ + STRATEGY + r""" AS strategy, regexp_split_to_array(regexp_replace(log, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n') AS e FROM f),
c AS (SELECT *, list_filter(e, lambda x: regexp_matches(lower(x), 'error:|symbol|type|found|required|cannot|expected|exception')) AS u FROM s),
k AS (SELECT *, array_to_string(CASE WHEN len(u) > 0 THEN u[1:5] ELSE e[1:5] END, chr(10)) AS err, chr(10) AS nl, chr(10) || chr(10) AS gap, 'YOUR WRONG CODE:' || chr(10) || coalesce(url, '') AS mine, 'Output the COMPLETE fixed function.' AS fin, 'int f0()' || chr(10) || 'int f1()' || chr(10) || 'int f2()' || chr(10) || 'int f3()' || chr(10) || 'int f4()' AS sib,
  CASE WHEN page_id % 3 <> 0 THEN page_id % 9 END AS n FROM c),
m AS (SELECT *, 'HINT: The original bug is likely on or near this line:' || nl || '  return 1;' || CASE WHEN coalesce(html, '') <> '' THEN gap || 'ORIGINAL BUGGY CODE:' || nl || substr(html, 1, 700) ELSE '' END AS near, 'COMPILE ERROR' AS ce FROM k),
h AS (SELECT *, CASE strategy
  WHEN 'syntax_feedback' THEN ce || ': syntax error.' || nl || err || gap || mine || gap || 'FIX: Check for missing semicolons, unbalanced braces, or incomplete statements.' || nl || fin
  WHEN 'symbol_feedback' THEN ce || ': cannot find symbol.' || nl || err || gap || mine || gap || 'AVAILABLE METHODS in this class:' || nl || sib || gap || 'FIX: Replace the unknown symbol with one from the list above. Do NOT invent methods.' || nl || fin
  WHEN 'type_feedback' THEN ce || ': incompatible types.' || nl || err || gap || mine || gap || 'FIX: Use the correct type or add an explicit cast. Check return types carefully.' || nl || fin
  WHEN 'generic_type_feedback' THEN ce || ': generic/parameterized type mismatch.' || nl || err || gap || mine || gap || 'AVAILABLE METHOD SIGNATURES (with their generic parameters):' || nl || sib || gap || 'FIX:' || nl || '- Check the type parameters `<...>` — the compiler reports a bound/inference violation.' || nl || '- Common patterns: use `<?>` or `<? extends T>` for read-only, `<? super T>` for write-only.' || nl || '- Do NOT erase generics to raw types; keep the parameterization the surrounding code uses.' || nl || '- Match the exact type argument shape shown in AVAILABLE METHOD SIGNATURES above.' || nl || fin
  WHEN 'signature_feedback' THEN ce || ': wrong method arguments.' || nl || err || gap || mine || gap || 'AVAILABLE METHOD SIGNATURES:' || nl || sib || gap || 'FIX: Match the exact parameter types and count shown above.' || nl || fin
  WHEN 'exception_feedback' THEN ce || ': uncaught checked exception.' || nl || err || gap || mine || gap || 'FIX: Add try-catch or add "throws" to the method signature.' || nl || fin
  WHEN 'access_feedback' THEN ce || ': access control violation (private/protected field or method).' || nl || err || gap || mine || gap || 'FIX: Use a public getter/setter or an accessible alternative.' || nl || fin
  WHEN 'import_feedback' THEN ce || ': package or class does not exist.' || nl || err || gap || mine || gap || 'AVAILABLE IMPORTS in this file:' || nl || '(none)' || gap || 'FIX: Use only classes from the imports above. Do NOT reference packages that are not imported.' || nl || fin
  WHEN 'test_feedback' THEN 'Your code compiled but FAILED TESTS — the logic is wrong.' || gap || near || gap || mine || gap || 'FIX: The previous attempt failed tests. Repair the logic.' || nl || 'Start from the ORIGINAL BUGGY CODE, not your previous rewrite.' || nl || 'Make a MINIMAL semantic fix near the buggy line.' || nl || 'Undo unnecessary changes from the wrong code.' || nl || fin
  WHEN 'simplify_feedback' THEN 'Your code caused a TIMEOUT (possible infinite loop).' || gap || mine || gap || 'ORIGINAL BUGGY CODE (for reference):' || nl || substr(coalesce(html, ''), 1, 500) || gap || 'FIX: Make a MINIMAL one-line change to the original code. Do NOT add loops or recursion.' || nl || fin
  ELSE ce || ':' || nl || err || gap || mine || gap || 'FIX: Read the error message above and fix accordingly.' || nl || fin END AS hidden,
  CASE WHEN n <= 3 THEN 'Your code COMPILES and is PARTIALLY correct — only ' || n || ' test(s) fail. Preserve the passing behavior; fix only what fails.' WHEN n IS NOT NULL THEN 'Your code COMPILES but ' || n || ' tests fail. The logic is partially correct — keep the passing behavior and target only the failing cases.' ELSE 'Your code compiled but FAILED TESTS — the logic is wrong.' END
  || gap || CASE WHEN n IS NOT NULL THEN 'FAILING TEST COUNT: ' || n || gap ELSE '' END || CASE WHEN page_id % 2 = 0 THEN 'FAILING TEST NAMES:' || nl || url || nl || 'a::b' ELSE 'FAILING TESTS:' || nl || 'one' || nl || 'two' END || gap || 'FIRST FAILING TEST:' || nl || 'a::b' || gap
  || CASE WHEN page_id % 4 = 0 THEN 'FIRST FAILURE MESSAGE:' || nl || 'wrong' || gap ELSE '' END || 'RELEVANT STACK FRAMES:' || nl || 'at x' || nl || 'at y' || gap || CASE WHEN page_id % 4 <> 0 THEN 'FIRST FAILING TEST DETAIL:' || nl || line || gap ELSE '' END || near || gap || mine || gap
  || 'FIX: Use the failing test information above to repair the logic.' || nl || 'Start from the ORIGINAL BUGGY CODE, not your previous rewrite.' || nl || 'Make a MINIMAL semantic fix near the buggy line.' || nl || 'Use the FIRST FAILURE MESSAGE as the main semantic target.' || nl || 'If only a small number of tests fail, target that behavior and preserve everything else.' || nl || 'Undo unnecessary changes from the wrong code.' || nl || fin AS tests FROM m)
SELECT page_id, md5('Fix it.' || gap || '---FEEDBACK (attempt ' || (page_id % 5) || ')---' || nl || CASE strategy WHEN 'test_feedback' THEN tests ELSE hidden END || gap || '##correct' || nl) AS told_md5, hidden,
  'Your previous attempt was WRONG.' || gap || mine || gap || 'Try a DIFFERENT approach. ' || fin AS blind FROM h"""


def prepared_prompts(spark, d):
    """A prompt with a plan, an edit region, a context and code to renew; every third text has no line to mark."""
    prompt = F.lit("Plan: {{PLAN_JSON}}\nBOUNDED EDIT REGION:\n- Prefer edits at/near lines: ?\n- If you must edit outside, keep within the same function and remain minimal.\nLOCAL CONTEXT:\n```text\nold\n```\nCODE (buggy line is marked with `<--- BUGGY LINE`):\n```java\nold\n```\nEnd {{PLAN_JSON}}")
    base = F.concat(F.lit("int f() {\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), F.lit("\n  return a;\n}"))
    content = F.when(F.col("turn") % 3 != 0, F.lit("return a;")).otherwise(F.lit("no such line, ever"))
    out = B.prepare_prompt(prompt, F.concat(F.lit('{"k": '), F.col("turn").cast("string"), F.lit("}")), base, content)
    return table(spark, d, "conversations").select("conv_id", "turn", out.alias("prompt"))


PREPARED = r"""WITH t AS (SELECT conv_id, turn, chr(10) AS nl, '{"k": ' || turn || '}' AS plan, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g') AS x FROM conversations)
SELECT conv_id, turn, 'Plan: ' || plan || nl || 'BOUNDED EDIT REGION:' || nl || '- Prefer edits at/near lines: ' || CASE WHEN turn % 3 <> 0 THEN '2, 3, 4' ELSE '?' END || nl || '- If you must edit outside, keep within the same function and remain minimal.' || nl || 'LOCAL CONTEXT:' || nl || '```text' || nl
  || CASE WHEN turn % 3 <> 0 THEN '   1:  int f() {' || nl || '   2:  ' || x || nl || '   3:->  return a;' || nl || '   4:  }' ELSE 'old' END || nl || '```' || nl || 'CODE (buggy line is marked with `<--- BUGGY LINE`):' || nl || '```java' || nl
  || CASE WHEN turn % 3 <> 0 THEN 'int f() {' || nl || x || nl || '  return a;  // <--- BUGGY LINE' || nl || '}' ELSE 'old' END || nl || '```' || nl || 'End ' || plan AS prompt FROM t"""


def context_summaries(spark, d):
    """An order's lines as nodes: the list of the first five, of two neighbours, and of their lines."""
    l = table(spark, d, "lineitem")  # noqa: E741
    node = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("line"), F.col("l_linestatus").alias("type"), F.when(F.col("l_partkey") % 4 != 0, (F.col("l_partkey") % 7).cast("int")).alias("distance"), (F.col("l_returnflag") == "R").alias("contains"),
        F.when(F.col("l_linestatus") == "O", F.array("l_returnflag", "l_linestatus")).alias("names"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("check condition"))).alias("hints"), F.concat(F.lit("f("), F.col("l_partkey").cast("string"), F.lit(")")).alias("code"), F.when(F.col("l_linenumber") % 3 == 0, F.lit("ctx ")).alias("context"),
    )
    near = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_partkey").cast("string").alias("id"), F.col("l_linestatus").alias("project"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount").cast("double")).alias("score"), F.col("l_returnflag").alias("file"), F.lit("").alias("line"))
    rows = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.sort_array(F.collect_list(near)).alias("near"))
    lines = P.bound_lines(F.lit(7), F.col("nodes"), F.lit(5), F.lit(40))
    return rows.select("l_orderkey", P.node_summary(F.col("nodes"), F.lit("java")).alias("nodes"), P.neighbour_summary(F.col("near")).alias("neighbours"), F.array_join(F.transform(lines, lambda x: x.cast("string")), ",").alias("lines"))


SUMMARIES = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS i, CAST(l_quantity AS INTEGER) AS line FROM lineitem),
t AS (SELECT l_orderkey, i, i || '. Line ' || line || ' (' || l_linestatus || ', dist: ' || CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_partkey % 7 AS VARCHAR) ELSE 'N/A' END || ')' || CASE WHEN l_returnflag = 'R' THEN chr(10) || '   - Contains buggy line' ELSE '' END
  || CASE WHEN l_linestatus = 'O' THEN chr(10) || '   - Ids: ' || l_returnflag || ', ' || l_linestatus ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || '   - Hints: check condition' ELSE '' END
  || chr(10) || '   - Code:' || chr(10) || CASE WHEN l_linenumber % 3 = 0 THEN '```text' || chr(10) || 'ctx' ELSE '```java' || chr(10) || 'f(' || l_partkey || ')' END || chr(10) || '```' AS node,
  i || '. ' || l_partkey || ' | ' || l_linestatus || ' | score ' || CASE WHEN l_linenumber % 2 = 0 THEN printf('%.3f', CAST(l_discount AS DOUBLE)) ELSE 'N/A' END || chr(10) || '   - file: ' || l_returnflag AS near, CASE WHEN line BETWEEN 1 AND 40 THEN line WHEN line BETWEEN 5 AND 44 THEN line - 4 END AS own FROM n WHERE i <= 5),
u AS (SELECT l_orderkey, own FROM t WHERE own IS NOT NULL UNION SELECT l_orderkey, 7 FROM t)
SELECT l_orderkey, string_agg(node, chr(10) ORDER BY i) AS nodes, string_agg(near, chr(10) ORDER BY i) FILTER (i <= 2) AS neighbours, any_value(o) AS lines
FROM t JOIN (SELECT l_orderkey, string_agg(own, ',' ORDER BY own) AS o FROM u GROUP BY 1) USING (l_orderkey) GROUP BY l_orderkey"""


def run_settings(spark, d):
    s = P.run_settings(F.concat(F.lit("K="), F.col("p_size").cast("string"), F.lit(",beta,gamma, m = a=b,k="), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", s["k"].alias("k"), s["tag"].alias("tag"), s["m"].alias("m"))


def setting_precedence(spark, d):
    p = table(spark, d, "part")
    explicit = F.when(F.col("p_partkey") % 4 == 0, F.lit("cli"))
    row = F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.when(F.col("p_partkey") % 3 == 1, F.lit("row")))
    return p.groupBy(P.setting(explicit, row, F.lit("default")).alias("mode")).agg(F.count("*").alias("n"))


def localized_lines(spark, d):
    p = table(spark, d, "part")
    at = (F.col("p_partkey") % 60).cast("int")
    line = P.local_line(at, F.lit(20), F.col("p_size"))
    plan = P.default_plan(line, F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "single").otherwise("hard"))
    return p.select("p_partkey", line.alias("line"), P.local_line(at, F.lit(20), F.col("p_size"), absolute_first=False).alias("own_line"), F.when(line.isNotNull(), plan["start"]).alias("first_line"), F.when(line.isNotNull(), plan["end"]).alias("last_line"), plan["budget"].alias("budget"))


def bug_profiles(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 4 == 0, "hard").when(F.col("p_partkey") % 4 != 3, "single").alias("mode"), F.element_at(F.array(F.lit("high"), F.lit("med"), F.lit("low")), (F.col("p_size") % 3 + 1).cast("int")).alias("level"))
    both = p.select(P.profile(F.col("mode"), F.col("level")).alias("profile"), P.profile(F.col("mode"), F.col("level"), cost_aware=False).alias("fixed"))
    return both.groupBy("profile", "fixed", P.profile_target(F.col("profile"), 20).alias("target")).agg(F.count("*").alias("n"))


PROFILES = """SELECT CASE WHEN p_partkey % 4 = 0 OR p_size % 3 = 2 THEN 'HARD' WHEN p_size % 3 = 0 THEN 'EASY' ELSE 'MED' END AS profile, CASE WHEN p_partkey % 4 = 0 THEN 'HARD' ELSE 'MED' END AS fixed,
  CASE WHEN p_partkey % 4 = 0 OR p_size % 3 = 2 THEN 20 WHEN p_size % 3 = 0 THEN 12 ELSE 20 END AS target, count(*) AS n FROM part GROUP BY 1, 2, 3"""


def symbol_drift(spark, d):
    p = table(spark, d, "part")
    new = F.array_union(F.split("p_name", " "), F.array("p_type"))
    return p.select("p_partkey", F.array_join(P.unknown_symbols(new, F.array(F.lit("small"), F.lit("red")), F.array(F.lit("ECONOMY"))), ",").alias("unknown"))


def admission_reasons(spark, d):
    docs = table(spark, d, "documents")
    why = P.drop_reason([("empty", F.trim(F.coalesce("text", F.lit(""))) == ""), ("short", F.length("text") < 100), ("marked", F.contains("text", F.lit("#"))), ("long", F.length("text") > 10_000)])
    return docs.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def corpus_fingerprint(spark, d):
    return discovery.fingerprint(table(spark, d, "documents"), "doc_id", "text", "k1=1.6,b=0.7")


_PARTS = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 8 * k}, 8) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for k in range(5))
PRINT = f"WITH r AS (SELECT sha1(doc_id || chr(1) || coalesce(text, '')) AS h FROM documents) SELECT sha1(concat_ws(':', 'k1=1.6,b=0.7', count(*), {_PARTS})) AS fingerprint FROM r"


def _outcomes(spark, d) -> DataFrame:
    """Runs in which a page's log is what came of them."""
    return _logs(spark, d).withColumn("family", T.compile_error_family(F.col("log")))


def compile_details(spark, d):
    ok = F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.col("reason") == "pass")
    x = I.compile_detail(ok, F.col("url"), F.col("log"), F.when(F.col("page_id") % 2 == 0, F.col("family")), lambda c: T.truncate(c, 60))
    return _outcomes(spark, d).select("page_id", x.alias("x")).select("page_id", "x.*", I.normal_outcome(F.when(F.col("page_id") % 5 != 0, F.lit(" pass ")).otherwise("odd")).alias("outcome"))


DETAILS = WITH_FAMILY + """, o AS (SELECT *, coalesce(CASE WHEN page_id % 3 <> 0 THEN reason = 'pass' END, false) AS ok FROM f)
SELECT page_id, ok, CASE WHEN length(url) > 60 THEN substr(url, 1, 46) || '...[truncated]' ELSE coalesce(url, '') END AS stdout, CASE WHEN length(log) > 60 THEN substr(log, 1, 46) || '...[truncated]' ELSE log END AS stderr,
  CASE WHEN page_id % 2 = 0 THEN family WHEN ok THEN '' ELSE 'unknown_compile_fail' END AS family, CASE WHEN page_id % 5 <> 0 THEN 'pass' ELSE 'unknown_error' END AS outcome FROM o"""


def branch_policy(spark, d):
    """Branch and mode of parts by what was asked, what the row has, and the language."""
    k = F.col("p_partkey")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("auto", "java_v2", "python_base", "JAVA_SEMANTIC ")]), (k % 4 + 1).cast("int"))
    row = F.when(k % 3 == 0, F.lit("java_semantic")).when(k % 3 == 1, F.lit("odd"))
    language = F.when(k % 2 == 0, "java").otherwise("python")
    both = table(spark, d, "part").select(k, P.repair_branch(asked, row, language).alias("a"), P.repair_branch(asked, row, language, explicit=True).alias("b"))
    mode = P.edit_mode(F.when(k % 5 == 0, F.lit(" Hard")), F.when(k % 5 == 1, F.lit(False)), F.col("b.effective").isin("java_base", "java_semantic"))
    return both.select("p_partkey", F.col("a.effective").alias("branch"), F.col("a.source").alias("source"), F.col("b.effective").alias("explicit_branch"), F.col("b.source").alias("explicit_source"), mode.alias("mode"))


BRANCH = """WITH p AS (SELECT p_partkey, p_partkey % 2 = 0 AS java, p_partkey % 3 = 0 AS own, ['auto', 'java_v2', 'python_base', 'java_semantic'][CAST(p_partkey % 4 AS INTEGER) + 1] AS asked FROM part),
b AS (SELECT *, CASE WHEN java THEN CASE WHEN own THEN 'java_semantic' WHEN starts_with(asked, 'java') THEN asked ELSE 'java_base' END ELSE 'python_base' END AS branch, CASE WHEN java AND own THEN 'row' ELSE 'auto' END AS source,
  CASE WHEN java THEN CASE WHEN starts_with(asked, 'java') THEN asked WHEN own THEN 'java_semantic' ELSE 'java_base' END ELSE 'python_base' END AS explicit_branch,
  CASE WHEN java THEN CASE WHEN starts_with(asked, 'java') THEN 'cli' WHEN own THEN 'row' ELSE 'auto' END WHEN asked = 'python_base' THEN 'cli' ELSE 'auto' END AS explicit_source FROM p)
SELECT p_partkey, branch, source, explicit_branch, explicit_source, CASE WHEN p_partkey % 5 < 2 THEN 'hard' WHEN explicit_branch IN ('java_base', 'java_semantic') THEN 'single' ELSE 'hard' END AS mode FROM b"""


QUERIES = {
    "branch_policy": (branch_policy, BRANCH),
    "prompt_sections": (prompt_sections, "SELECT conv_id, turn, '## Role' || chr(10) || role || CASE WHEN trim(coalesce(text, '')) <> '' THEN chr(10) || chr(10) || '## Text' || chr(10) || text ELSE '' END || chr(10) || chr(10) || '## Turn' || chr(10) || turn AS prompt FROM conversations"),
    "node_reasons": (node_reasons, "SELECT p_partkey, 'type=' || p_type || CASE WHEN p_partkey % 5 <> 0 THEN '; dist=' || p_size ELSE '' END || '; overlap=' || replace(p_name, ' ', ',') AS reason FROM part"),
    "marked_lines": (marked_lines, MARKED),
    "first_failures": (first_failures, FAILURES),
    "retry_feedback": (retry_feedback, RETRY),
    "prepared_prompts": (prepared_prompts, PREPARED),
    "context_summaries": (context_summaries, SUMMARIES),
    "compile_details": (compile_details, DETAILS),
    "run_settings": (run_settings, "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, 'beta' AS tag, 'a=b' AS m FROM part"),
    "setting_precedence": (setting_precedence, "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'cli' WHEN p_partkey % 3 = 1 THEN 'row' ELSE 'default' END AS mode, count(*) AS n FROM part GROUP BY 1"),
    "localized_lines": (localized_lines, "WITH l AS (SELECT p_partkey, p_size, CAST(p_partkey % 60 AS INTEGER) AS x, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 6 END AS k FROM part), m AS (SELECT *, CASE WHEN x >= 20 AND x < 20 + p_size THEN x - 19 WHEN x >= 1 AND x <= p_size THEN x END AS line, CASE WHEN x >= 1 AND x <= p_size THEN x WHEN x >= 20 AND x < 20 + p_size THEN x - 19 END AS own_line FROM l) SELECT p_partkey, line, own_line, CASE WHEN line IS NOT NULL THEN greatest(1, line - k) END AS first_line, CASE WHEN line IS NOT NULL THEN least(p_size, line + k) END AS last_line, CASE k WHEN 2 THEN 6 ELSE 25 END AS budget FROM m"),
    "bug_profiles": (bug_profiles, PROFILES),
    "symbol_drift": (symbol_drift, "WITH s AS (SELECT p_partkey, list_filter(list_append(string_split(p_name, ' '), p_type), lambda x: x NOT IN ('small', 'red', 'ECONOMY')) AS s FROM part), u AS (SELECT p_partkey, s, unnest(CASE WHEN len(s) > 0 THEN range(1, len(s) + 1) ELSE [0] END) AS i FROM s), f AS (SELECT p_partkey, s[i] AS x, min(i) AS i FROM u GROUP BY ALL) SELECT p_partkey, coalesce(string_agg(x, ',' ORDER BY i), '') AS unknown FROM f GROUP BY p_partkey"),
    "admission_reasons": (admission_reasons, "SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 100 THEN 'short' WHEN contains(text, '#') THEN 'marked' WHEN length(text) > 10000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1"),
    "corpus_fingerprint": (corpus_fingerprint, PRINT),
}
