"""Queries of text rules: pages and conversations stand for logs, part and lineitem for plans and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import edit_plans as P
from quarrywork.functions import text as T
from quarrywork.operators import code as C
from quarrywork.operators import rollups
from quarrywork.session import table

#: Log lines that stand before a page's text, by its id.
SAMPLES = (
    "Foo.java:3: error: cannot find symbol",
    "error: incompatible types: List<String> cannot be converted",
    "error: incompatible types: int cannot be converted to String",
    "error: no suitable method found for add(int)",
    "error: unreported exception IOException; must be caught or declared to be thrown",
    "error: x has private access in Foo",
    "error: package org.foo does not exist",
    "error: ';' expected",
    "BUILD FAILED",
)
OUTCOMES = ("pass", "timeout", "test_fail", "compile_fail", "syntax_fail", "apply_fail")


def _logs(spark, d) -> DataFrame:
    line = F.element_at(F.array(*[F.lit(s) for s in SAMPLES]), (F.col("page_id") % len(SAMPLES) + 1).cast("int"))
    reason = F.element_at(F.array(*[F.lit(s) for s in OUTCOMES]), (F.floor(F.col("page_id") / 9) % len(OUTCOMES) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", "url", "html", line.alias("line"), F.concat(line, F.lit("\n"), F.coalesce("html", F.lit(""))).alias("log"), reason.alias("reason"))


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


LOGS = f"WITH l AS (SELECT page_id, url, {_sql_list(SAMPLES)}[page_id % 9 + 1] AS line, {_sql_list(SAMPLES)}[page_id % 9 + 1] || chr(10) || coalesce(html, '') AS log, html, {_sql_list(OUTCOMES)}[page_id // 9 % 6 + 1] AS reason FROM pages)"


#: Written out, so that the library's own table is tested by it.
FAMILY = """CASE
  WHEN contains(lower(log), 'cannot find symbol') THEN 'cannot_find_symbol'
  WHEN {generics} AND (contains(lower(log), 'inference variable') OR contains(lower(log), 'is not within its bound') OR contains(lower(log), 'is not within bounds of type-variable') OR contains(lower(log), 'does not conform to upper bound')
    OR (contains(lower(log), 'type argument ') AND contains(lower(log), 'is not within bounds')) OR regexp_matches(lower(log), 'incompatible types[:\\s][^\\n]*<[^>\\n]+>')) THEN 'generic_type_mismatch'
  WHEN contains(lower(log), 'no suitable method found') OR contains(lower(log), 'cannot be applied to given types') OR contains(lower(log), 'does not override') THEN 'method_signature'
  WHEN contains(lower(log), 'incompatible types') THEN 'type_mismatch'
  WHEN contains(lower(log), 'must be caught or declared to be thrown') OR contains(lower(log), 'unreported exception') THEN 'checked_exception'
  WHEN contains(lower(log), 'has private access') OR contains(lower(log), 'has protected access') THEN 'access_control'
  WHEN regexp_matches(lower(log), '(package|import)\\s+.+\\s+does not exist') THEN 'package_or_import'
  WHEN contains(lower(log), chr(39) || ';' || chr(39) || ' expected') OR contains(lower(log), chr(39) || '}}' || chr(39) || ' expected') OR contains(lower(log), 'reached end of file while parsing') OR contains(lower(log), 'illegal start of') THEN 'syntax_or_parse'
  ELSE 'other_compile_fail' END"""
STRATEGY = """CASE WHEN reason = 'pass' THEN NULL WHEN reason = 'timeout' THEN 'simplify_feedback' WHEN reason = 'test_fail' THEN 'test_feedback'
  WHEN reason = 'compile_fail' THEN CASE family WHEN 'syntax_or_parse' THEN 'syntax_feedback' WHEN 'cannot_find_symbol' THEN 'symbol_feedback' WHEN 'type_mismatch' THEN 'type_feedback' WHEN 'generic_type_mismatch' THEN 'generic_type_feedback'
    WHEN 'method_signature' THEN 'signature_feedback' WHEN 'checked_exception' THEN 'exception_feedback' WHEN 'access_control' THEN 'access_feedback' WHEN 'package_or_import' THEN 'import_feedback' ELSE 'generic_compile_feedback' END
  WHEN reason = 'syntax_fail' THEN 'syntax_feedback' ELSE 'generic_compile_feedback' END"""
WITH_FAMILY = LOGS + ", f AS (SELECT *, " + FAMILY.format(generics="true") + " AS family FROM l)"


def text_error_classify(spark, d):
    return _logs(spark, d).select("page_id", T.compile_error_family(F.col("log")).alias("family"), T.compile_error_family(F.col("log"), generics=False).alias("live_family"))


def feedback_strategy(spark, d):
    rows = _logs(spark, d).withColumn("family", T.compile_error_family(F.col("log")))
    return rows.select("page_id", T.feedback_strategy(F.col("reason"), F.col("family")).alias("strategy"), T.failure_priority(F.col("reason"), F.col("family")).alias("priority"))


STRATEGY_SQL = WITH_FAMILY + f""" SELECT page_id, {STRATEGY} AS strategy,
  CASE WHEN reason = 'test_fail' THEN 3 WHEN reason = 'compile_fail' AND family IN ('cannot_find_symbol', 'type_mismatch', 'generic_type_mismatch', 'method_signature') THEN 2 WHEN reason IN ('compile_fail', 'syntax_fail') THEN 1 ELSE 0 END AS priority FROM f"""


def stderr_truncate(spark, d):
    logs = _logs(spark, d)
    log, names = F.col("log"), F.split("url", "/")
    return logs.select(
        "page_id", T.compiler_lines(log).alias("compiler"), T.test_detail(log).alias("detail"), T.test_output(log).alias("output"), T.test_names(names, 3).alias("names"),
        T.short_list(F.filter(names, lambda x: x == "")).alias("blanks"), T.truncate(log, 400).alias("short"), T.trim_lines(log, 2).alias("head"),
    )


#: By any line end, without the empty piece after a last one.
EACH = r"list_filter(regexp_split_to_array({0}, '\r\n|\r|\n'), lambda x, i: x <> '' OR i < len(regexp_split_to_array({0}, '\r\n|\r|\n')))"
STDERR_SQL = LOGS + ", s AS (SELECT *, " + EACH.format("log") + r""" AS each, list_filter(list_transform(regexp_split_to_array(log, '\r\n|\r|\n'), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '') AS full_lines,
  regexp_split_to_array(regexp_replace(log, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n') AS stripped FROM l),
t AS (SELECT *, list_filter(stripped, lambda x: regexp_matches(lower(x), 'error:|symbol|type|found|required|cannot|expected|exception')) AS c,
  list_filter(full_lines, lambda x: regexp_matches(lower(x), 'fail|error|exception|assert|expected|actual|caused by|comparisonfailure|at ')) AS k, string_split(url, '/') AS p FROM s)
SELECT page_id, array_to_string(CASE WHEN len(c) > 0 THEN c[1:5] ELSE stripped[1:5] END, chr(10)) AS compiler, array_to_string(CASE WHEN len(k) > 0 THEN k[1:18] ELSE full_lines[1:18] END, chr(10)) AS detail,
  array_to_string(full_lines[1:12], chr(10)) AS output, array_to_string(list_filter(p, lambda x: x <> '')[1:3], chr(10)) AS names, CASE WHEN len(list_filter(p, lambda x: x = '')) > 0 THEN array_to_string(list_filter(p, lambda x: x = '')[1:5], chr(10)) ELSE '(none)' END AS blanks,
  CASE WHEN length(log) > 400 THEN substr(log, 1, 386) || '...[truncated]' ELSE log END AS short, CASE WHEN len(each) > 2 THEN array_to_string(each[1:2], chr(10)) || chr(10) || '... (truncated)' ELSE log END AS head FROM t"""


def failing_names(spark, d):
    log = F.concat(F.lit("--- org.foo.BarTest::test"), F.col("turn").cast("string"), F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("::")), F.lit("\n--- a.B::c\n"))
    found = T.failing_tests(log)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(found).alias("n"), F.array_join(found, ",").alias("names"))


FAILING = r"""WITH l AS (SELECT conv_id, turn, regexp_split_to_array('--- org.foo.BarTest::test' || turn || chr(10) || replace(coalesce(text, ''), ' ', '::') || chr(10) || '--- a.B::c', '\r\n|\r|\n') AS each FROM conversations),
n AS (SELECT conv_id, turn, list_filter(list_transform(each, lambda x: regexp_extract(x, '([A-Za-z0-9_.$]+::[A-Za-z0-9_.$]+)', 1)), lambda x: x <> '') AS f FROM l),
u AS (SELECT conv_id, turn, f, unnest(range(1, len(f) + 1)) AS i FROM n), o AS (SELECT conv_id, turn, f[i] AS x, min(i) AS i FROM u GROUP BY conv_id, turn, f[i])
SELECT conv_id, turn, CAST(count(*) AS INTEGER) AS n, string_agg(x, ',' ORDER BY i) AS names FROM o GROUP BY conv_id, turn"""


def url_extension_dataset(spark, d):
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    label = F.when(F.contains(F.lower("url"), F.lit("blog.")), "blog").when(F.contains(F.lower("url"), F.lit("://m.")), "mobile").otherwise("web")
    return table(spark, d, "pages").select("page_id", T.file_extension(path).alias("extension"), label.alias("dataset"))


def identifier_rules(spark, d):
    ids = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Defects4J:"), "page_id")).otherwise(F.col("page_id").cast("string"))
    public = F.when(ids.rlike("(?i)^(defects4j|bugsinpy):"), ids).otherwise(F.concat(F.lit("bugsinpy:"), ids))
    return table(spark, d, "pages").select("page_id", public.alias("candidate_id"), F.array_join(F.array_distinct(F.array(ids, public, F.col("page_id").cast("string"))), "|").alias("own_ids"))


def lenient_casts(spark, d):
    raw = F.element_at(F.array(F.lit("3.7"), F.lit(""), F.lit(" 42 "), F.col("p_size").cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", raw.try_cast("int").alias("parsed"), F.coalesce(raw.try_cast("int"), F.lit(-1)).alias("or_default"))


def first_nonblank(spark, d):
    a = F.when(F.col("p_partkey") % 2 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.first_nonblank(a, b, F.col("p_name")).alias("value"), T.first_nonblank_name(brand=a, type=b, name=F.col("p_name")).alias("origin"))


def stop_markers(spark, d):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" ## end "), F.col("turn").cast("string"), F.lit(" ``` tail {\"a\": 1} x"))
    name = F.concat(F.lit("run_20260417_18563"), (F.col("turn") % 10).cast("string"), F.lit(".json"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.cut_at_stops(t, ["```", "## end", ". "]).alias("cut"), T.outer_json(t).alias("object"), T.time_tag(name).alias("tag"))


STOPS = r"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') || ' ## end ' || turn || ' ``` tail {"a": 1} x' AS t FROM conversations),
p AS (SELECT *, list_min(list_filter([instr(t, '```'), instr(t, '## end'), instr(t, '. ')], lambda x: x > 0)) AS place FROM t)
SELECT conv_id, turn, CASE WHEN place IS NULL THEN t ELSE substr(t, 1, place - 1) END AS cut, nullif(regexp_extract(t, '(?s)(\{.*\})', 1), '') AS object, '20260417_18563' || (turn % 10) AS tag FROM p"""


def code_hashes(spark, d):
    t = F.concat(F.lit("x = 1  # note "), F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.canonical(t).alias("canon"), T.short_hash(t).alias("short"), T.normalized_hash(t).alias("normalized"))


HASHES = r"""WITH t AS (SELECT conv_id, turn, 'x = 1  # note ' || coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(t, '#[^\n]*', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS canon, left(sha1(t), 12) AS short, sha1(trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS normalized FROM t"""


def line_lookup(spark, d):
    """A text's line, looked for whole, by a comment that differs, or by a part of it."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n  return a; // done\nlast = "), F.col("turn").cast("string"))
    goal = F.when(F.col("turn") % 4 == 0, F.element_at(T.lines(text), 1)).when(F.col("turn") % 4 == 1, F.lit("return a; // other")).when(F.col("turn") % 4 == 2, F.lit("last =")).otherwise(F.lit("nowhere at all"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.alias("t"), T.let(T.find_line(text, goal), lambda at: F.struct(at.alias("line"))).alias("at"))
    line = F.col("at.line")
    return rows.select("conv_id", "turn", line.alias("line"), T.numbered_context(F.col("t"), line, 1).alias("context"), F.when(line.isNotNull(), T.local_context(F.col("t"), line, 1)).alias("near"))


LOOKUP = r"""WITH t AS (SELECT conv_id, turn, regexp_split_to_array(coalesce(text, '') || chr(10) || '  return a; // done' || chr(10) || 'last = ' || turn, '\r\n|\r|\n') AS s FROM conversations),
g AS (SELECT *, regexp_replace(CASE turn % 4 WHEN 0 THEN s[1] WHEN 1 THEN 'return a; // other' WHEN 2 THEN 'last =' ELSE 'nowhere at all' END, '^\s+|\s+$', '', 'g') AS goal FROM t),
b AS (SELECT *, regexp_replace(goal, '\s*//.*$', '') AS short, list_transform(s, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS e, list_transform(s, lambda x: regexp_replace(regexp_replace(x, '\s*//.*$', ''), '^\s+|\s+$', '', 'g')) AS bare FROM g),
l AS (SELECT *, CAST(CASE WHEN goal <> '' THEN coalesce(nullif(list_position(e, goal), 0), nullif(list_position(bare, short), 0), CASE WHEN short <> '' THEN nullif(list_position(list_transform(bare, lambda x: contains(x, short)), true), 0) END) END AS INTEGER) AS line FROM b),
n AS (SELECT *, CASE WHEN line IS NULL THEN [] ELSE range(greatest(1, line - 1), least(len(s), line + 1) + 1) END AS shown FROM l)
SELECT conv_id, turn, line, array_to_string(list_transform(shown, lambda i: lpad(CAST(i AS VARCHAR), 4, ' ') || ':' || CASE WHEN i = line THEN '-> ' ELSE '   ' END || s[i]), chr(10)) AS context,
  CASE WHEN line IS NOT NULL THEN CASE WHEN line > 2 THEN '... (truncated)' || chr(10) ELSE '' END || array_to_string(list_transform(shown, lambda i: lpad(CAST(i AS VARCHAR), 4, ' ') || ':' || CASE WHEN i = line THEN '->' ELSE '  ' END || s[i]), chr(10)) || CASE WHEN line + 1 < len(s) THEN chr(10) || '... (truncated)' ELSE '' END END AS near FROM n"""


def _edits(spark, d) -> DataFrame:
    """Lines of an order as edits: quantity is the first line, the line number the length less one."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("end"))


def range_overlap_check(spark, d):
    goals = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("ps"), (F.col("p_size") + 5).alias("pe"))
    both = _edits(spark, d).join(goals, "l_partkey")
    near = P.overlaps(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"))
    loose = P.overlaps(F.col("start"), F.col("end"), F.col("ps"), F.col("pe"), 2)
    inside = P.contains(F.col("ps"), F.col("pe"), F.col("start"), F.col("end"))
    return both.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(near).alias("overlap_n"), F.count_if(loose).alias("slack_n"), F.count_if(inside).alias("inside_n"))


RANGES = "WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) + l_linenumber AS t FROM lineitem)"


def nearest_start(spark, d):
    e = _edits(spark, d)
    gap = F.abs(F.col("start") - 20)
    return e.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct(gap.alias("gap"), F.col("start"), F.col("l_linenumber"), F.col("l_partkey"))).alias("nearest"))


def _plan(spark, d) -> DataFrame:
    """A plan for each part: two targets, a budget and types, whether the edit is single and the language strict."""
    k = F.col("p_partkey")
    target = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    types = F.element_at(F.array(F.array().cast("array<string>"), F.array(F.lit("replace")), F.array(F.lit("DELETE"), F.lit("REPLACE")), F.array(F.lit(" insert"))), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select(
        "p_partkey", F.array(target(F.col("p_size") - 3, F.col("p_size") + k % 8), target(k % 40, F.col("p_size"))).alias("targets"), (k % 14 - 2).cast("int").alias("budget"), types.alias("types"),
        (k % 2 == 0).alias("single"), (k % 3 == 0).alias("strict"), (10 + k % 40).cast("int").alias("n"),
    )


def _processed(p: DataFrame) -> DataFrame:
    return p.withColumn("x", P.postprocess_plan(F.col("targets"), F.col("budget"), F.col("types"), F.col("single"), F.col("strict"), F.col("n")))


def plan_clamp_widen(spark, d):
    show = F.array_join(F.transform(F.col("x.targets"), lambda t: F.concat(t["start"].cast("string"), F.lit("-"), t["end"].cast("string"))), ",")
    return _processed(_plan(spark, d)).select("p_partkey", show.alias("targets"), F.col("x.budget").alias("budget"), F.array_join("x.allowed", ",").alias("allowed"), F.array_join("x.notes", ",").alias("notes"))


PLANS = """WITH p AS (SELECT p_partkey, [p_size - 3, p_partkey % 40] AS a, [p_size + p_partkey % 8, p_size] AS b, p_partkey % 14 - 2 AS budget, p_partkey % 2 = 0 AS single, p_partkey % 3 = 0 AS strict, 10 + p_partkey % 40 AS n,
  p_partkey % 4 = 3 AS has_insert, p_partkey % 4 = 2 AS has_delete FROM part),
c AS (SELECT *, [greatest(1, least(CASE WHEN a[i] = 0 THEN 1 ELSE a[i] END, n)) FOR i IN [1, 2]] AS f, [greatest(1, least(CASE WHEN b[i] = 0 THEN 1 ELSE b[i] END, n)) FOR i IN [1, 2]] AS l FROM p),
o AS (SELECT *, [least(f[i], l[i]) FOR i IN [1, 2]] AS s, [greatest(f[i], l[i]) FOR i IN [1, 2]] AS e FROM c),
w AS (SELECT *, (e[1] - s[1] + 1 + e[2] - s[2] + 1) / 2 AS mean, CASE WHEN strict THEN 1 ELSE 2 END AS k, CASE WHEN single THEN CASE WHEN strict THEN 4 ELSE 6 END ELSE CASE WHEN strict THEN 6 ELSE 12 END END AS least_budget, greatest(1, CASE WHEN budget = 0 THEN 1 ELSE budget END) AS asked FROM o),
g AS (SELECT *, single AND mean < CASE WHEN strict THEN 4 ELSE 7 END AS narrow, [greatest(0, 15 - (e[i] - s[i] + 1)) FOR i IN [1, 2]] AS need FROM w),
r AS (SELECT *, CASE WHEN narrow THEN [greatest(1, s[i] - k) FOR i IN [1, 2]] WHEN NOT single AND NOT strict THEN [greatest(1, s[i] - need[i] // 2) FOR i IN [1, 2]] ELSE s END AS s2,
  CASE WHEN narrow THEN [least(n, e[i] + k) FOR i IN [1, 2]] WHEN NOT single AND NOT strict THEN [least(n, e[i] + need[i] - need[i] // 2) FOR i IN [1, 2]] ELSE e END AS e2 FROM g),
q AS (SELECT p_partkey, s2[1] || '-' || e2[1] || ',' || s2[2] || '-' || e2[2] AS targets, CAST(greatest(asked, least_budget) AS INTEGER) AS budget, 'REPLACE,INSERT' || CASE WHEN has_delete OR NOT single THEN ',DELETE' ELSE '' END AS allowed,
  concat_ws(',', CASE WHEN budget < 0 THEN 'raised_changed_lines_max_to_1' END, CASE WHEN NOT has_insert THEN 'added_INSERT' END, CASE WHEN NOT single AND NOT has_delete THEN 'added_DELETE' END,
    CASE WHEN asked < least_budget THEN 'raised_changed_lines_max_to_' || least_budget END, CASE WHEN narrow THEN 'widened_target_by_' || k END, CASE WHEN NOT single AND NOT strict AND (s2 <> s OR e2 <> e) THEN 'widened_target_to_min_span_15' END) AS notes FROM r)"""


def plan_note_counts(spark, d):
    """How often each note of the post-processing occurs."""
    return rollups.list_counts(_processed(_plan(spark, d)).select(F.col("x.notes").alias("notes")), "notes").withColumnRenamed("value", "note")


def plan_validate(spark, d):
    p = _plan(spark, d)
    targets = F.when(F.col("p_partkey") % 11 == 0, F.array().cast(P.RANGES)).otherwise(F.col("targets"))
    allowed = F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("RENAME"))).otherwise(F.col("types"))
    return p.select("p_partkey", P.plan_problem(targets, F.col("budget"), allowed).alias("problem"))


VALID = """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'no_targets' WHEN p_size - 3 < 1 OR p_partkey % 40 < 1 OR p_size < p_partkey % 40 THEN 'bad_range' WHEN p_partkey % 14 - 2 < 1 THEN 'bad_budget'
  WHEN p_partkey % 7 = 0 THEN 'bad_type' WHEN p_partkey % 4 = 0 THEN 'no_types' END AS problem FROM part"""


def plan_violations(spark, d):
    """An order's lines as edits under the plan of one of its parts."""
    op = F.when(F.col("l_linenumber") % 3 == 0, "INSERT").otherwise("REPLACE")
    edit = F.struct("l_linenumber", "start", "end", op.alias("op"), (F.col("l_linenumber") % 4).alias("new_lines"))
    e = _edits(spark, d).groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"), F.sort_array(F.collect_list(edit)).alias("e"))
    goals = table(spark, d, "part").select("p_partkey", F.array(F.struct(F.col("p_size").alias("start"), (F.col("p_size") + 5).alias("end"))).alias("targets"))
    allowed = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("REPLACE"), F.lit("INSERT"))).otherwise(F.array(F.lit("REPLACE")))
    both = e.join(goals, "p_partkey").withColumn("allowed", allowed)
    found = lambda **how: F.array_join(P.plan_violations(F.col("targets"), F.lit(12), F.col("allowed"), F.col("e"), F.lit(45), **how), ",")
    return both.select("l_orderkey", found().alias("exact"), found(lenient=True, contain=True).alias("lenient"))


VIOLATIONS = """
WITH e AS (SELECT l_orderkey, l_linenumber AS i, l_partkey, least(45, CAST(l_quantity AS INTEGER)) AS a, CAST(l_quantity AS INTEGER) AS s, greatest(least(45, CAST(l_quantity AS INTEGER)), least(45, CAST(l_quantity AS INTEGER) + l_linenumber)) AS b,
  CASE WHEN l_linenumber % 3 = 0 THEN 'INSERT' ELSE 'REPLACE' END AS op, greatest(1, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber % 4 ELSE l_linenumber + 1 END) AS n, min(l_partkey) OVER (PARTITION BY l_orderkey) AS k FROM lineitem),
m AS (SELECT e.*, p_size AS f, greatest(1, p_size - 2) AS f2, greatest(1, least(45, p_size + 7)) AS l2, greatest(1, least(45, p_size + 5)) AS l1, k % 2 = 0 AS inserts FROM e JOIN part ON p_partkey = k),
v AS (SELECT *, CASE WHEN op = 'INSERT' AND NOT inserts THEN 'edit_type_not_allowed:INSERT' END AS t,
  CASE WHEN op = 'INSERT' THEN CASE WHEN NOT (a BETWEEN f AND l1 OR greatest(1, a - 1) BETWEEN f AND l1) THEN 'out_of_target:INSERT@' || s END WHEN NOT (b >= f AND a <= l1) THEN 'out_of_target:REPLACE@' || a || '-' || b END AS exact_out,
  CASE WHEN op = 'INSERT' THEN CASE WHEN NOT (a BETWEEN f2 AND l2 OR greatest(1, a - 1) BETWEEN f2 AND l2) THEN 'out_of_target:INSERT@' || s END WHEN NOT (a >= f2 AND b <= l2) THEN 'out_of_target:REPLACE@' || a || '-' || b END AS lenient_out,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY i, s, b) AS r FROM m),
u AS (SELECT l_orderkey, r * 2 AS place, t AS exact, t AS lenient FROM v UNION ALL SELECT l_orderkey, r * 2 + 1, exact_out, lenient_out FROM v
  UNION ALL SELECT l_orderkey, 1000, CASE WHEN sum(n) > 12 THEN 'changed_lines_max_exceeded:' || sum(n) || '>12' END, CASE WHEN sum(n) > 15 THEN 'changed_lines_max_exceeded:' || sum(n) || '>15' END FROM v GROUP BY l_orderkey),
a AS (SELECT l_orderkey, exact AS x, min(place) AS place FROM u WHERE exact IS NOT NULL GROUP BY ALL), b AS (SELECT l_orderkey, lenient AS x, min(place) AS place FROM u WHERE lenient IS NOT NULL GROUP BY ALL),
sa AS (SELECT l_orderkey, string_agg(x, ',' ORDER BY place) AS x FROM a GROUP BY 1), sb AS (SELECT l_orderkey, string_agg(x, ',' ORDER BY place) AS x FROM b GROUP BY 1)
SELECT o.l_orderkey, coalesce(sa.x, '') AS exact, coalesce(sb.x, '') AS lenient FROM (SELECT DISTINCT l_orderkey FROM v) o LEFT JOIN sa USING (l_orderkey) LEFT JOIN sb USING (l_orderkey)"""


def edit_volume(spark, d):
    op = F.when(F.col("l_linenumber") % 3 == 0, "INSERT").otherwise("REPLACE")
    e = _edits(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(op.alias("op"), "start", "end", (F.col("l_linenumber") % 4).alias("new_lines"))).alias("e"))
    return e.select("l_orderkey", P.changed_lines(F.col("e")).cast("bigint").alias("changed"), F.round(P.mean_distance(F.col("e"), F.lit(20)), 6).alias("mean_gap"))


def import_relevance_contains(spark, d):
    names = table(spark, d, "part").select(F.substring_index("p_name", " ", 1).alias("w")).distinct()
    one = names.agg(F.sort_array(F.collect_set("w")).alias("words"))  # a few adjectives
    docs = table(spark, d, "documents").join(F.broadcast(one), how="cross")
    found = F.filter("words", lambda w: F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower(w)))
    return docs.select("doc_id", F.array_join(found, ",").alias("found"))


def java_import_rules(spark, d):
    """Imports before a text, those whose names the text has, and siblings that it calls."""
    text = F.coalesce("text", F.lit(""))
    found = C.java_imports(F.concat(F.lit("import java.util.List;\nimport static a.b.C.the;\nimport x.y.*;\nclass X { List<String> f; }\n"), text))
    parts = C.sibling_parts(F.array(F.lit("int the(int a)"), F.lit("if (x)"), F.lit("void que (T x)"), F.lit("return(y)"), F.lit("no brackets")), text)
    joined = lambda c: F.array_join(c, ",")
    return table(spark, d, "conversations").select("conv_id", "turn", joined(found).alias("imports"), joined(C.relevant_imports(found, text)).alias("used"), joined(parts["called"]).alias("called"), joined(parts["others"]).alias("others"))


IMPORTS = """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations) SELECT conv_id, turn, 'java.util.List,static a.b.C.the,x.y.*' AS imports, concat_ws(',', CASE WHEN contains(x, 'List') THEN 'java.util.List' END,
  CASE WHEN contains(x, 'the') OR contains(x, 'static') THEN 'static a.b.C.the' END) AS used, concat_ws(',', CASE WHEN contains(x, 'the') THEN 'int the(int a)' END, CASE WHEN contains(x, 'que') THEN 'void que (T x)' END) AS called,
  concat_ws(',', CASE WHEN NOT contains(x, 'the') THEN 'int the(int a)' END, CASE WHEN NOT contains(x, 'que') THEN 'void que (T x)' END, 'no brackets') AS others FROM t"""


def block_spans(spark, d):
    """Where a line stands in a text behind a few others, nearest to the turn."""
    body = F.concat(F.array(F.lit("a"), F.lit("  end"), F.lit("c"), F.lit("end ")), T.lines(F.concat(F.coalesce("text", F.lit("")), F.lit("\nend"))))
    span = C.block_span(body, F.array(F.lit("end")), F.col("turn").cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", span["start"].alias("first_line"), span["end"].alias("last_line"))


SPANS = r"""WITH o AS (SELECT conv_id, turn, list_concat(['a', '  end', 'c', 'end '], regexp_split_to_array(coalesce(text, '') || chr(10) || 'end', '\r\n|\r|\n')) AS s FROM conversations),
h AS (SELECT conv_id, turn, unnest(list_filter(range(1, len(s) + 1), lambda i: trim(s[i]) = 'end')) AS i FROM o)
SELECT conv_id, turn, CAST(arg_min(i, abs(i - turn) * 100000 + i) AS INTEGER) AS first_line, CAST(arg_min(i, abs(i - turn) * 100000 + i) AS INTEGER) AS last_line FROM h GROUP BY conv_id, turn"""


def pretty_labels(spark, d):
    x = F.concat("role", F.lit("_turn"))
    return table(spark, d, "conversations").groupBy(T.label(x, {"user_turn": "Asked"}).alias("label")).agg(F.count("*").alias("n"))


QUERIES = {
    "text_error_classify": (text_error_classify, LOGS + " SELECT page_id, " + FAMILY.format(generics="true") + " AS family, " + FAMILY.format(generics="false") + " AS live_family FROM l"),
    "feedback_strategy": (feedback_strategy, STRATEGY_SQL),
    "stderr_truncate": (stderr_truncate, STDERR_SQL),
    "failing_names": (failing_names, FAILING),
    "url_extension_dataset": (url_extension_dataset, r"SELECT page_id, lower(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1), '^.+(\.[^.]+)$', 1)) AS extension, CASE WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), '://m.') THEN 'mobile' ELSE 'web' END AS dataset FROM pages"),
    "identifier_rules": (identifier_rules, "WITH i AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Defects4J:' || page_id ELSE CAST(page_id AS VARCHAR) END AS id FROM pages), c AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN id ELSE 'bugsinpy:' || id END AS candidate_id FROM i) SELECT page_id, candidate_id, CASE WHEN page_id % 3 = 0 THEN id || '|' || page_id ELSE id || '|' || candidate_id END AS own_ids FROM c"),
    "lenient_casts": (lenient_casts, "WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 42 WHEN 3 THEN p_size END AS parsed FROM part) SELECT *, coalesce(parsed, -1) AS or_default FROM r"),
    "first_nonblank": (first_nonblank, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_brand WHEN p_partkey % 3 <> 0 THEN p_type ELSE p_name END AS value, CASE WHEN p_partkey % 2 = 1 THEN 'brand' WHEN p_partkey % 3 <> 0 THEN 'type' ELSE 'name' END AS origin FROM part"),
    "stop_markers": (stop_markers, STOPS),
    "code_hashes": (code_hashes, HASHES),
    "line_lookup": (line_lookup, LOOKUP),
    "range_overlap_check": (range_overlap_check, RANGES + " SELECT l_orderkey, count(*) AS n, count(*) FILTER (s <= p_size + 5 AND t >= p_size) AS overlap_n, count(*) FILTER (s <= p_size + 7 AND t >= p_size - 2) AS slack_n, count(*) FILTER (s >= p_size AND t <= p_size + 5) AS inside_n FROM e JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey"),
    "nearest_start": (nearest_start, RANGES + ", r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(s - 20), s, l_linenumber, l_partkey) AS k FROM e) SELECT l_orderkey, l_linenumber AS nearest FROM r WHERE k = 1"),
    "plan_clamp_widen": (plan_clamp_widen, PLANS + " SELECT * FROM q"),
    "plan_validate": (plan_validate, VALID),
    "plan_note_counts": (plan_note_counts, PLANS + " SELECT note, count(*) AS n FROM (SELECT unnest(string_split(notes, ',')) AS note FROM q) WHERE note <> '' GROUP BY note"),
    "plan_violations": (plan_violations, VIOLATIONS),
    "edit_volume": (edit_volume, RANGES + " SELECT l_orderkey, CAST(sum(greatest(1, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber % 4 ELSE t - s + 1 END)) AS BIGINT) AS changed, round(avg(abs((s + t) / 2 - 20)), 6) AS mean_gap FROM e GROUP BY l_orderkey"),
    "import_relevance_contains": (import_relevance_contains, "WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part) SELECT doc_id, coalesce(string_agg(w, ',' ORDER BY w) FILTER (contains(lower(coalesce(text, '')), lower(w))), '') AS found FROM documents, n GROUP BY doc_id"),
    "java_import_rules": (java_import_rules, IMPORTS),
    "block_spans": (block_spans, SPANS),
    "pretty_labels": (pretty_labels, "SELECT CASE role WHEN 'user' THEN 'Asked' ELSE upper(role[1]) || role[2:] || ' Turn' END AS label, count(*) AS n FROM conversations GROUP BY 1"),
}
