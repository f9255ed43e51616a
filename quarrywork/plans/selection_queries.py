"""Queries of candidate selection, diffs, code structure and the iterative loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.operators import code as C
from quarrywork.operators import diffs, repair_loop, selection
from quarrywork.plans.analytics_queries import RUNS, runs
from quarrywork.session import table
from quarrywork.sources.work_folders import work_folder


def rank_nodes_topk(spark, d):
    """An order's lines as nodes: strong ones first, then the rest, each by score; smaller is better."""
    l = table(spark, d, "lineitem")  # noqa: E741
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Call", "Assign", "Return", "Function", "Lambda")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    gap = F.when(F.col("l_suppkey") % 5 != 0, F.abs(F.col("l_quantity").cast("int") - 20))
    holds, match, overlap = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_linenumber") % 4
    hints = F.when(F.col("l_partkey") % 5 == 0, F.array(F.lit("check arguments/return")))
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", selection.strong_hint(gap, overlap, holds, match, hints).alias("strong"), selection.node_score(kind, gap, overlap, holds, match).alias("score"))
    return selection.effective_nodes(rows, "l_orderkey", 5, "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "strong", "score", "place")


def ranking_tuple_best(spark, d):
    r = runs(spark, d).withColumn("priority", F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 1).otherwise(0))
    best = selection.best_of(r, "user_id", selection.ranking(F.col("priority"), F.col("k"), F.lit(None).cast("double")), "event_id")
    return best.select("user_id", "event_id", "priority", "k")


def topk_memory(spark, d):
    r = runs(spark, d).withColumn("code", F.concat("event_type", F.lit(":"), (F.col("k") % 10).cast("string")))
    out = selection.memory(r, "user_id", "code", selection.ranking(F.lit(1), F.col("k"), F.lit(None).cast("double")), "event_id", 3)
    return out.select("user_id", "event_id", "code", "k", "memory_rank")


def _scored(spark, d) -> DataFrame:
    """An order's lines as candidates without tiers, so that their order is by score, change and signature."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(
        "l_orderkey", F.col("l_quantity").cast("double").alias("score"), F.lit(None).cast("double").alias("tier"), F.col("l_tax").cast("double").alias("change"), F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("signature"),
        (F.col("l_returnflag") == "R").alias("greedy"), F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 4).cast("string")).alias("source"),
    )


SCORED = """WITH s AS (SELECT l_orderkey, l_quantity AS score, l_tax AS change, l_linenumber || ':' || l_partkey || ':' || l_suppkey AS signature, l_returnflag = 'R' AS greedy, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 4 AS VARCHAR) ELSE 'NA' END AS source FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, change, signature) AS r FROM s)"""


def coverage_topk(spark, d):
    """The best greedy candidate, the best of each source, then the rest."""
    return selection.coverage(_scored(spark, d), "l_orderkey", 4)


COVERAGE = SCORED + """, g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, greedy ORDER BY r) AS gr, row_number() OVER (PARTITION BY l_orderkey, greedy, source ORDER BY r) AS sr FROM o),
c AS (SELECT *, CASE WHEN greedy THEN 0 WHEN sr = 1 THEN 1 ELSE 2 END AS class FROM g WHERE NOT greedy OR gr = 1),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY class, r) AS INTEGER) AS pick FROM c) SELECT l_orderkey, signature, pick FROM p WHERE pick <= 4"""


def greedy_pin(spark, d):
    order = (F.desc("score"), F.col("change"), F.col("signature"))
    return selection.pinned_order(_scored(spark, d), "l_orderkey", "greedy", *order).select("l_orderkey", "signature", "greedy", "place")


PINNED = SCORED + """, g AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, greedy ORDER BY r) AS gr FROM o) SELECT l_orderkey, signature, greedy, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY NOT greedy, r) AS INTEGER) AS place FROM g WHERE NOT greedy OR gr = 1"""


def merge_rerank(spark, d):
    """Greedy candidates first, then by score; a score of 0 sorts last."""
    l = table(spark, d, "lineitem").withColumn("score", F.round(F.col("l_discount") * 100).cast("int"))
    w = W.partitionBy("l_orderkey").orderBy(F.col("l_returnflag") != "R", F.coalesce(F.nullif("score", F.lit(0)), F.lit(-1_000_000_000)).desc(), "l_linenumber", "l_partkey", "l_suppkey")
    return l.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("l_orderkey", "l_linenumber", "score", "place")


def retry_gate(spark, d):
    r = runs(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("dups"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return r.withColumn("again", selection.needs_retry(F.col("n") - F.col("dups") - F.col("failed"), F.lit(12), F.col("dups"), F.col("n"), F.col("failed")))


def early_stop(spark, d):
    """Rows up to a user's first pass."""
    first = F.min(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(W.partitionBy("user_id"))
    r = runs(spark, d).withColumn("first", first)
    return r.filter(F.col("first").isNull() | (F.col("event_id") <= F.col("first"))).select("user_id", "event_id")


def candidate_priority(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    rows = l.select(
        "l_orderkey", F.col("l_quantity").alias("score"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("double")).alias("tier"),
        F.col("l_tax").alias("change"), F.sha1(F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").cast("binary")).alias("signature"),
    )
    return selection.priority_order(rows, "l_orderkey")


def _turns(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).filter(F.col("before").isNotNull())


def line_diff_stats(spark, d):
    t = _turns(spark, d).withColumn("e", diffs.edits("before", "text"))
    return t.select("conv_id", "turn", F.size("e").alias("n_edits"), F.round(diffs.change_fraction("before", "text"), 6).alias("fraction"), diffs.patch_signature("before", "text").alias("signature"))


def similarity_ratio(spark, d):
    """The whole texts' ratio; extracted: whether a failure message of the two gives both back."""
    message = F.concat(F.lit("expected:<"), F.col("before"), F.lit("> but was:<"), F.col("text"), F.lit(">"))
    expected, actual = diffs.expected_actual(message)
    extracted = F.coalesce((expected == F.col("before")) & (actual == F.col("text")), F.lit(False))
    return _turns(spark, d).select("conv_id", "turn", F.round(diffs.similarity("before", "text"), 6).alias("ratio"), extracted.alias("extracted"))


def python_structure(spark, d):
    """A function around each text: its nodes with their flags, its imports, and whether it parses."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\"\\\n\r]", " ")
    code = F.concat(F.lit('import os, re as r\ndef f(x):\n    if x:\n        y = "'), text, F.lit('"\n        return '), F.col("turn").cast("string"), F.when(F.col("turn") % 3 == 2, F.lit(" +")).otherwise(F.lit("")))
    n = C.nodes_at(code, F.lit(5), F.lit("return"))
    show = F.array_join(F.transform(n, lambda x: F.concat(x["type"], F.lit("@"), F.coalesce(x["line"].cast("string"), F.lit("")), F.when(x["contains_line"], "*").otherwise(""), F.when(x["matches_text"], "!").otherwise(""))), " ")
    return table(spark, d, "conversations").select("conv_id", "turn", show.alias("nodes"), F.array_join(C.imports(code), ",").alias("imports"))


STRUCTURE = """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'ParseError@5' ELSE 'Function@2*!' || ' If@3*!' || ' Assign@4 Return@5*!' END AS nodes, CASE WHEN turn % 3 = 2 THEN 'import os, re as r' ELSE 'import os,import re as r' END AS imports FROM conversations"""


def python_context(spark, d):
    """A class around each text: its imports, fields and the other methods."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 ]", " ")
    code = F.concat(F.lit('from a import b as c, d\nclass K:\n    limit: int = 3\n    name = "'), text, F.lit('"\n    def __init__(self, x, *rest, y=1, **more):\n        self.x = x\n    async def g(self):\n        pass\n    def h'), F.col("turn").cast("string"), F.lit("(self):\n        pass\ndef top():\n    pass\n"))
    x = C.file_context(code, F.lit("K"), F.lit("g"))
    return table(spark, d, "conversations").select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", *[F.array_join(f"x.{c}", ";").alias(c) for c in ("imports", "fields", "siblings")])


def java_blocks(spark, d):
    """Each text inside of a string and a comment, whose braces don't count; moved blocks."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\"\\\n\r*/]", " ")
    code = F.concat(F.lit('int f() { String s = "} '), text, F.lit('"; /* { '), text, F.lit(" */ return 1; } trailing"))
    block = F.concat(F.lit("  void f() {\n        "), text, F.lit("\n    }"))
    return table(spark, d, "conversations").select("conv_id", "turn", C.balanced_block(C.fenced_code(F.concat(F.lit("```java\n"), code, F.lit("\n```")))).alias("block"), C.adjust_indent(block, F.col("turn") % 3 * 4).alias("moved"))


JAVA_BLOCKS = r"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '["\\\n\r*/]', ' ', 'g') AS x FROM conversations)
SELECT conv_id, turn, 'int f() { String s = "} ' || x || '"; /* { ' || x || ' */ return 1; }' AS block, CASE turn % 3 WHEN 1 THEN '    void f() {' || chr(10) || '        ' || x || chr(10) || '    }'
  WHEN 2 THEN '        void f() {' || chr(10) || '              ' || x || chr(10) || '          }' ELSE 'void f() {' || chr(10) || '      ' || x || chr(10) || '  }' END AS moved FROM t"""


def analysed_functions(spark, d):
    """A function around each text, whose second line is suspicious: its most suspicious nodes."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-w ]", " ")
    code = F.concat(F.lit("    def f(x):\n        y = x + 1\n        note = '"), text, F.lit("'\n        return y\n"))
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("bug"), code.alias("code"), F.lit(100).alias("start"), F.lit(101).alias("line"), F.lit("y = x + 1").alias("content"))
    return C.analyse(rows, "bug").select("bug", "place", "line", "type", "distance", F.array_join("names", ",").alias("names"), "reason")


ANALYSED = """SELECT conv_id || ':' || turn AS bug, CAST(v.place AS INTEGER) AS place, CAST(v.line AS INTEGER) AS line, v.type, CAST(v.distance AS INTEGER) AS distance, v.names, v.reason FROM conversations, (VALUES
  (1, 2, 'Assign', 0, 'x,y', 'type=Assign; dist=0; overlap=x,y; hints=check mutation/copy'), (2, 1, 'Function', 1, 'x,y', 'type=Function; dist=1; overlap=x,y; hints=check signature/body'), (3, 2, 'BinOp', 0, 'x', 'type=BinOp; dist=0; overlap=x'),
  (4, 3, 'Assign', 1, '', 'type=Assign; dist=1; hints=check mutation/copy'), (5, 4, 'Return', 2, 'y', 'type=Return; dist=2; overlap=y; hints=check return value')) v(place, line, type, distance, names, reason)"""


def enriched_functions(spark, d):
    """Java and Python files around each text; every third one's file isn't there."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", " ")
    java = F.concat(F.lit("import a.B;\nclass K {\n  private int size = 1;\n  public int f(int a) { return a; }\n  public void g(String b) { } // "), text, F.lit("\n}"))
    python = F.concat(F.lit("import a\nclass K:\n    size = 1  # "), text, F.lit("\n    def f(self):\n        pass\n    def g(self, b):\n        pass\n"))
    source = F.when(F.col("turn") % 3 != 2, F.when(F.col("conv_id") % 2 == 0, java).otherwise(python))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("bug"), F.when(F.col("conv_id") % 2 == 0, "java").otherwise("python").alias("language"), F.lit("K::f(int)").alias("parent"), F.lit("f").alias("name"), F.lit("  final int own = 2;").alias("function"), source.alias("source"))
    return C.enrich(rows, "bug").select("bug", *[F.array_join(c, ";").alias(c) for c in ("imports", "fields", "siblings")], "class_name", "source_available")


ENRICHED = """SELECT conv_id || ':' || turn AS bug, CASE WHEN turn % 3 = 2 THEN '' WHEN conv_id % 2 = 0 THEN 'a.B' ELSE 'import a' END AS imports, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN turn % 3 = 2 THEN 'final int own' ELSE 'private int size' END WHEN turn % 3 = 2 THEN '' ELSE 'size (class attr)' END AS fields,
  CASE WHEN turn % 3 = 2 THEN '' WHEN conv_id % 2 = 0 THEN 'public void g(String b)' ELSE 'def g(self, b)' END AS siblings, 'K' AS class_name, turn % 3 <> 2 AS source_available FROM conversations"""


def function_spans(spark, d):
    """A function in a file around each text: its own text, or a text of another body, which is found by its head and braces."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\"\\\n\r{}/*']", " ")
    file = F.concat(F.lit("class A {\n  // "), text, F.lit("\n  int f(int a) {\n    if (a > 1) {\n      return 2; // "), text, F.lit("\n    }\n    return 0;\n  }\n}"))
    block = F.when(F.col("turn") % 3 == 0, F.lit("  int f(int a) {\n    return -1;\n  }")).when(F.col("turn") % 3 == 1, F.lit("    return 0;\n  }")).otherwise(F.lit("  int g() {\n  }"))
    x = C.span(file, block, F.col("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", F.col("x.start").alias("first_line"), F.col("x.end").alias("last_line"))


def iterative_loop_stub(spark, d):
    """Three rounds over conversations with a stub generator, which adds a mark, and a stub evaluator."""
    items = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min("role").alias("base"))

    def generate(open_: DataFrame, k: int) -> DataFrame:
        return open_.select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("sample"), "seed").select("id", "sample", F.concat("seed", F.lit("+"), ((F.col("sample") + F.col("id")) % 3).cast("string")).alias("code"))

    def evaluate(fresh: DataFrame) -> DataFrame:
        failing = F.pmod(F.conv(F.substring(F.sha1(F.concat("code", F.lit(":"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(7)).cast("int")
        return fresh.withColumns({"failing": failing, "outcome": F.when(failing == 0, "pass").otherwise("test_fail")})

    return repair_loop.summary(items, repair_loop.run_rounds(items, generate, evaluate, work_folder(spark, "loop")))


#: Every round's seed is the last round's best code, so no round repeats one and nothing stagnates.
def _loop_sql() -> str:
    out = "WITH i AS (SELECT conv_id AS id, min(role) AS base FROM conversations GROUP BY 1), s1 AS (SELECT id, base AS seed FROM i)"
    for k in (1, 2, 3):
        out += f""", c{k} AS (SELECT id, s, seed || '+' || ((s + id) % 3) AS code FROM s{k}, (SELECT unnest([1, 2, 3]) AS s)),
e{k} AS (SELECT *, CAST('0x' || substr(sha1(code || ':' || id), 1, 8) AS BIGINT) % 7 AS failing FROM c{k}),
s{k + 1} AS (SELECT id, arg_min(code, failing * 10 + s) AS seed FROM e{k} GROUP BY id HAVING min(failing) > 0)"""
    return out + """, a AS (SELECT 1 AS k, * FROM e1 UNION ALL SELECT 2, * FROM e2 UNION ALL SELECT 3, * FROM e3)
SELECT id, bool_or(failing = 0) AS solved, min(CASE WHEN failing = 0 THEN k END) AS solving_iteration, count(*) AS n_candidates FROM a GROUP BY id"""


LINE_TIES = "l_linenumber, l_partkey, l_suppkey"
RANKED = f"""WITH s AS (SELECT *, CASE WHEN l_suppkey % 5 <> 0 THEN abs(CAST(l_quantity AS INTEGER) - 20) END AS gap, l_linenumber % 4 AS o FROM lineitem),
r AS (SELECT *, coalesce(gap, 9999) * 10 + [0, 1, 2, 2, 3][CAST(l_partkey % 5 AS INTEGER) + 1] - CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END - CASE WHEN l_linestatus = 'O' THEN 15 ELSE 0 END - least(10, o * 3) AS score,
  l_returnflag = 'R' OR l_linestatus = 'O' OR coalesce(gap <= 2, false) OR o > 0 OR l_partkey % 5 = 0 AS strong FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY strong DESC, score, {LINE_TIES}) AS place FROM r) SELECT l_orderkey, l_linenumber, l_partkey, strong, score, place FROM k WHERE place <= 5"""
QUERIES = {
    "rank_nodes_topk": (rank_nodes_topk, RANKED),
    "ranking_tuple_best": (ranking_tuple_best, RUNS + ", p AS (SELECT *, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS priority FROM runs), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, k, event_id) AS n FROM p) SELECT user_id, event_id, priority, k FROM r WHERE n = 1"),
    "topk_memory": (topk_memory, RUNS + ", c AS (SELECT *, event_type || ':' || (k % 10) AS code FROM runs), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, code ORDER BY event_id DESC) AS n FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS memory_rank FROM l WHERE n = 1) SELECT user_id, event_id, code, k, memory_rank FROM r WHERE memory_rank <= 3"),
    "coverage_topk": (coverage_topk, COVERAGE),
    "merge_rerank": (merge_rerank, f"WITH s AS (SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS score FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', coalesce(nullif(score, 0), -1000000000) DESC, {LINE_TIES}) AS place FROM s) SELECT l_orderkey, l_linenumber, score, place FROM p WHERE place <= 3"),
    "retry_gate": (retry_gate, RUNS + ", c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS dups, count(*) FILTER (event_type = 'error') AS failed FROM runs GROUP BY user_id) SELECT *, n - dups - failed < 12 AND (dups >= 24 OR dups / greatest(1, n) >= 0.4 OR failed >= 12) AS again FROM c"),
    "early_stop": (early_stop, RUNS + ", f AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS first FROM runs) SELECT user_id, event_id FROM f WHERE first IS NULL OR event_id <= first"),
    "candidate_priority": (candidate_priority, None),
    "line_diff_stats": (line_diff_stats, None),
    "similarity_ratio": (similarity_ratio, None),
    "python_structure": (python_structure, STRUCTURE),
    "java_blocks": (java_blocks, JAVA_BLOCKS),
    "iterative_loop_stub": (iterative_loop_stub, _loop_sql()),
    "analysed_functions": (analysed_functions, ANALYSED),
    "enriched_functions": (enriched_functions, ENRICHED),
    "greedy_pin": (greedy_pin, PINNED),
    "python_context": (python_context, "SELECT conv_id, turn, 'from a import b as c, d' AS imports, 'limit: int (class attr);name (class attr);self.x' AS fields, 'def __init__(self, x, *rest, y, **more);def h' || turn || '(self)' AS siblings FROM conversations"),
    "function_spans": (function_spans, "SELECT conv_id, turn, CAST(CASE turn % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 END AS INTEGER) AS first_line, CAST(CASE WHEN turn % 3 < 2 THEN 8 END AS INTEGER) AS last_line FROM conversations"),
}
