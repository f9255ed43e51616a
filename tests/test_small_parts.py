import datetime

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import candidates as C
from quarrywork.operators import code, rollups
from quarrywork.sources import discovery


def test_newest_input_of_each_dataset(spark):
    day = datetime.datetime(2026, 1, 1)
    paths = ["a_single_20260101_000000.json", "a_hard_20250101_000000.json", "a_hard_20250102_000000.json", "b_plain.json", "b_enriched.json", "b_enriched_2.json"]
    files = spark.createDataFrame([(p, day + datetime.timedelta(k)) for k, p in enumerate(paths)], "path string, modified timestamp")
    got = {r.dataset: r.path for r in discovery.newest_inputs(files, F.substring("path", 1, 1)).collect()}
    assert got["a"].startswith("a_hard_2025010") and got["b"].startswith("b_enriched")
    assert {r.path for r in discovery.newest_inputs(files, F.substring("path", 1, 1), "single").collect()} == {paths[0]}
    assert discovery.newest_inputs(files.limit(0), F.substring("path", 1, 1)).count() == 0


def test_rows_by_size_and_required_numbers(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 9), (None, 1)], "name string, n int")
    assert [r.name for r in rollups.by_size(df, "n", "name").collect()] == ["c", "a", "b", None]
    assert rollups.require(df, 4, "subgroup").count() == 4
    with pytest.raises(ValueError, match="subgroup: 4 rows, not 3"):
        rollups.require(df, 3, "subgroup")


def test_carried_metadata(spark):
    df = spark.createDataFrame([(None, "old", [], ["x"], None), ("", None, None, None, 2.0), ("new", "old", ["y"], ["x"], 0.0)], "a string, a0 string, l array<string>, l0 array<string>, n double")
    got = df.select(*C.carried({"a": F.col("a"), "l": F.col("l"), "n": F.col("n")}, {"a": F.col("a0"), "l": F.col("l0")}, {"a": "none", "l": [], "n": 1.0})).collect()
    assert [tuple(r) for r in got] == [("old", ["x"], 1.0), ("none", [], 2.0), ("new", ["y"], 0.0)]


def test_diffs_become_code(spark):
    texts = ["--- a\n+++ b\n@@ -1,2 +1,2 @@\n int a;\n-int b;\n+int c;", "int a;\n-1;", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", C.diff_lines_to_code(F.col("t")).alias("x")).collect()}
    assert got == {0: "int a;\nint c;", 1: "int a;\n-1;", 2: None}


def test_remarks_go(spark):
    text = "java\nint a; // fixed line here\nint b; // <--- buggy line\n// corrected below\nint c; // kept"
    df = spark.createDataFrame([(text,)], "t string").select(C.plain_lines(F.col("t")).alias("x"))
    assert df.first().x == "int a;\nint b;\nint c; // kept"


def test_imports_by_any_of_their_names(spark):
    found = ["java.util.List", "static a.b.C.of", "x.y.*", "from m.n import P, Q as r", "import os"]
    df = spark.createDataFrame([(found, "List * Q n"), (found, "static"), (found, "")], "i array<string>, c string")
    got = [r.x for r in df.select(code.relevant_imports(F.col("i"), F.col("c")).alias("x")).collect()]
    assert got == [["java.util.List", "from m.n import P, Q as r"], ["static a.b.C.of"], []]
    parts = df.limit(1).select(code.sibling_parts(F.array(F.lit("def List(self)"), F.lit("if (n)"), F.lit("nope()")), F.col("c")).alias("p")).first().p
    assert (parts.called, parts.others) == (["def List(self)"], ["nope()"])


def test_a_key_without_a_vector_keeps_its_row(spark):
    from quarrywork.operators import records

    ranked = spark.createDataFrame([("q", 1, 1.0), ("q", 2, 0.5), ("q", 3, 0.0), ("r", 1, 1.0)], "query string, key int, norm double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "key int, v array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query string, v array<double>")
    encode = lambda missing: missing.filter("key = 2").select("key", F.array(F.lit(0.0), F.lit(1.0)).alias("v"))
    found = records.dense_rerank(records.with_similarity(ranked, vectors, asked, "key", "query", "v", encode), "query", "key")
    got = {(r.query, r.key): (r.cos, round(r.fused, 6), r.rank) for r in found.collect()}
    assert {k: round(v[0], 6) if v[0] is not None else None for k, v in got.items()} == {("q", 1): 1.0, ("q", 2): 0.0, ("q", 3): None, ("r", 1): None}
    assert (got["q", 1][1:], got["q", 2][1:], got["q", 3][1:], got["r", 1][1:]) == ((1.0, 1), (0.2, 2), (0.0, 3), (0.4, 1))
