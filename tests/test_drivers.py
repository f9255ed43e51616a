import hashlib

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import candidates as C
from quarrywork.operators import sampling
from quarrywork.operators.stages import Driver, Stage, ordered


def brute_sample(keys, n, seed):
    return sorted(sorted(set(keys), key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))[:n])


@pytest.mark.parametrize("n", [0, 1, 60, 499, 500, 1000])
def test_sample_is_exact_and_does_not_depend_on_partitions(spark, n):
    keys = list(range(500)) + [None, 3, 3, 7]
    rows = spark.createDataFrame([(k,) for k in keys], "id bigint")
    want = brute_sample([k for k in keys if k is not None], n, 9)
    for parts in (1, 7):
        assert sorted(r.id for r in sampling.seeded_sample(rows.repartition(parts), "id", n, 9).collect()) == want


def test_stored_sample_holds(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    first = {r.id for r in sampling.stored_sample(spark.range(300), "id", 20, 1, path).collect()}
    assert first == set(brute_sample(range(300), 20, 1)) == {r.id for r in sampling.stored_sample(spark.range(50), "id", 5, 2, path).collect()}
    assert sampling.seeded_sample(spark.range(0), "id", 5, 1).count() == 0


def graph(calls, version=1):
    def halves(numbers):
        calls.append("halves")
        return numbers.select("id", (F.col("id") / 2).cast("bigint").alias("half"), F.when(F.col("id") % 2 == 1, "odd").alias("error"))

    def sums(rows):
        calls.append("sums")
        return rows.agg(F.sum("half").alias("total"))

    return [Stage("sums", sums, ("halves",), {"total": F.sum("total")}), Stage("halves", halves, ("numbers",), {"small": F.count_if(F.col("id") < 10)}, version=version)]


def test_stages_run_once_and_bad_rows_are_set_aside(spark, tmp_path):
    calls, folder = [], f"file://{tmp_path}/run"
    driver = Driver(spark, folder, {"numbers": spark.range(100)}, graph(calls))
    got = {r.stage: r for r in driver.run().collect()}
    assert (got["halves"].rows, got["halves"].failed, got["halves"].counts) == (100, 50, {"small": 10})
    assert (got["sums"].rows, got["sums"].failed, got["sums"].counts) == (1, 0, {"total": sum(range(50))})
    assert {(r.id % 2, r.error) for r in driver.quarantined("halves").collect()} == {(1, "odd")} and driver.tables["halves"].count() == 50
    assert calls == ["halves", "sums"]
    again = Driver(spark, folder, {"numbers": spark.range(0, 100, 1, 3)}, graph(calls))  # equal rows, dealt otherwise
    assert all(r.reused for r in again.run().collect()) and calls == ["halves", "sums"]
    Driver(spark, folder, {"numbers": spark.range(100)}, graph(calls, version=2)).run()
    Driver(spark, folder, {"numbers": spark.range(101)}, graph(calls)).run()
    assert calls == ["halves", "sums"] * 3


def test_a_crash_leaves_finished_stages(spark, tmp_path):
    calls, folder = [], f"file://{tmp_path}/crash"
    good = graph(calls)

    def fails(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        Driver(spark, folder, {"numbers": spark.range(10)}, [good[1], Stage("sums", fails, ("halves",))]).run()
    report = Driver(spark, folder, {"numbers": spark.range(10)}, good).run().collect()
    assert [r.reused for r in report] == [True, False] and calls == ["halves", "sums"]


def test_empty_tables_and_stages_without_errors(spark, tmp_path):
    driver = Driver(spark, f"file://{tmp_path}/none", {"numbers": spark.range(0)}, [Stage("same", lambda n: n, ("numbers",))])
    (r,) = driver.run().collect()
    assert (r.rows, r.failed) == (0, 0) and driver.tables["same"].count() == 0 and driver.quarantined("same").count() == 0


def test_graphs_that_cannot_run():
    one = lambda n, *reads: Stage(n, lambda *_: None, reads)
    for stages in ([one("a", "b"), one("b", "a")], [one("a", "x")], [one("a", "s"), one("a", "s")], [one("s", "s")]):
        with pytest.raises(ValueError, match=r"."):
            ordered(stages, ["s"])
    assert [s.name for s in ordered([one("c", "b"), one("b", "s")], ["s"])] == ["b", "c"]


METHOD = "public int f(int a) {\n    int x = 1;\n    if (a > 1) {\n        x = a; // }\n    }\n    return x;\n}"


@pytest.mark.parametrize(
    ("fragment", "want"),
    [
        ("if (a > 1) {\n    x = b;\n}", METHOD.replace("x = a; // }", "x = b;").replace("        x = b;", "        x = b;")),
        ("x = a; // }\ny = 2;", METHOD.replace("        x = a; // }", "        x = a; // }\n        y = 2;")),
        ("  private static int g(int b) {\n return 1;\n}", "private static int g(int b) {\n return 1;\n}"),
        ("@Override\npublic int f(int a) { return 2; }", "@Override\npublic int f(int a) { return 2; }"),
        ("other(1);\nreturn x;", None),
        ("{\n}", None),
        ("", None),
        ('int x = 1;\nString s = "{";\nreturn x;', METHOD[: METHOD.index("    int x")] + '    int x = 1;\n    String s = "{";\n    return x;\n}'),
        ("return x;\n}", METHOD[: METHOD.index("    return")] + "    return x;\n    }"),
    ],
)
def test_fragments(fragment, want):
    assert C.merge_fragment(METHOD, fragment) == want


def test_merged_fields_by_policy(spark):
    from quarrywork.operators import pooling as P

    schema = "id int, code string, llm_calls_total int, bm25_top1 double, plan_fill_used boolean, temperature_used array<double>, profiles_tried array<string>, scheduler string, allowed_edit_types array<string>, drop_counts map<string,int>, java_decl_recovery_mode_counts map<string,int>, unique_after_stage map<string,int>"
    a = spark.createDataFrame([(1, "a", 2, 0.5, None, [0.1], ["x", "y"], "s", ["INSERT"], {"duplicate": 1, "?": 9}, {"m": 1}, {"1": 5, "2": 1}), (2, "c", None, None, None, None, None, None, None, None, None, None)], schema)
    b = spark.createDataFrame([(1, "b", 3, 0.2, True, [0.0, 0.1], ["z", "x"], " ", [], {"duplicate": 2}, {"n": 2, "m": 1}, {"1": 3})], schema)
    got = {r.id: r for r in P.merge_items([a, b], "id").collect()}
    one, two = got[1], got[2]
    assert (one.code, one.llm_calls_total, one.bm25_top1, one.plan_fill_used, one.n_runs) == ("a", 5, 0.5, True, 2)
    assert (one.temperature_used, one.profiles_tried, one.scheduler, one.allowed_edit_types) == ([0.1, 0.0, 0.1], ["x", "y", "z"], "s", ["INSERT"])
    assert one.drop_counts["duplicate"] == 3 and set(one.drop_counts) == set(C.DROP_REASONS) and one.java_decl_recovery_mode_counts == {"m": 2, "n": 2} and one.unique_after_stage == {"1": 5, "2": 1}
    assert (two.llm_calls_total, two.plan_fill_used, two.scheduler, two.allowed_edit_types, two.drop_counts["other"]) == (0, False, "fixed", ["REPLACE"], 0)


def test_merged_candidates_are_judged_and_scored_again(spark):
    from quarrywork.operators import pooling as P

    base = "int f(int a) {\n  int one = 1;\n  return g(a);\n}"
    codes = [
        ("a", base.replace("g(a)", "g(a + 1)"), False), ("b", base.replace("g(a)", "g( a + 1)"), False), ("c", base, False), ("d", base.replace("f(int", "k(int"), False),
        ("e", base.replace("g(a);", "g(a;"), False), ("f", base.replace("g(a)", "g(thing)"), True), ("g", " ", False), ("h", base.replace("one = 1", "one = 2"), False),
    ]
    rows = [(1, k, base, c, "f", g, 50.0) for k, c, g in codes]
    schema = "id int, place string, base string, code string, name string, greedy boolean, base_score double"
    first, second = spark.createDataFrame(rows[:5], schema), spark.createDataFrame([*rows[5:], (1, "a", base, codes[0][1].replace("g(a + 1)", "g(a  +  1)"), "f", False, 50.0)], schema)
    got = {(r.run_no, r.place): (r.problem, r.pick) for r in P.merge_candidates([first, second], "id", "place", P.java_judge(filtering=True), 3).collect()}
    assert got[0, "a"][0] is None and got[1, "a"] == ("duplicate", None) and got[0, "b"][0] is None
    assert got[0, "c"] == ("no_change", None) and got[0, "d"] == ("name_mismatch", None) and got[0, "e"] == ("java_compile_invalid", None)
    assert (1, "g") not in got and got[1, "f"] == (None, 1)
    items = [spark.createDataFrame([(1, 9, {"other": 1})], "id int, target_candidates int, drop_counts map<string,int>")] * 2
    merged, kept = P.merge_runs(items, [first, second], "id", "place", P.java_judge(filtering=True), 3)
    r = merged.first()
    assert (r.valid_candidates, r.fill_rate, r.drop_counts["java_compile_invalid"], r.drop_counts["other"]) == (3, 0.3333, 1, 2) and kept.count() == 3


def test_runs_are_dealt_by_item_once_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    import re

    from quarrywork.operators import pooling
    from quarrywork.plans import catalogue

    monkeypatch.setattr(pooling, "TASK_ROWS", 500)
    plan = catalogue.queries()["dataset_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(l_orderkey#\d+L?, \w+#", plan)
    # About 6,000 candidates at 500 a task, where the session's shuffles have 4.
    assert all(int(n) > 4 for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L?, (\d+)\), REPARTITION", plan)) and "REPARTITION_BY_NUM" in plan
