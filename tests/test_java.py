import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrywork.functions import java
from quarrywork.operators import candidates as C
from quarrywork.operators import java_validity as V


def ask(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, x string").withColumn("y", column(F.col("x")))
    return [r.y for r in sorted(rows.collect())]


def contract(r):
    return r.name, r.kind, r.arity, r.throws


def test_contracts(spark):
    codes = [
        "int f(Map<String,Integer> m, int b) { return 1; }",
        "if (a) { x(); }\npublic static int g() throws A,\n  B { return 1; }",
        "  public Foo(int a) { }",
        "Foo(int a) { }",
        "@Override\nfinal class Foo extends Bar<T> { int f() { return 1; } }",
        "enum E { A }",
        "x = 1;",
        None,
        "void h(String s, int[] a, Function<A, Map<B, C>> f) { for (int i = 0;;) { } }",
    ]
    got = [contract(r) for r in ask(spark, codes, java.contract)]
    assert got == [
        ("f", "method", 2, ""), ("g", "method", 0, "A, B"), ("Foo", "constructor", 1, ""), ("Foo", "constructor", 1, ""), ("Foo", "class", None, ""), ("E", "enum", None, ""),
        ("", "unknown", None, ""), ("", "unknown", None, ""), ("h", "method", 3, ""),
    ]


def test_symbols(spark):
    code = 'int f(int a) {\n // old(a)\n String s = "call(x)"; obj.run(a); this.own (b);\n new Bar(b); return g(h(A, ID)); }'
    assert ask(spark, [code], java.calls)[0] == ["f", "g", "h", "own"]
    assert ask(spark, [code], java.types)[0] == ["A", "Bar", "ID", "String"]
    assert ask(spark, [code], java.constants)[0] == ["ID"]
    assert ask(spark, [code, None], java.lower_names) == [["obj", "own", "run"], []]
    loop = "for (final Item it : all) { int n = 1, m; try { x(); } catch (A | B bad) { } use((p, q) -> p + q, z -> z); }"
    assert ask(spark, [loop], java.declared_names)[0] == ["bad", "it", "n", "p", "q", "z"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("()[]{}a\"' ", max_size=12), min_size=1, max_size=30))
def test_balance_against_a_stack(spark, texts):
    def closes(bare):
        due = []
        for c in bare:
            if c in "([{":
                due.append({"(": ")", "[": "]", "{": "}"}[c])
            elif c in ")]}":
                if not due or due.pop() != c:
                    return False
        return not due

    bare = ask(spark, texts, java.bare)
    assert ask(spark, texts, java.balanced) == [closes(x) for x in bare]


def test_labels_and_symbols(spark):
    text = "- Referenced helper methods in this method: this.a(), b.c( ), Map<A, B>\n types referenced: no\nReferenced Helper Methods In This Method: d"
    found = ask(spark, [text, None], lambda x: java.labelled(x, *V.CALL_LABELS))
    assert found == [["a", "c", "Map<A, B>", "d"], []]
    assert ask(spark, [" this.x ", "@A.b", "f()", "a.b.c", ""], java.symbol) == ["x", "@A.b", "f", "c", ""]


BASE = "int f(int a) throws X {\n  int one = 1;\n  return g(a);\n}"


def rows(spark, codes, **more):
    df = spark.createDataFrame([(k, BASE, c, "f", 10.0) for k, c in enumerate(codes)], "id int, base string, code string, name string, score double")
    return df.withColumns(more)


def test_reasons_hard_and_soft(spark):
    codes = [
        BASE.replace("g(a)", "g(a + 1)"),
        BASE.replace("g(a)", "g(thing)"),
        BASE.replace("g(a)", "other(Thing.of(LIMIT), thing)"),
        BASE.replace("int f(int a)", "int f(int a, int b)"),
        BASE.replace("f(int", "k(int"),
        BASE.replace("g(a);", "g(a;"),
        "import x.Y;\n" + BASE,
        "class f {\n" + BASE + "\n}",
        BASE.replace("g(a)", "g(a);;"),
        BASE.replace("return g(a);", "return g(a); // fixed line"),
        "",
    ]
    got = {r.id: (r.reasons, sorted(r.hard_reasons), r.compile_problem) for r in V.judged(V.analysed(rows(spark, codes)), promote=True).collect()}
    assert got[0] == ([], [], None)
    assert got[1] == (["new_identifier_reference"], [], None)
    refs = ["new_helper_call", "new_type_reference", "new_constant_reference", "new_identifier_reference"]
    assert got[2] == (refs, sorted(refs), None)  # four and more of them
    assert got[3][0] == ["signature_mismatch", "api_signature_drift"] and got[3][1] == ["signature_mismatch"]
    assert got[4][0] == ["signature_mismatch", "new_helper_call", "api_signature_drift"]
    assert got[5] == (["unbalanced_delimiters", "compile_fail"], ["compile_fail", "unbalanced_delimiters"], "unbalanced_delimiters")
    assert got[6][0] == ["wrapper_mismatch", "new_type_reference"] and got[7][1][:1] == ["decl_kind_mismatch"]
    assert got[8][2] == "double_semicolon" and got[9][0] == ["model_artifact"]
    assert got[10][2] == "empty_code" and "broad_rewrite" in got[10][0]


def test_context_allows(spark):
    code = BASE.replace("g(a)", "other(Thing.of(thing))")
    more = {"helper_calls": F.array(F.lit("other()")), "summary": F.lit("Types referenced in this method: Thing"), "fields": F.array(F.lit("this.thing"))}
    found = V.judged(V.analysed(rows(spark, [code], **more))).withColumn("s", V.supports(F.col("drift.supported_identifiers"), F.col("allowed.support"))).first()
    assert found.reasons == ["new_identifier_reference"] and found.drift.new_identifiers == ["of"]
    assert found.drift.supported_types == ["Thing"] and found.s == {"other": ["helper_calls"], "thing": ["instance_fields"]}
    prompt = {"prompt": F.lit("Referenced instance fields: of\nReferenced helper methods in this method: other\nReferenced types in this method: Thing\nReferenced instance fields: thing")}
    plain = V.judged(V.analysed(rows(spark, [code], **prompt))).first()
    rescued = V.judged(V.analysed(rows(spark, [code], **prompt), rescue=True)).first()
    assert plain.reasons == ["new_helper_call", "new_type_reference", "new_identifier_reference"] and rescued.reasons == []


def test_rerank(spark):
    codes = [BASE.replace("g(a)", "g(a + 1)"), BASE.replace("throws X ", "").replace("g(a)", "mine(a)") + "\nint mine(int a) {\n  return 1;\n}"]
    got = {r.id: r for r in V.reranked(V.analysed(rows(spark, codes, plan_ok=F.lit(True), bug_line=F.lit(3)))).collect()}
    assert got[0].points == {"exact_signature_preservation": 20, "throws_clause_kept": 8, "original_identifier_reuse": 12, "plan_ok": 15, "no_violation": 8, "near_bug_region": 12}
    assert got[0].score == 85 and got[0].features.risk_tier == 0
    assert got[1].features.invented_helper_declaration and got[1].features.extra_nested_declaration == 1 and got[1].points["api_signature_drift"] == -20 and got[1].features.risk_tier == 3
    assert len(got[0].features) == 26


def test_validity_rerank(spark):
    df = spark.createDataFrame([(1.0, True, True, []), (1.0, True, True, ["a"]), (1.0, True, False, ["a"]), (1.0, None, None, [])], "s double, c boolean, v boolean, r array<string>")
    assert [r[0] for r in df.select(V.validity_rerank(F.col("s"), F.col("c"), F.col("v"), F.col("r"))).collect()] == [61.0, 1.0, -59.0, 1.0]


def test_rescue_scans_eligible_ones(spark):
    df = spark.createDataFrame([(1, 100 - k, False, k >= 6, f"s{k}") for k in range(9)] + [(2, 9, True, True, "a"), (3, 5, False, True, ""), (3, 4, False, True, ""), (3, 3, False, True, "b"), (3, 2, False, True, "b")], "g int, score int, survives boolean, eligible boolean, signature string")
    got = sorted((r.g, r.score, r.pick) for r in C.rescue(df, "g").collect())
    assert got == [(1, 92, 3), (1, 93, 2), (1, 94, 1), (3, 3, 3), (3, 4, 2), (3, 5, 1)]


def test_rescuable(spark):
    codes = [BASE.replace("g(a)", "g(thing)"), BASE.replace("g(a)", "g(a + 1)"), BASE.replace("int a", "int b, int c")]
    got = V.judged(V.analysed(rows(spark, codes))).withColumn("ok", V.rescuable(F.lit(False))).collect()
    assert [r.ok for r in sorted(got, key=lambda r: r.id)] == [True, False, False]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    df = rows(spark, [BASE] * n) if n else rows(spark, [BASE]).filter("false")
    assert V.reranked(V.judged(V.analysed(df))).count() == n


def test_labels_of_a_text(spark):
    texts = ["- Types: B, this.a()\nother: x", "no labels", None, "TYPES:", "x types: a\n - types : c.D , @E.f", "Types a"]
    assert ask(spark, texts, lambda x: java.labelled(x, "types")) == [["B", "a"], [], [], [], ["D", "@E.f"], ["a"]]


def test_few_bytes_of_parts_are_many_tasks(spark):
    from quarrywork.plans import catalogue

    df = catalogue.queries()["allow_lists"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
