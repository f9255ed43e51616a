import pytest
from pyspark.sql import functions as F

from quarrywork.functions import edit_plans as P
from quarrywork.functions import stats, text, vectors


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize(("b", "c", "p"), [(18, 7, 0.0433), (12, 8, 0.5034), (11, 4, 0.1185), (10, 5, 0.3018), (0, 0, 1.0), (4, 4, 1.0), (900, 1000, 0.0232)])
def test_mcnemar(spark, b, c, p):
    assert round(one(spark, p=stats.mcnemar_p(F.lit(b), F.lit(c))).p, 4) == pytest.approx(p, abs=1e-3 if b == 900 else 1e-9)


def test_fisher(spark):
    assert one(spark, p=stats.fisher_combined(F.array(F.lit(0.3017578125), F.lit(0.3017578125)))).p == pytest.approx(0.309255983373580, abs=1e-12)


@pytest.mark.parametrize(
    ("log", "family"),
    [
        ("Foo.java:3: error: cannot find symbol", "cannot_find_symbol"),
        ("error: incompatible types: List<String> cannot be converted", "generic_type_mismatch"),
        ("error: incompatible types: int cannot be converted to String", "type_mismatch"),
        ("error: method does not override a method", "method_signature"),
        ("error: unreported exception X", "checked_exception"),
        ("error: a has protected access in B", "access_control"),
        ("error: package a.b does not exist", "package_or_import"),
        ("error: reached end of file while parsing", "syntax_or_parse"),
        ("BUILD FAILED", "other_compile_fail"),
        (None, "other_compile_fail"),
    ],
)
def test_families(spark, log, family):
    assert one(spark, f=text.compile_error_family(F.lit(log).cast("string"))).f == family


def test_generic_family_is_optional(spark):
    log = F.lit("incompatible types: List<String>")
    assert one(spark, f=text.compile_error_family(log, generics=False)).f == "type_mismatch"


@pytest.mark.parametrize(("reason", "family", "strategy", "priority"), [("test_fail", "", "test_feedback", 3), ("compile_fail", "type_mismatch", "type_feedback", 2), ("compile_fail", "strange", "generic_compile_feedback", 1), ("syntax_fail", "", "syntax_feedback", 1), ("timeout", "", "simplify_feedback", 0), ("pass", "", None, 0)])
def test_routing(spark, reason, family, strategy, priority):
    r = one(spark, s=text.feedback_strategy(F.lit(reason), F.lit(family)), p=text.failure_priority(F.lit(reason), F.lit(family)))
    assert (r.s, r.p) == (strategy, priority)


def test_tokens(spark):
    t = F.array(*[F.lit(x) for x in "abcde"])
    r = one(spark, a=text.tokenize(F.lit("Foo_bar(1) É x")), n=text.tokenize(F.lit(None).cast("string")), r=text.repeat_tokens(t, 1.5), z=text.repeat_tokens(t, 0), j=text.token_jaccard(t, F.array(F.lit("a"), F.lit("z"))))
    assert (r.a, r.n, r.r, r.z, round(r.j, 6)) == (["foo_bar", "1", "x"], [], list("abcde") + ["a", "b"], [], round(1 / 6, 6))


def test_extensions_and_lines(spark):
    r = one(
        spark,
        e=text.file_extension(F.lit("a.b/C.JAVA")), n=text.file_extension(F.lit("a.b/c")), h=text.file_extension(F.lit("/x/.git")),
        lines=text.lines(F.lit("a\r\nb\rc\n")), none=text.lines(F.lit("")), t=text.truncate(F.lit("x" * 50), 20), c=text.cut_at_stops(F.lit("ab##c``"), ["``", "##"]), j=text.outer_json(F.lit("x {\"a\": {}} y")), k=text.outer_json(F.lit("none")),
    )
    assert (r.e, r.n, r.h, r.lines, r.none) == (".java", "", "", ["a", "b", "c"], [])
    assert len(r.t) == 20 and r.t.endswith("[truncated]") and (r.c, r.j, r.k) == ("ab", '{"a": {}}', None)


def test_find_line(spark):
    code = F.lit("int a;\n  b(); // note\nc = 1;")
    r = one(spark, a=text.find_line(code, F.lit("int a;")), b=text.find_line(code, F.lit("b();")), c=text.find_line(code, F.lit("c =")), d=text.find_line(code, F.lit("zzz")), e=text.find_line(code, F.lit(" ")))
    assert tuple(r) == (1, 2, 3, None, None)


def test_plans(spark):
    lit = F.lit
    ranges = lambda *r: F.array(*[F.struct(F.lit(a).cast("int").alias("start"), F.lit(b).cast("int").alias("end")) for a, b in r])
    types = lambda *t: F.array(*map(F.lit, t))
    r = one(
        spark,
        ok=P.plan_problem(ranges((1, 3)), lit(2), types("replace")), bad=P.plan_problem(ranges((1, 1), (3, 1)), lit(2), types("REPLACE")), kind=P.plan_problem(ranges((1, 1)), lit(1), types("MOVE")), none=P.plan_problem(ranges((1, 1)), lit(0), types("INSERT")),
        o=P.overlaps(lit(1), lit(3), lit(4), lit(6)), s=P.overlaps(lit(1), lit(3), lit(4), lit(6), 2), c=P.contains(lit(1), lit(9), lit(2), lit(9)), x=P.clamp_range(lit(90), lit(-4), lit(30)),
    )
    assert tuple(r)[:-1] == (None, "bad_range", "bad_type", "bad_budget", False, True, True) and tuple(r.x) == (1, 30)


def test_feedback_hides_what_it_should(spark):
    from quarrywork.functions import feedback as B

    none = F.array().cast("array<string>")
    attempt = dict.fromkeys(("code", "log", "test_log", "first_log", "line", "base"), F.lit("return x + 1;")) | {"failing_count": F.lit(2), "failing_names": F.array(F.lit("testFooBar")), "first_test": F.lit("Foo"), "first_message": F.lit("expected:<1>"), "first_stack": F.lit("at Foo.java:42"), "siblings": none, "imports": none}
    test = F.lit("test_feedback")
    r = one(spark, full=B.feedback(test, attempt), bare=B.feedback(test, attempt, test_facts=False), blind=B.feedback(test, attempt, blind=True, test_facts=False), a=B.feedback(F.lit("symbol_feedback"), attempt), b=B.feedback(F.lit("symbol_feedback"), attempt, test_facts=False), odd=B.feedback(F.lit("?"), attempt))
    for secret in ("testFooBar", "expected:<1>", "Foo.java:42"):
        assert secret in r.full and secret not in r.bare and secret not in r.blind
    assert "HINT" in r.bare and "ORIGINAL BUGGY CODE" in r.bare and "DIFFERENT approach" in r.blind and r.a == r.b and r.odd.startswith("COMPILE ERROR:\n")


def test_settings(spark):
    from quarrywork.functions import prompts

    r = one(spark, s=prompts.run_settings(F.lit("A=1, b = x=y ,tag one,a=2,two")), t=prompts.run_settings(F.lit("x,TAG=z")), n=prompts.run_settings(F.lit(None).cast("string")))
    assert (r.s, r.t, r.n) == ({"a": "2", "b": "x=y", "tag": "tag one"}, {"tag": "z"}, {})
    assert [p["seed"] for p in prompts.preset_runs(7)] == [7, 8, 9]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    r = one(spark, c=vectors.cosine(a, b), n=vectors.norm(a), z=vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), u=vectors.normalized(a))
    assert r.c == pytest.approx(0.96) and r.n == 5 and r.z == 0 and r.u == pytest.approx([0.6, 0.8])


def test_a_looked_up_line_is_computed_once(spark):
    from quarrywork.plans import catalogue

    df = catalogue.queries()["line_lookup"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s*//.*$") <= 2  # one for the goal, one for the lines; it was a copy for each use of the line
