"""What a retry is told: a registry of feedback builders by strategy, and the preparation of the prompt they follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywork.functions.text import compiler_lines, find_line, let, lines, local_context, short_list, test_detail, test_names, test_output

END = "Output the COMPLETE fixed function."
# The sentences of compile feedback: what went wrong, the title and name of a list, how to fix it.
COMPILE_FORMS = {
    "syntax_feedback": (
        "COMPILE ERROR: syntax error.", None, None,
        "Check for missing semicolons, unbalanced braces, or incomplete statements.",
    ),
    "symbol_feedback": (
        "COMPILE ERROR: cannot find symbol.", "AVAILABLE METHODS in this class", "siblings",
        "Replace the unknown symbol with one from the list above. Do NOT invent methods.",
    ),
    "type_feedback": (
        "COMPILE ERROR: incompatible types.", None, None,
        "Use the correct type or add an explicit cast. Check return types carefully.",
    ),
    "generic_type_feedback": (
        "COMPILE ERROR: generic/parameterized type mismatch.", "AVAILABLE METHOD SIGNATURES (with their generic parameters)", "siblings",
        "\n- Check the type parameters `<...>` — the compiler reports a bound/inference violation."
        "\n- Common patterns: use `<?>` or `<? extends T>` for read-only, `<? super T>` for write-only."
        "\n- Do NOT erase generics to raw types; keep the parameterization the surrounding code uses."
        "\n- Match the exact type argument shape shown in AVAILABLE METHOD SIGNATURES above.",
    ),
    "signature_feedback": (
        "COMPILE ERROR: wrong method arguments.", "AVAILABLE METHOD SIGNATURES", "siblings",
        "Match the exact parameter types and count shown above.",
    ),
    "exception_feedback": (
        "COMPILE ERROR: uncaught checked exception.", None, None,
        'Add try-catch or add "throws" to the method signature.',
    ),
    "access_feedback": (
        "COMPILE ERROR: access control violation (private/protected field or method).", None, None,
        "Use a public getter/setter or an accessible alternative.",
    ),
    "import_feedback": (
        "COMPILE ERROR: package or class does not exist.", "AVAILABLE IMPORTS in this file", "imports",
        "Use only classes from the imports above. Do NOT reference packages that are not imported.",
    ),
    "generic_compile_feedback": (
        "COMPILE ERROR:", None, None,
        "Read the error message above and fix accordingly.",
    ),
}
# The sentences of test feedback.
WRONG = "Your code compiled but FAILED TESTS — the logic is wrong."
FEW = "Your code COMPILES and is PARTIALLY correct — only {n} test(s) fail. Preserve the passing behavior; fix only what fails."
MANY = "Your code COMPILES but {n} tests fail. The logic is partially correct — keep the passing behavior and target only the failing cases."
TEST_FIX = (
    "FIX: Use the failing test information above to repair the logic.",
    "Start from the ORIGINAL BUGGY CODE, not your previous rewrite.",
    "Make a MINIMAL semantic fix near the buggy line.",
    "Use the FIRST FAILURE MESSAGE as the main semantic target.",
    "If only a small number of tests fail, target that behavior and preserve everything else.",
    "Undo unnecessary changes from the wrong code.",
)
BARE_FIX = (
    "FIX: The previous attempt failed tests. Repair the logic.",
    "Start from the ORIGINAL BUGGY CODE, not your previous rewrite.",
    "Make a MINIMAL semantic fix near the buggy line.",
    "Undo unnecessary changes from the wrong code.",
)

#: Columns of one attempt: code, log, failing_count, failing_names, test_log, first_test, first_message, first_stack, first_log, line, base, siblings, imports.
Attempt = dict[str, Column]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _paragraphs(*parts: Column | str) -> Column:
    """Joined by an empty line; nulls are left out."""
    return F.array_join(F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])), "\n\n")


def _titled(title: str, body: Column, gap: str = "\n") -> Column:
    """Null without a body."""
    return F.when(_text(body) != "", F.concat(F.lit(f"{title}:{gap}"), body))


def _wrong_code(a: Attempt) -> Column:
    return F.concat(F.lit("YOUR WRONG CODE:\n"), _text(a["code"]))


def _compile(form: str) -> Callable[[Attempt], Column]:
    said, title, items, fix = COMPILE_FORMS[form]

    def build(a: Attempt) -> Column:
        head = F.concat(F.lit(f"{said}\n"), compiler_lines(a["log"]))
        known = [F.concat(F.lit(f"{title}:\n"), short_list(a[items]))] if title else []
        return _paragraphs(head, _wrong_code(a), *known, f"FIX: {fix}\n{END}" if not fix.startswith("\n") else f"FIX:{fix}\n{END}")

    return build


def _near_and_base(a: Attempt) -> list[Column]:
    return [_titled("HINT: The original bug is likely on or near this line", a["line"], "\n  "), _titled("ORIGINAL BUGGY CODE", F.substring(_text(a["base"]), 1, 700))]


def _tests(a: Attempt) -> Column:
    n, names, output = a["failing_count"], test_names(a["failing_names"]), test_output(a["test_log"])
    failing = F.when(names != "", F.concat(F.lit("FAILING TEST NAMES:\n"), names)).when(output != "", F.concat(F.lit("FAILING TESTS:\n"), output))
    # Without a count, what is known is still told; the first test's own output only where it has no message.
    known = [
        F.concat(F.lit("FAILING TEST COUNT: "), n.cast("string")),
        F.coalesce(failing, F.lit("FAILING TESTS:\n(no detailed failing test output captured)")),
        _titled("FIRST FAILING TEST", a["first_test"]),
        _titled("FIRST FAILURE MESSAGE", a["first_message"]),
        _titled("RELEVANT STACK FRAMES", test_detail(a["first_stack"], 3)),
        F.when(_text(a["first_message"]) == "", _titled("FIRST FAILING TEST DETAIL", test_detail(a["first_log"]))),
    ]
    counted = lambda form: F.concat(*[x for p in form.split("{n}") for x in (F.lit(p), n.cast("string"))][:-1])
    head = F.when(n <= 3, counted(FEW)).when(n.isNotNull(), counted(MANY)).otherwise(WRONG)
    return _paragraphs(head, _paragraphs(*known, *_near_and_base(a)), _wrong_code(a), "\n".join([*TEST_FIX, END]))


def _tests_unnamed(a: Attempt) -> Column:
    """Nothing that the tests said: the line and the code alone."""
    return _paragraphs(WRONG, _paragraphs(*_near_and_base(a)), _wrong_code(a), "\n".join([*BARE_FIX, END]))


def _simplify(a: Attempt) -> Column:
    base = F.concat(F.lit("ORIGINAL BUGGY CODE (for reference):\n"), F.substring(_text(a["base"]), 1, 500))
    return _paragraphs("Your code caused a TIMEOUT (possible infinite loop).", _wrong_code(a), base, f"FIX: Make a MINIMAL one-line change to the original code. Do NOT add loops or recursion.\n{END}")


def _blind(a: Attempt) -> Column:
    return _paragraphs("Your previous attempt was WRONG.", _wrong_code(a), f"Try a DIFFERENT approach. {END}")


#: Builders by strategy; a strategy without one gets generic_compile_feedback.
BUILDERS: dict[str, Callable[[Attempt], Column]] = {name: _compile(name) for name in COMPILE_FORMS} | {"test_feedback": _tests, "simplify_feedback": _simplify}


def feedback(strategy: Column, attempt: Attempt, blind: bool = False, test_facts: bool = True) -> Column:
    """blind: nothing of the outcome, whatever the strategy. test_facts: whether test feedback says what failed."""
    if blind:
        return _blind(attempt)
    built = BUILDERS | ({} if test_facts else {"test_feedback": _tests_unnamed})
    out = None
    for name, build in built.items():
        out = F.when(strategy == name, build(attempt)) if out is None else out.when(strategy == name, build(attempt))
    return out.otherwise(built["generic_compile_feedback"](attempt))


def retry_prompt(prompt: Column, told: Column, attempt_no: Column) -> Column:
    """The prompt without its closing marker, what is told, and the marker."""
    ended = F.regexp_replace(F.regexp_replace(_text(prompt), r"\s+\z", ""), r"\s*##correct\z", "")
    return F.concat(ended, F.lit("\n\n---FEEDBACK (attempt "), attempt_no.cast("string"), F.lit(")---\n"), told, F.lit("\n\n##correct\n"))


def _region(prompt: Column, before: str, after: str, body: Column) -> Column:
    """The first text between before and after replaced; the prompt as it is where they aren't found."""

    def put(p: Column) -> Column:
        start = F.instr(p, F.lit(before)) + len(before)
        stop = F.instr(F.substring(p, start, F.length(p)), F.lit(after))
        whole = F.concat(F.substring(p, F.lit(1), start - 1), body, F.substring(p, start + stop - 1, F.length(p)))
        return F.when((start > len(before)) & (stop > 0), whole).otherwise(p)

    return let(prompt, put)


def prepare_prompt(prompt: Column, plan: Column, base: Column, content: Column, java: bool = True) -> Column:
    """The prompt with its plan filled in and, where content is found in base, its edit region, local context and marked code renewed."""
    filled = F.replace(_text(prompt), F.lit("{{PLAN_JSON}}"), F.coalesce(plan, F.lit("{}")))
    mark, fence = ("  // <--- BUGGY LINE", "```java\n") if java else ("  # <--- BUGGY LINE", "```python\n")

    def renewed(line: Column) -> Column:
        each = lines(base)
        near = F.array_join(F.transform(F.sequence(F.greatest(F.lit(1), line - 1), F.least(F.size(each), line + 1)), lambda i: i.cast("string")), ", ")
        marked = F.array_join(F.transform(each, lambda x, i: F.when(i + 1 == line, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
        out = _region(filled, "BOUNDED EDIT REGION:\n- Prefer edits at/near lines: ", "\n- If you must edit outside, keep within the same function and remain minimal.", near)
        out = _region(out, "LOCAL CONTEXT:\n```text\n", "\n```", local_context(base, line))
        out = _region(out, f"CODE (buggy line is marked with `<--- BUGGY LINE`):\n{fence}", "\n```", marked)
        return F.when(line.isNotNull(), out).otherwise(filled)

    return let(find_line(base, content), renewed)
