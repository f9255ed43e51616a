"""Text expressions: tokens, hashes, extensions, log classification and extraction.

All are Column to Column and stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value as a variable of a lambda: written once in the plan and computed once, however often body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def repeat_tokens(tokens: Column, weight: float) -> Column:
    """Whole copies, and a prefix for the fraction (one token at least); empty for weights of 0 or less."""
    whole, fraction = int(max(weight, 0)), max(weight, 0) - int(max(weight, 0))
    copies = F.flatten(F.array_repeat(tokens, whole)) if whole else F.array().cast("array<string>")
    if not fraction:
        return copies
    prefix = F.slice(tokens, 1, F.greatest(F.lit(1), F.floor(F.size(tokens) * fraction).cast("int")))
    return F.concat(copies, F.when(F.size(tokens) > 0, prefix).otherwise(F.array().cast("array<string>")))


def token_jaccard(a: Column, b: Column) -> Column:
    """Of token arrays as sets; 0 if either is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(any_, F.lit(1)))


def file_extension(path: Column) -> Column:
    """The last suffix of the base name, lower-cased, with its dot; empty if there is none."""
    base = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def normalized_hash(code: Column) -> Column:
    """SHA-1 of the code with white space collapsed."""
    return F.sha1(collapse_space(code).cast("binary"))


def short_hash(code: Column) -> Column:
    """The first twelve digits of the SHA-1 of the code as it is."""
    return F.left(F.sha1(F.coalesce(code, F.lit("")).cast("binary")), F.lit(12))


def canonical(code: Column) -> Column:
    """Without what follows a number sign on a line, white space collapsed."""
    return collapse_space(F.regexp_replace(F.coalesce(code, F.lit("")), r"#[^\n]*", ""))


def strip_line_comments(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), r"(?m)\s*//[^\n]*$", "")


def lines(text: Column) -> Column:
    """By any line end, without the empty piece after a last one."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return let(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), cut)


def trim_lines(text: Column, n: int, note: str = "... (truncated)") -> Column:
    """The first n lines, and a note if there are more."""
    each = lines(text)
    return F.when(F.size(each) > n, F.concat(F.array_join(F.slice(each, 1, n), "\n"), F.lit(f"\n{note}"))).otherwise(text)


def truncate(text: Column, limit: int = 4000, suffix: str = "...[truncated]") -> Column:
    """At most limit characters, the suffix among them."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(suffix)), F.lit(suffix))).otherwise(text)


def cut_at_stops(text: Column, stops: Sequence[str]) -> Column:
    """Up to the earliest stop marker."""
    at = [F.when(F.instr(text, F.lit(s)) > 0, F.instr(text, F.lit(s))) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(text)


def outer_json(text: Column) -> Column:
    """From the first opening to the last closing brace; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def first_nonblank_name(**columns: Column) -> Column:
    """The name of the column that first_nonblank takes."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.lit(name)) for name, c in columns.items()])


# Words that queries gain by cues in hints and in code.
HINT_CUES = (
    ("indexerror", ("index", "out", "range", "len", "range", "bounds")),
    ("out of range", ("index", "range", "bounds", "len")),
    ("off-by-one", ("index", "range", "len")),
    ("keyerror", ("dict", "get", "in", "keys")),
    ("typeerror", ("isinstance", "type", "cast")),
    ("valueerror", ("validate", "check", "empty")),
    ("zerodivision", ("divide", "zero", "float")),
    ("none", ("is", "==", "null", "empty")),
    ("empty", ("len", "==", "0")),
    ("boundary", ("min", "max", "clip")),
)
CODE_CUES = (
    ("range(", ("index", "len")),
    ("len(", ("index", "empty")),
    ("[", ("index",)),
    (".get(", ("dict", "key")),
    ("try:", ("except",)),
    ("except", ("try",)),
    ("is None", ("none",)),
    ("== None", ("none",)),
)


def expand_tokens(tokens: Column, hints: Column, line: Column, by_hint: Sequence[tuple[str, Sequence[str]]] = HINT_CUES, by_code: Sequence[tuple[str, Sequence[str]]] = CODE_CUES) -> Column:
    """tokens and the words of every rule whose cue is in the lower-cased hints, or in the line or the joined tokens; distinct, in order."""
    hints, line = F.lower(F.coalesce(hints, F.lit(""))), F.coalesce(line, F.lit(""))
    joined = F.array_join(tokens, " ")
    none = F.array().cast("array<string>")
    words = lambda w: F.array(*[F.lit(x) for x in w])
    added = [F.when(F.contains(hints, F.lit(cue)), words(w)).otherwise(none) for cue, w in by_hint]
    added += [F.when(F.contains(line, F.lit(cue)) | F.contains(joined, F.lit(cue)), words(w)).otherwise(none) for cue, w in by_code]
    return F.array_distinct(F.concat(tokens, *added))


# The phrases by which compile logs fall into families, in order.
FAMILY_PHRASES = (
    ("cannot_find_symbol", ("cannot find symbol",), None),
    (
        "generic_type_mismatch",
        ("inference variable", "is not within its bound", "is not within bounds of type-variable", "does not conform to upper bound"),
        r"incompatible types[:\s][^\n]*<[^>\n]+>",
    ),
    ("method_signature", ("no suitable method found", "cannot be applied to given types", "does not override"), None),
    ("type_mismatch", ("incompatible types",), None),
    ("checked_exception", ("must be caught or declared to be thrown", "unreported exception"), None),
    ("access_control", ("has private access", "has protected access"), None),
    ("package_or_import", (), r"(package|import)\s+.+\s+does not exist"),
    ("syntax_or_parse", ("';' expected", "'}' expected", "reached end of file while parsing", "illegal start of"), None),
)


def compile_error_family(log: Column, generics: bool = True) -> Column:
    """The first family whose phrase or pattern the lower-cased log has. generics: whether there is a family for type parameters."""
    low = F.lower(F.coalesce(log, F.lit("")))
    out = None
    for name, phrases, pattern in FAMILY_PHRASES:
        if name == "generic_type_mismatch" and not generics:
            continue
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | F.contains(low, F.lit(phrase))
        if name == "generic_type_mismatch":
            hit = hit | (F.contains(low, F.lit("type argument ")) & F.contains(low, F.lit("is not within bounds")))
        if pattern:
            hit = hit | low.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other_compile_fail")


# Feedback strategies by family, and of the other outcomes.
STRATEGIES = {
    "syntax_or_parse": "syntax_feedback",
    "cannot_find_symbol": "symbol_feedback",
    "type_mismatch": "type_feedback",
    "generic_type_mismatch": "generic_type_feedback",
    "method_signature": "signature_feedback",
    "checked_exception": "exception_feedback",
    "access_control": "access_feedback",
    "package_or_import": "import_feedback",
    "other_compile_fail": "generic_compile_feedback",
}
STRUCTURAL = ("cannot_find_symbol", "type_mismatch", "generic_type_mismatch", "method_signature")


def feedback_strategy(reason: Column, family: Column) -> Column:
    """By outcome, and for compile failures by family; null for a pass."""
    by_family = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STRATEGIES.items() for x in pair]), family), F.lit("generic_compile_feedback"))
    return (
        F.when(reason == "pass", F.lit(None))
        .when(reason == "timeout", "simplify_feedback")
        .when(reason.isin("test_fail", "test_error"), "test_feedback")
        .when(reason == "compile_fail", by_family)
        .when(reason == "syntax_fail", "syntax_feedback")
        .otherwise("generic_compile_feedback")
    )


def failure_priority(reason: Column, family: Column) -> Column:
    """How near to a pass an outcome is: 3 to 0."""
    return F.when(reason.isin("test_fail", "test_error"), 3).when((reason == "compile_fail") & family.isin(*STRUCTURAL), 2).when(reason.isin("compile_fail", "syntax_fail"), 1).otherwise(0)


def failing_tests(log: Column) -> Column:
    """The first name::case of each line, distinct, in order."""
    found = F.transform(lines(log), lambda x: F.regexp_extract(x, r"([A-Za-z0-9_.$]+::[A-Za-z0-9_.$]+)", 1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


# What useful lines of compiler output and of a test's output have, lower-cased.
COMPILER_WORDS = ("error:", "symbol", "type", "found", "required", "cannot", "expected", "exception")
TEST_WORDS = ("fail", "error", "exception", "assert", "expected", "actual", "caused by", "comparisonfailure", "at ")


def strip(text: Column) -> Column:
    """Without white space at both ends; null gives an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", "")


def _useful(each: Column, words: Sequence[str], n: int) -> Column:
    """The first n of the lines with one of the words, or of all where none has one."""
    has = lambda x: F.lower(x).rlike("|".join(words))
    kept = F.filter(each, has)
    return F.array_join(F.slice(F.when(F.size(kept) > 0, kept).otherwise(each), 1, n), "\n")


def _full_lines(text: Column) -> Column:
    """Lines that aren't blank, without white space at their ends."""
    return F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"\s+\z", "")), lambda x: x != "")


def compiler_lines(log: Column, n: int = 5) -> Column:
    return _useful(lines(strip(log)), COMPILER_WORDS, n)


def test_detail(log: Column, n: int = 18) -> Column:
    return _useful(_full_lines(log), TEST_WORDS, n)


def test_output(log: Column, n: int = 12) -> Column:
    return F.array_join(F.slice(_full_lines(log), 1, n), "\n")


def test_names(names: Column, n: int = 5) -> Column:
    each = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.array_join(F.slice(each, 1, n), "\n")


def short_list(items: Column, n: int = 5, none: str = "(none)") -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.slice(items, 1, n), "\n")).otherwise(none)


def time_tag(name: Column) -> Column:
    """Of the form yyyymmdd_hhmmss in a file's name; empty if there is none."""
    return F.regexp_extract(name, r"(\d{8}_\d{6})", 1)


def label(name: Column, known: dict[str, str]) -> Column:
    """By dictionary, or with underscores as spaces and capitals."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def identifiers(code: Column, reserved: Sequence[str]) -> Column:
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*reserved))


def _numbered(each: Column, first: Column, last: Column, line: Column, mark: str, blank: str) -> Column:
    """Lines first to last, each behind its right-aligned number and a mark."""
    number = lambda k: F.when(k > 9999, k.cast("string")).otherwise(F.lpad(k.cast("string"), 4, " "))
    return F.transform(F.slice(each, first, last - first + 1), lambda x, i: F.concat(number(i + first), F.lit(":"), F.when(i + first == line, mark).otherwise(blank), x))


def numbered_context(text: Column, line: Column, window: int = 3) -> Column:
    """The lines around a 1-based line, numbered, the line itself marked; empty if it isn't there."""

    def of(x: Column) -> Column:
        each, at, n = x["each"], x["at"], F.size(x["each"])
        shown = let(F.greatest(F.lit(1), at - window), lambda first: _numbered(each, first, F.least(n, at + window), at, "-> ", "   "))
        return F.when((at >= 1) & (at <= n), F.array_join(shown, "\n")).otherwise("")

    return let(F.struct(lines(text).alias("each"), line.alias("at")), of)


def local_context(text: Column, line: Column, radius: int = 2, note: str = "... (truncated)") -> Column:
    """As numbered_context, with a note where lines are left out before or behind."""
    some = lambda c: F.when(c, F.array(F.lit(note))).otherwise(F.array().cast("array<string>"))

    def of(x: Column) -> Column:
        each, at = x["each"], x["at"]
        first, last = F.greatest(F.lit(1), at - radius), F.least(F.size(each), at + radius)
        return F.array_join(F.concat(some(first > 1), _numbered(each, first, last, at, "->", "  "), some(last < F.size(each))), "\n")

    return let(F.struct(lines(text).alias("each"), line.alias("at")), of)


def find_line(text: Column, target: Column) -> Column:
    """The 1-based line that equals target, stripped; else without comments; else the first that, without comments, contains it so; null if none."""
    uncommented = lambda x: strip(F.regexp_replace(x, r"\s*//.*$", ""))
    place = lambda each, x: F.nullif(F.array_position(each, x), F.lit(0))

    def loosely(each: Column, short: Column) -> Column:
        within = lambda bare: F.when(short != "", place(F.transform(bare, lambda x: F.contains(x, short)), F.lit(True)))
        return let(F.transform(each, uncommented), lambda bare: F.coalesce(place(bare, short), within(bare)))

    def of(x: Column) -> Column:
        found = F.coalesce(place(x["each"], x["goal"]), let(uncommented(x["goal"]), lambda short: loosely(x["each"], short)))
        return F.when(x["goal"] != "", found).cast("int")

    return let(F.struct(F.transform(lines(text), strip).alias("each"), strip(target).alias("goal")), of)
