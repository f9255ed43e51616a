"""Java text without a parser: bare code, tokens with nesting depth, headers, parameters and symbols, all as column expressions.

Words are those of Unicode, as in (?U). Symbols come as sorted arrays of
distinct names.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywork.functions.text import let

# Words of the language, names that any code may use, and declarations' modifiers and kinds.
KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null"
).split()
COMMON_TYPES = (
    "Object String Class Throwable Exception RuntimeException IllegalArgumentException IllegalStateException UnsupportedOperationException Boolean "
    "Byte Short Integer Long Float Double Number Character Math System Arrays Collections Collection List ArrayList LinkedList Set HashSet Map "
    "HashMap TreeMap Iterator Iterable Comparator StringBuilder StringBuffer Pattern Matcher IOException"
).split()
COMMON_CALLS = "equals hashCode toString valueOf ordinal name length".split()
MODIFIERS = "public protected private static final abstract synchronized native strictfp default".split()
KINDS = "class interface enum record".split()
NO_NAMES = "if for while switch catch return throw new synchronized do else try".split()

# A declaration's parts. A method has a type before its name; a constructor has none, so that statements must be told apart.
_ANNOTATIONS = r"(?:@\w+(?:\([^)]*\))?\s*)*"
_MODIFIERS = rf"(?:(?:{'|'.join(MODIFIERS)})\s+)*"
_NAME = r"[A-Za-z_]\w*"
_GENERIC = r"(?:<[^>{}]+>\s*)?"
_TYPE = r"[A-Za-z_][\w<>\[\],.?&\s]*\s+"
_REST = r"\s*\([^;{}]*\)\s*(?:throws\s+[^{]+)?\s*\{"


def _declaration(group: str) -> str:
    """The pattern without flags; group is ( to capture names, or (?: not to."""
    name = f"{group}{_NAME})"
    kind, method, constructor = rf"(?:{'|'.join(KINDS)})\s+{name}", _GENERIC + _TYPE + name + _REST, rf"(?!(?:{'|'.join(NO_NAMES)})\b){name}{_REST}"
    return rf"^\s*{_ANNOTATIONS}{_MODIFIERS}(?:{kind}|{method}|{constructor})"


#: For Java's regular expressions: lines end at \n alone, words are those of Unicode. PLAIN_DECLARATION is for Python's.
DECLARATION, NAMED_DECLARATION, PLAIN_DECLARATION = f"(?mdU){_declaration('(?:')}", f"(?mdU){_declaration('(')}", f"(?m){_declaration('(?:')}"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def _names(*found: Column) -> Column:
    """Sorted distinct names that are no words of the language."""
    return F.sort_array(F.array_except(F.array_distinct(F.concat(*found)), F.array(*map(F.lit, KEYWORDS))))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def bare(code: Column) -> Column:
    """Code with strings and characters emptied, then without comments."""
    quoted = r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), quoted, '""'), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def balanced(code: Column) -> Column:
    """Whether the brackets of bare code close each other: a stack of what is open, over the brackets alone."""
    opens = lambda b: b.isin("(", "[", "{")
    closed_by = lambda b: F.when(b == "(", ")").when(b == "[", "]").otherwise("}")
    # The stack holds the closing brackets that are due, the next one first; "!" stands for an error and is never due.
    step = lambda due, b: F.when(opens(b), F.concat(closed_by(b), due)).when(F.left(due, F.lit(1)) == b, F.substring(due, F.lit(2), F.length(due))).otherwise(F.concat(F.lit("!"), due))
    return F.aggregate(_all(bare(code), r"[()\[\]{}]", 0), F.lit(""), step) == ""


def _depths(state: Column, token: Column) -> tuple[Column, Column, Column]:
    """Depths inside round, angle and square brackets after a token; none falls below 0."""
    moved = lambda depth, up, down: F.when(token == up, depth + 1).when(token == down, F.greatest(F.lit(0), depth - 1)).otherwise(depth)
    return moved(state["p"], "(", ")"), moved(state["a"], "<", ">"), moved(state["b"], "[", "]")


def top_level(text: Column) -> Column:
    """The parts between commas outside of brackets, stripped, blank ones left out."""
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, token: Column) -> Column:
        p, a, b = _depths(s, token)
        cut = (token == ",") & (s["p"] + s["a"] + s["b"] == 0)
        return F.struct(p.alias("p"), a.alias("a"), b.alias("b"), F.when(cut, "").otherwise(F.concat(s["cur"], token)).alias("cur"), F.when(cut, F.concat(s["parts"], F.array(s["cur"]))).otherwise(s["parts"]).alias("parts"))

    parts = F.aggregate(_all(text, r"[^()<>\[\],]+|[()<>\[\],]", 0), zero, step, lambda s: F.concat(s["parts"], F.array(s["cur"])))
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def header(code: Column) -> Column:
    """The first declaration up to its brace outside of brackets, stripped; empty without one."""
    tail = F.regexp_extract(F.coalesce(code, F.lit("")), rf"({DECLARATION}[\s\S]*)", 1)
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, token: Column) -> Column:
        p, a, b = _depths(s, token)
        done = s["done"] | ((token == "{") & (s["p"] + s["a"] + s["b"] == 0))
        return F.struct(p.alias("p"), a.alias("a"), b.alias("b"), (s["n"] + F.when(done, 0).otherwise(1)).alias("n"), done.alias("done"))

    return let(_all(tail, r"[^()<>\[\]{]+|[()<>\[\]{]", 0), lambda ts: stripped(F.array_join(F.slice(ts, F.lit(1), F.aggregate(ts, zero, step, lambda s: s["n"])), "")))


def declared_name(code: Column) -> Column:
    """The name of the first declaration; empty without one."""
    return F.concat(*[F.regexp_extract(F.coalesce(code, F.lit("")), NAMED_DECLARATION, k) for k in (1, 2, 3)])


def parameters(head: Column) -> Column:
    """What stands between a header's first round bracket and the one that closes it; empty without."""
    tail = F.regexp_extract(F.coalesce(head, F.lit("")), r"(\([\s\S]*)", 1)
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, token: Column) -> Column:
        p = s["p"] + F.when(token == "(", 1).when(token == ")", -1).otherwise(0)
        done = s["done"] | ((token == ")") & (p == 0))
        return F.struct(p.alias("p"), (s["n"] + F.when(done, 0).otherwise(1)).alias("n"), done.alias("done"))

    def inside(ts: Column) -> Column:
        return let(F.aggregate(ts, zero, step), lambda s: F.when(s["done"], F.array_join(F.slice(ts, F.lit(2), s["n"] - 1), "")).otherwise(""))

    return let(_all(tail, r"[^()]+|[()]", 0), lambda ts: F.when(F.size(ts) > 0, inside(ts)).otherwise(""))


def contract(code: Column) -> Column:
    """(header, name, kind, arity, throws) of the first declaration. arity is null for types, and where the header's brackets don't close."""

    def of(x: Column) -> Column:
        head, name = x["header"], x["name"]
        brackets = F.contains(head, F.lit("(")) & F.contains(head, F.lit(")"))
        before = F.split(squeezed(F.substring_index(head, "(", 1)), " ")
        own = (name != "") & (F.element_at(before, -1) == name)
        bare_name = own & ((F.size(before) == 1) | F.coalesce(F.get(before, F.size(before) - 2).isin(*MODIFIERS), F.lit(False)))
        kind = F.coalesce(*[F.when(head.rlike(rf"(?U)\b{k}\b"), k) for k in KINDS], F.when(brackets, F.when(bare_name, "constructor").otherwise("method")), F.lit("unknown"))
        count = let(parameters(head), lambda p: F.when(p != "", F.size(top_level(p))).when(brackets, 0))
        return F.struct(
            head.alias("header"),
            name.alias("name"),
            kind.alias("kind"),
            F.when(kind.isin("method", "constructor"), count).alias("arity"),
            squeezed(F.regexp_extract(head, r"(?U)\bthrows\b\s+([^{}]+)", 1)).alias("throws"),
        )

    return let(F.struct(header(code).alias("header"), declared_name(code).alias("name")), of)


def declarations(code: Column) -> Column:
    """How many declarations a text has."""
    return F.size(_all(code, f"({DECLARATION})"))


def identifiers(code: Column) -> Column:
    """Of the text as it is, comments and strings included."""
    return _names(_all(code, r"(?U)\b([A-Za-z_]\w*)\b"))


def calls(code: Column) -> Column:
    """Names before a round bracket that no dot or word precedes, or that follow this."""
    return let(bare(code), lambda t: _names(_all(t, r"(?U)(?<![\w$.])([a-z_][A-Za-z0-9_$]*)\s*\("), _all(t, r"(?U)\bthis\.([a-z_][A-Za-z0-9_$]*)\s*\(")))


def types(code: Column) -> Column:
    return _names(_all(bare(code), r"(?U)\b([A-Z][A-Za-z0-9_$]*)\b"))


def constants(code: Column) -> Column:
    return _names(_all(bare(code), r"(?U)\b([A-Z][A-Z0-9_]+)\b"))


def lower_names(code: Column) -> Column:
    return F.filter(_names(_all(bare(code), r"(?U)\b([a-z_][A-Za-z0-9_$]*)\b")), lambda x: F.length(x) >= 2)


def parameter_names(head: Column) -> Column:
    """The last lower-case name of each parameter of a header, or of the header in a text without brackets."""
    whole = let(head, lambda h: F.when(F.contains(h, F.lit("(")) & F.contains(h, F.lit(")")), h).otherwise(header(h)))
    last = lambda part: F.element_at(_all(part, r"(?U)\b([a-z_][A-Za-z0-9_$]*)\b"), -1)
    named = F.filter(top_level(parameters(whole)), lambda x: x.rlike(r"(?U)\b[a-z_][A-Za-z0-9_$]*\b"))
    return _names(F.transform(named, last))


def declared_names(code: Column) -> Column:
    """Parameters, variables, and names of loops, catches and lambdas."""
    kind = r"(?:[A-Z][\w$<>\[\],.?&\s]*|boolean|byte|short|int|long|float|double|char)"
    name = r"([a-z_][A-Za-z0-9_$]*)"
    patterns = (
        rf"(?U)\b(?:final\s+)?{kind}\s+{name}\s*(?=[=;,)])",
        rf"(?U)\bfor\s*\(\s*(?:final\s+)?{kind}\s+{name}\s*[:=]",
        rf"(?U)\bcatch\s*\(\s*[A-Z][\w<>\[\],.?&\s|]*\s+{name}\s*\)",
        rf"(?U)\b{name}\s*->",
    )
    listed = lambda t: F.flatten(F.transform(_all(t, r"(?U)\(\s*([a-z_][A-Za-z0-9_$]*(?:\s*,\s*[a-z_][A-Za-z0-9_$]*)*)\s*\)\s*->"), lambda x: _all(x, r"(?U)\b([a-z_][A-Za-z0-9_$]*)\b")))
    return let(bare(code), lambda t: _names(parameter_names(header(t)), listed(t), *[_all(t, p) for p in patterns]))


def _plain(raw: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(raw), r"(?U)^\s*this\.", ""), r"(?U)\(\s*\)$", ""))


def _last_part(plain: Column) -> Column:
    return F.when(F.startswith(plain, F.lit("@")), plain).otherwise(stripped(F.substring_index(plain, ".", -1)))


def symbol(raw: Column) -> Column:
    """A symbol's plain name: without this, empty brackets, and what stands before the last dot; annotations stay."""
    return let(_plain(raw), _last_part)


def symbols(raw: Column) -> Column:
    """Distinct plain names of an array, in order; null gives none."""
    return F.array_distinct(F.filter(F.transform(F.transform(F.coalesce(raw, F.array().cast("array<string>")), _plain), _last_part), lambda x: x != ""))


def labelled(text: Column, *labels: str) -> Column:
    """Symbols listed by commas on a text's lines that begin with a label."""
    given = F.coalesce(text, F.lit(""))
    # Most texts lack most labels: one search saves the split into lines.
    some = let(F.lower(given), lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(p)) for p in labels]))
    clean = F.transform(F.split(given, r"\r\n|\r|\n"), lambda x: stripped(F.regexp_replace(x, r"(?U)^\s*-\s*", "")))
    of = lambda x: F.coalesce(*[F.when(F.startswith(F.lower(x), F.lit(p)), F.substring(x, F.lit(len(p) + 1), F.length(x))) for p in labels])
    lists = F.filter(F.transform(clean, of), lambda x: x.isNotNull())
    listed = symbols(F.flatten(F.transform(lists, lambda x: top_level(F.regexp_replace(x, r"\A[ :]+|[ :]+\z", "")))))
    return F.when(some, listed).otherwise(F.array().cast("array<string>"))
