"""Candidates: from responses to code, symbols, validity, scores, refill, rescue and pooling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarrywork.functions.java import PLAIN_DECLARATION, declared_name
from quarrywork.functions.text import canonical, let, lines, normalized_hash, strip
from quarrywork.operators import diffs
from quarrywork.operators.code import balanced_end

# The line behind which a response's code stands, and the least length of code.
MARKER, LEAST_CHARS = "##correct", 30


def _between(text: Column, begin: str, end: str) -> Column:
    """The longest text between two marks, stripped, the first of equals; null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is){begin}\s*(.*?)\s*{end}"), F.lit(1))
    longest = F.array_max(F.transform(found, lambda x, i: F.struct(F.length(strip(x)).alias("n"), (-i).alias("i"), strip(x).alias("x"))))
    return F.nullif(longest["x"], F.lit(""))


def marked_code(response: Column, base: Column | None = None) -> Column:
    """The code between a response's marks: with base, first a body, behind the base's header; null without marks."""
    code = _between(response, "@@BEGIN_JAVA_CODE@@", "@@END_JAVA_CODE@@")
    if base is None:
        return code
    head, body = strip(F.regexp_extract(base, r"(?s)\A([^{]*)\{", 1)), _between(response, "@@BEGIN_JAVA_BODY@@", "@@END_JAVA_BODY@@")
    return F.coalesce(F.when(head != "", F.concat(head, F.lit(" {\n"), body, F.lit("\n}"))), code)


def response_code(response: Column, base: Column | None = None) -> Column:
    """(code, problem): behind the marker, what stands between marks, else the first fence or all; up to a heading line. problem names why there is none."""
    marker = rf"^[ \t]*{MARKER}[ \t]*$"
    tail = F.when(response.rlike(f"(?im){marker}"), F.regexp_replace(response, rf"(?ims)\A.*?{marker}", "")).otherwise(response)

    def code_of(tail: Column) -> Column:
        fence = F.regexp_extract(tail, r"(?s)```[A-Za-z]*[ \t]*\n(.*?)```", 1)
        body = F.coalesce(marked_code(tail, base), F.when(fence != "", fence).otherwise(tail))
        return strip(F.replace(F.regexp_replace(body, r"(?ms)^###\s.*\z", ""), F.lit("```"), F.lit("")))

    def judged(code: Column) -> Column:
        problem = (
            F.when(F.trim(F.coalesce(response, F.lit(""))) == "", "empty")
            .when(code == "", "empty_after_trim")
            .when(model_artifact(code), "model_artifact")
            .when(F.length(code) < LEAST_CHARS, "too_short")
            .when(~code.rlike(r"(?m)^\s*(def|class|async\s+def|@)|\w+\s*\([^)]*\)\s*(throws\s+[\w.,\s]+)?\{"), "no_declaration")
        )
        return let(problem, lambda p: F.struct(F.when(p.isNull(), code).alias("code"), p.alias("problem")))

    return let(let(tail, code_of), judged)


def diff_lines_to_code(code: Column) -> Column:
    """Of a text in diff form: without removed lines, hunk heads and added-line signs; other texts as they are."""
    each = lines(code)
    is_diff = F.exists(each, lambda x: x.rlike(r"^(@@|\+\+\+|--- )"))
    kept = F.filter(each, lambda x: ~x.rlike(r"^(-|@@|\+\+\+)"))
    return F.when(is_diff, F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"^[+ ]", "")), "\n")).otherwise(code)


# Scores by the share of changed lines, and what costs a candidate.
_DIFF = ((0.03, 40), (0.12, 30), (0.25, 20), (0.5, 5))
_HINTS = (r"<---\s*buggy line", r"corrected\b", r"fixed(?:\s+line)?\b", r"patched(?:\s+line)?\b")
ARTIFACT_HINT = f"(?i){'|'.join(_HINTS)}"
#: A remark at a line's end: the first hint ends it, after the others anything may follow.
_REMARK = rf"(?:{'|'.join([_HINTS[0], *(f'{h}.*' for h in _HINTS[1:])])})$"
ARTIFACT_TEXT = r"(?i)this is the corrected version|changed line|replace if|buggy line|rest of the code|rest of the function|rest of the method|todo\b"
TRUNCATED = r"(?im)rest of the code|rest of the function|rest of the method|omitted for brevity|^\s*(?://|#|\*)\s*\.\.\.\s*(?:\(|$)|^\s*\.\.\.\s*(?:\(|$)"
BANNED = (r"\.\.\.", r"\braise\s+NotImplementedError\b", r"\bprint\s*\(")
DROP_REASONS = (
    "empty_code",
    "extraction_failed",
    "extraction_failed_empty_after_trim",
    "extraction_failed_no_code_like",
    "extraction_failed_model_artifact",
    "extraction_failed_too_short",
    "extraction_failed_postprocess",
    "introduced_model_artifact",
    "introduced_non_ascii",
    "introduced_java_incompatible_syntax",
    "syntax_fail",
    "no_def_or_class",
    "name_mismatch",
    "java_compile_invalid",
    "no_change",
    "plan_violation",
    "duplicate",
    "other",
)


def length_ratio(base: Column, code: Column) -> Column:
    """Lines of the code to those of the base; 1 for an empty base."""
    return F.when(F.size(lines(base)) == 0, 1.0).otherwise(F.size(lines(code)) / F.greatest(F.size(lines(base)), F.lit(1)))


def model_artifact(code: Column) -> Column:
    """Whether a text isn't code alone: it begins with a language's name, or has a fence, a response's marker, or a place left out."""
    t = F.coalesce(code, F.lit(""))
    return t.rlike(r"(?i)\A\s*(?:java|python)[ \t]*(?:\r?\n|\z)") | F.contains(t, F.lit("```")) | t.rlike(rf"(?im)^[ \t]*{MARKER}\b") | t.rlike(TRUNCATED)


def plain_lines(code: Column, java: bool = True) -> Column:
    """Code without a language's name before it and without comments that tell of a change."""
    named = F.regexp_replace(F.coalesce(code, F.lit("")), r"(?i)\A(?:\s*(?:java|python)[ \t]*\r?\n)+", "")
    opening, mark = (r"(?://+|\*+|/\*+)", "//") if java else ("#", "#")
    kept = F.filter(lines(named), lambda x: ~x.rlike(rf"(?i)^\s*{opening}.*(?:{'|'.join(_HINTS)})"))
    return strip(F.array_join(F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, rf"(?i)\s*{mark}\s*{_REMARK}", ""), r"\s+\z", "")), "\n"))


_HEAD = re.compile(PLAIN_DECLARATION)
_OWN_NAME = re.compile(r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*\(")


def choose_declaration(text: str, name: str, base: str = "") -> str | None:
    """Of a text's Java declarations with balanced braces the first of that name, or else the first; a lone one of another name gets the header of base, if there is one. None without a declaration."""
    found, done = [], 0
    for m in _HEAD.finditer(text):
        end = balanced_end(text, m.start()) if m.start() >= done else None
        if end:
            found.append(text[m.start() : end].strip())
            done = end
    if not found:
        return None
    own = lambda block: next((x or y for x, y in _OWN_NAME.findall(block[: block.index("{") + 1])), "")
    best = next((b for b in found if own(b) == name), found[0])
    if len(found) == 1 and name and own(best) != name and "{" in base:
        body = best[best.index("{") + 1 : -1].strip("\n")
        return f"{base[: base.index('{')].strip()} {{\n{body}\n}}"
    return best


@F.pandas_udf(T.StringType())
def chosen_declaration(text: pd.Series, name: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else choose_declaration(t, n or "", b or "") for t, n, b in zip(text, name, base, strict=True)], dtype=object)


def heuristic_score(code: Column, base: Column, line: Column, name: Column, own_name: Column, parses: Column, context: Column | None = None) -> Column:
    """For ranking only. line: the suspicious one; name and own_name: the expected declaration and the candidate's; context: the lines around the suspicious one."""
    ratio, fraction, length = diffs.similarity(canonical(base), canonical(code)), diffs.change_fraction(base, code), length_ratio(base, code)
    in_base, in_code = (line != "") & F.contains(base, line), F.contains(code, line)
    by_diff = F.when(fraction < 0.005, -500)
    for edge, points in _DIFF:
        by_diff = by_diff.when(fraction <= edge, points)
    by_length = F.when(length.between(0.8, 1.2), 20).when(length.between(0.6, 1.5), 8).when((length < 0.25) | (length > 2.5), -30).otherwise(0)
    cost = lambda when, points: F.when(F.coalesce(when, F.lit(False)), -points).otherwise(0)
    lost = F.lit(False) if context is None else (F.trim(context) != "") & ~F.contains(code, F.trim(context)) & (line != "") & ~in_code
    n = F.size(lines(strip(code)))
    score = (
        100
        + F.when(in_base & in_code, -15).when(in_base, 15).otherwise(0)
        + cost(lost, 10)
        + F.when(name == "", 0).when(name == own_name, 35).otherwise(-120)
        + F.when(base == "", 0).otherwise(F.floor(ratio * 45) + by_diff.otherwise(-10) + by_length)
        + cost(F.contains(code, F.lit("pass")) | F.contains(code, F.lit("...")) | F.contains(code, F.lit("NotImplementedError")), 300)
        + cost(model_artifact(code), 500)
        + cost(code.rlike(ARTIFACT_HINT), 80)
        + sum((cost(code.rlike(p), 80) for p in BANNED), F.lit(0))
        + cost(code.rlike(r"(?m)^\s*(import|from)\s+"), 200)
        + F.when(n <= 2, -30).when(n > 200, -25).otherwise(0)
    )
    return F.when(F.trim(code) == "", -1000).when(~parses, -500).otherwise(score).cast("int")


def introduced(code: Column, base: Column) -> Column:
    """The lines that turn base into code, without literals."""
    return F.regexp_replace(diffs.added_text(base, code), r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""')


def candidate_problem(code: Column, base: Column, name: Column, own_name: Column, java: bool = True) -> Column:
    """The first rule that a candidate breaks: no code, the base but for comments and white space, no declaration, another name; for Java, new lines that tell of a change, leave a place out, or hold a letter outside of ASCII or a diamond. Null for a viable one."""
    first = (
        F.when(strip(code) == "", "empty_code")
        .when(canonical(code) == canonical(base), "no_change")
        .when(F.coalesce(own_name, F.lit("")) == "", "no_def_or_class")
        .when((F.coalesce(name, F.lit("")) != "") & (own_name != name), "name_mismatch")
    )
    if not java:
        return first
    new = lambda x: F.when(x.rlike(ARTIFACT_TEXT) | x.rlike(ARTIFACT_HINT) | x.rlike(TRUNCATED), "introduced_model_artifact").when(x.rlike(r"[^\x00-\x7F]"), "introduced_non_ascii").when(F.contains(x, F.lit("<>")), "introduced_java_incompatible_syntax")
    return F.coalesce(first, let(introduced(code, base), new))


def drop_counts(rows: DataFrame, by: str, reason: str) -> DataFrame:
    """(by, reason, n): dropped candidates by reason, unknown reasons as other; survivors (null) don't count."""
    known = F.when(F.trim(reason).isin(*DROP_REASONS), F.trim(reason)).otherwise("other")
    return rows.filter(F.col(reason).isNotNull()).groupBy(by, known.alias("reason")).agg(F.count("*").alias("n"))


# What a plan violation costs when it fills a gap; rescues scan and keep so many, with so many items and such a share of changed lines.
PENALTY, SCAN, KEEP = 25, 5, 3
RESCUE_ITEMS, RESCUE_FRACTION = 4, 0.40
RESCUE_REASONS = ("new_identifier_reference", "new_type_reference", "new_constant_reference", "new_helper_call")
RESCUE_SOURCES = ("helper_calls", "types", "instance_fields", "method_signature", "context_summary")


def refill(rows: DataFrame, by: str, goal: int, *order: str) -> DataFrame:
    """All candidates (score, violates, change, signature) that keep the plan, and, up to the goal of each group, violators by their score less the penalty. A violator's signature must be new; empty ones always are. Adds fill_score and pick. order breaks what ties are left."""
    best = (F.desc("fill_score"), F.col("change"), F.coalesce("signature", F.lit("")), *order)
    named = F.coalesce("signature", F.lit("")) != ""
    scored = rows.withColumn("fill_score", F.col("score") - F.when(F.col("violates"), PENALTY).otherwise(0))
    of_signature, of_group = W.partitionBy(by, "signature"), W.partitionBy(by)
    marked = scored.withColumns(
        {
            "_kept": F.count_if(~F.col("violates")).over(of_group),
            "_known": F.count_if(~F.col("violates")).over(of_signature) > 0,
            "_first": F.row_number().over(W.partitionBy(by, "signature", "violates").orderBy(*best)) == 1,
        }
    )
    usable = marked.filter(~F.col("violates") | ~named | (~F.col("_known") & F.col("_first")))
    picked = usable.withColumn("pick", F.row_number().over(W.partitionBy(by).orderBy("violates", *best)))
    return picked.filter(~F.col("violates") | (F.col("pick") <= goal)).drop("_kept", "_known", "_first")


def rescue_support(reason: Column, items: Column, sources: Column) -> Column:
    """A map from each item of the one reason to its allowed sources, or null where an item has none or the reason isn't one that names symbols. sources: a map from symbols to lists."""
    allowed = lambda x: F.array_sort(F.array_intersect(F.coalesce(F.try_element_at(sources, x), F.array().cast("array<string>")), F.array(*map(F.lit, RESCUE_SOURCES))))
    entries = F.transform(F.array_distinct(items), lambda x: F.struct(x.alias("symbol"), allowed(x).alias("sources")))
    good = reason.isin(*RESCUE_REASONS[:3]) & (F.size(items) > 0) & (F.size(items) <= RESCUE_ITEMS) & ~F.exists(entries, lambda e: F.size(e["sources"]) == 0)
    return F.when(good, F.map_from_entries(entries))


def carried(fresh: dict[str, Column], held: dict[str, Column], defaults: dict) -> list[Column]:
    """Metadata columns: the fresh value, else the carried one (lists and texts count as missing when empty), else the default."""
    out = []
    for name, default in defaults.items():
        options = [c for c in (fresh.get(name), held.get(name)) if c is not None]
        if isinstance(default, str):
            options = [F.nullif(c, F.lit("")) for c in options]
        elif isinstance(default, list):
            options = [F.when(F.size(c) > 0, c) for c in options]
        last = F.array().cast("array<string>") if isinstance(default, list) else F.lit(default)
        out.append(F.coalesce(*options, last).alias(name))
    return out


def rescue(rows: DataFrame, by: str, order: str = "signature") -> DataFrame:
    """For groups without a survivor (survives): of the best by score that are eligible so many are scanned, of equal signatures the first; empty signatures are all different. Adds pick, with which so many are kept."""
    none = rows.groupBy(by).agg(F.max("survives").alias("any")).filter("NOT any").select(by)
    best = (F.desc("score"), F.coalesce(order, F.lit("")))
    w = W.partitionBy(by).orderBy(*best)
    scanned = rows.filter("eligible").join(none, by, "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SCAN)
    again = F.row_number().over(W.partitionBy(by, "signature").orderBy("_n")) > 1
    fresh = scanned.withColumn("_again", again & (F.coalesce("signature", F.lit("")) != "")).filter("NOT _again")
    return fresh.withColumn("pick", F.row_number().over(W.partitionBy(by).orderBy("_n"))).filter(F.col("pick") <= KEEP).drop("_n", "_again")


def pool(runs: list[DataFrame], by: str, code: str, most: int) -> DataFrame:
    """Candidates of several runs: of equal code the first run's, greedy ones first, then by score (0 counts as none), so many of each group. Adds run and pick."""
    both = runs[0].withColumn("run", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        both = both.unionByName(r.withColumn("run", F.lit(k)))
    key = normalized_hash(F.col(code))
    once = both.withColumn("_n", F.row_number().over(W.partitionBy(by, key).orderBy("run", F.desc("greedy"), F.desc("score"), code))).filter("_n = 1").drop("_n")
    w = W.partitionBy(by).orderBy(~F.col("greedy"), F.coalesce(F.nullif("score", F.lit(0)), F.lit(-1_000_000_000)).desc(), "run", code)
    return once.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= most)


# Lines that say nothing of where a fragment belongs, how comments begin, and the words before a method's name.
WEAK_LINES = ("{", "}", "};", "else", "else {", "} else {", "} else", "break;", "continue;", "return;", "try {", "} catch", "} finally {", "default:", "case :")
_COMMENTS = ("//", "/*", "*")
_METHOD = re.compile(r"(?:public|private|protected|static|final|abstract|synchronized|native|\s)+.*\(")
_QUOTED = re.compile(r"//.*|\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$)")


def _anchors(rows: list[str]) -> list[tuple[int, str]]:
    """The lines that tell a place, by number."""
    bare = ((k, r.strip()) for k, r in enumerate(rows))
    return [(k, r) for k, r in bare if len(r) > 2 and r not in WEAK_LINES and not r.startswith(_COMMENTS)]


def _rise(row: str) -> int:
    """Opening less closing braces of a line, outside of quotes and comments."""
    code = _QUOTED.sub(lambda m: "" if m[0].startswith("//") else '""', row)
    return code.count("{") - code.count("}")


def _indent(rows: list[str]) -> int:
    """Of the first line that isn't blank."""
    return next((len(r) - len(r.lstrip(" \t")) for r in rows if r.lstrip(" \t")), 0)


def merge_fragment(base: str, fragment: str) -> str | None:
    """base with the part that a fragment is of replaced by it; a whole method comes back as it is, None if no line tells the place.

    The part begins where the fragment's first anchor stands in base, less the
    fragment's lines before it, and ends at the last anchor's last place behind
    that, or the first anchor's. From there it grows until its braces rise as
    the fragment's do, or stays if they never do. The fragment moves to the
    part's indent.
    """
    new = fragment.strip().splitlines()
    head = next((r.strip() for r in new if r.strip() and not r.strip().startswith("@")), "")
    if not head or _METHOD.match(head):
        return fragment.strip() or None
    rows, known = base.splitlines(), _anchors(new)
    places = [k for k, r in enumerate(rows) if known and r.strip() == known[0][1]]
    if not places:
        return None
    start = max(0, places[0] - known[0][0])
    last = max((k for k in range(places[0], len(rows)) if rows[k].strip() == known[-1][1]), default=places[0]) + 1
    due, rise = sum(map(_rise, new)), sum(map(_rise, rows[start:last]))
    end = last
    while rise != due and end < len(rows):
        rise += _rise(rows[end])
        end += 1
    end = max(start + 1, end if rise == due else last)
    shift = _indent(rows[start:end]) - _indent(new)
    moved = [r if not r.strip() else " " * shift + r if shift > 0 else r[min(-shift, len(r) - len(r.lstrip(" \t"))) :] for r in new]
    return "\n".join([*rows[:start], *moved, *rows[end:]])


@F.pandas_udf(T.StringType())
def merged(base: pd.Series, fragment: pd.Series) -> pd.Series:
    return pd.Series([merge_fragment(b, f) if b and f else None for b, f in zip(base, fragment, strict=True)])


def admit(rows: DataFrame, by: str, order: str, plan_ok: Column | None = None) -> DataFrame:
    """rows (by, order, response, base, name) with code and reason: why a response isn't admitted, by the first check that it fails; null for survivors.

    Cheap checks come first: extraction, then what candidate_problem names, then
    equal code (but for comments and white space) and equal edits of an earlier
    response that got as far, then the plan.
    """
    found = response_code(F.col("response"), F.col("base"))
    own = declared_name(F.col("code"))
    named = F.when(own != "", own).otherwise(F.regexp_extract("code", r"(?m)^\s*(?:async\s+def|def|class)\s+(\w+)", 1))
    taken = rows.withColumn("_x", found).withColumn("code", F.col("_x.code"))
    failed = F.concat(F.lit("extraction_failed_"), F.col("_x.problem"))
    checked = taken.withColumn("reason", F.coalesce(failed, F.when(F.col("_x.problem").isNull(), candidate_problem(F.col("code"), F.col("base"), F.col("name"), named)))).drop("_x")
    left, out = checked.filter("reason IS NULL"), checked.filter("reason IS NOT NULL")
    first = lambda key: F.row_number().over(W.partitionBy(by, key).orderBy(order)) == 1
    marked = left.withColumn("_first", first(F.sha1(canonical(F.col("code")).cast("binary"))))
    again = marked.filter("NOT _first").drop("_first").withColumn("reason", F.lit("duplicate"))
    signed = marked.filter("_first").drop("_first").withColumn("_s", diffs.patch_signature("base", "code"))
    kept = signed.withColumn("_first", first(F.col("_s"))).withColumn("reason", F.when(~F.col("_first"), "duplicate"))
    if plan_ok is not None:
        kept = kept.withColumn("reason", F.coalesce("reason", F.when(~plan_ok, "plan_violation")))
    return out.unionByName(again).unionByName(kept.drop("_s", "_first"))


def symbol_sources(named: dict[str, list[Column]]) -> Column:
    """A map from every symbol to the sorted names of what supports it. named: by source, arrays of symbols; blanks are left out."""

    def pairs_of(source: str, symbols: Column) -> Column:
        return F.transform(F.coalesce(symbols, F.array().cast("array<string>")), lambda x: F.struct(strip(x).alias("symbol"), F.lit(source).alias("source")))

    pairs = [pairs_of(source, a) for source, arrays in named.items() for a in arrays]
    known = F.array_distinct(F.filter(F.concat(*pairs), lambda p: p["symbol"] != ""))
    symbols = F.array_sort(F.array_distinct(F.transform(known, lambda p: p["symbol"])))
    of = lambda x: F.array_sort(F.transform(F.filter(known, lambda p: p["symbol"] == x), lambda p: p["source"]))
    return F.map_from_entries(F.transform(symbols, lambda x: F.struct(x, of(x))))


def extract_and_merge(response: Column, base: Column) -> Column:
    """A response's code; of a response without a declaration the part between marks, or its first fence, merged into base; null where neither works."""
    part = F.coalesce(marked_code(response), F.regexp_extract(response, r"(?s)```\w*[ \t]*\n(.*?)```", 1))
    fragment = strip(F.regexp_replace(F.regexp_replace(strip(part), r"\A```\w*\s*\n?", ""), r"\n?```\s*\z", ""))
    return F.coalesce(response_code(response, base)["code"], merged(base, F.nullif(fragment, F.lit(""))))


def dispatch(inputs: DataFrame, prompts: DataFrame, key: str, runs: DataFrame) -> DataFrame:
    """Inputs (key, code) with their prompt rows and base (the prompt's function, else the input's code) for each row of runs, a few settings; inputs without a base are left out."""
    both = inputs.join(prompts, key, "left").withColumn("base", F.coalesce(F.nullif("function_before", F.lit("")), F.col("code")))
    return both.filter(strip(F.col("base")) != "").join(F.broadcast(runs), how="cross")
