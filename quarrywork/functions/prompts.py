"""Prompt text from records: sections, summaries, feedback, run settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrywork.functions.text import lines, strip


def sections(*named: tuple[str, Column]) -> Column:
    """Titled sections with an empty line between; those without text are left out."""
    parts = F.array(*[F.when(F.trim(F.coalesce(body, F.lit(""))) != "", F.concat(F.lit(f"## {title}\n"), body)) for title, body in named])
    return F.array_join(F.array_compact(parts), "\n\n")


def reason(kind: Column, distance: Column, overlap: Column, hints: Column) -> Column:
    """type; dist; up to 6 shared names; up to 4 hints."""
    part = lambda name, items, n: F.when(F.size(items) > 0, F.concat(F.lit(f"{name}="), F.array_join(F.slice(items, 1, n), ",")))
    return F.concat_ws("; ", F.concat(F.lit("type="), kind), F.when(distance.isNotNull(), F.concat(F.lit("dist="), distance.cast("string"))), part("overlap", overlap, 6), part("hints", hints, 4))


def mark_line(text: Column, line: Column, content: Column | None = None, mark: str = "  // <--- BUGGY LINE") -> Column:
    """The text with a mark behind one line: the one of that number, or, where there is none, the first that equals content, stripped, or else contains it. A marked line stays."""
    each = F.split(text, "\n")
    at = F.when((line >= 1) & (line <= F.size(each)), line)
    if content is not None:
        goal = strip(content)
        place = lambda test: F.nullif(F.array_position(F.transform(each, test), F.lit(True)), F.lit(0))
        at = F.coalesce(at, F.when(goal != "", F.coalesce(place(lambda x: strip(x) == goal), place(lambda x: F.contains(x, goal)))))
    marked = F.transform(each, lambda x, i: F.when((i + 1 == at) & ~F.contains(x, F.lit("<--- BUGGY LINE")), F.concat(x, F.lit(mark))).otherwise(x))
    return F.array_join(marked, "\n")


# Frames with one of these say nothing of the code under test.
NOISE = ("junit.framework", "org.apache.tools.ant", "jdk.internal.reflect", "java.base/", "java.lang.reflect", "sun.reflect")


def first_failure(log: Column, frames: int = 3) -> Column:
    """(test, message, frames) of the first block that a line of dashes and a name opens: the first line that is no frame, and the first frames without noise, or any where all are noise. Null without a block."""
    each = F.transform(lines(log), lambda x: F.regexp_replace(x, r"\s+\z", ""))
    heads = F.filter(F.transform(each, lambda x, i: F.when(F.startswith(x, F.lit("--- ")), i + 1)), lambda i: i.isNotNull())
    start, stop = F.get(heads, F.lit(0)), F.coalesce(F.get(heads, F.lit(1)), F.size(each) + 1)
    rows = F.filter(F.transform(F.slice(each, start, stop - start), strip), lambda x: x != "")
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    all_frames = F.filter(body, lambda x: F.startswith(x, F.lit("at ")))
    own = F.filter(all_frames, lambda x: ~F.lower(x).rlike("|".join(t.replace(".", r"\.") for t in NOISE)))
    message = F.get(F.filter(body, lambda x: ~F.startswith(x, F.lit("at "))), F.lit(0))
    test = strip(F.substring(F.get(rows, F.lit(0)), 5, 1_000_000))
    return F.when(start.isNotNull(), F.struct(test.alias("test"), F.coalesce(message, F.lit("")).alias("message"), F.slice(F.when(F.size(own) > 0, own).otherwise(all_frames), 1, frames).alias("frames")))


# The sampling settings of the three runs of a preset.
PRESETS = (
    {"tag": "A", "seed": 0, "temperature": 0.70, "top_p": 0.95, "presence_penalty": 0.0},
    {"tag": "B", "seed": 1, "temperature": 0.90, "top_p": 0.90, "presence_penalty": 0.2},
    {"tag": "C", "seed": 2, "temperature": 1.05, "top_p": 0.85, "presence_penalty": 0.4},
)


def run_settings(text: Column) -> Column:
    """A map of key=value items, keys lower-cased, the last of a key; the first bare item is the tag, unless a key says it."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^=]*=", "")).alias("v"))
    pairs = F.transform(F.filter(items, lambda x: F.contains(x, F.lit("="))), pair)
    bare = F.get(F.filter(items, lambda x: ~F.contains(x, F.lit("="))), F.lit(0))
    tagged = F.when(bare.isNotNull() & ~F.exists(pairs, lambda p: p["k"] == "tag"), F.concat(pairs, F.array(F.struct(F.lit("tag").alias("k"), bare.alias("v"))))).otherwise(pairs)
    last = F.filter(tagged, lambda p, i: ~F.exists(F.slice(tagged, i + 2, 1_000_000), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def preset_runs(base_seed: int = 42) -> list[dict]:
    """The settings of a preset's runs, seeds counted from base_seed."""
    return [{**p, "seed": base_seed + p["seed"]} for p in PRESETS]


def setting(*choices: Column) -> Column:
    """The first that is set and isn't blank: explicit, then row, then requested, then default."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in choices])


# Repair branches by language, the default first.
BRANCHES = {"java": ("java_base", "java_semantic", "java_v2"), "python": ("python_base",)}


def repair_branch(requested: Column, row: Column, language: Column, explicit: bool = False) -> Column:
    """(effective, source) of a repair branch: for Java an explicit request goes before the row's, the row's before another request; what the language doesn't have is left out."""

    def of(name: str) -> Column:
        known = BRANCHES[name]
        has = lambda c: F.lower(F.trim(c)).isin(*known)
        take = lambda c, source: F.struct(F.lower(F.trim(c)).alias("effective"), F.lit(source).alias("source"))
        by_request = "cli" if explicit else "auto"
        first = F.when(has(requested), take(requested, "cli")) if explicit and name == "java" else F.lit(None)
        return F.coalesce(first, F.when(has(row), take(row, "row")), F.when(has(requested), take(requested, by_request)), take(F.lit(known[0]), "auto"))

    return F.when(F.lower(F.trim(language)) == "java", of("java")).otherwise(of("python"))


def edit_mode(mode: Column, single: Column, conservative_java: Column) -> Column:
    """single or hard: as the row says, else by whether it is a single line (if known), else single for conservative Java, else hard."""
    said = F.lower(F.trim(mode))
    return F.when(said.isin("single", "hard"), said).when(single.isNotNull(), F.when(single, "single").otherwise("hard")).when(conservative_java, "single").otherwise("hard")


def local_line(line: Column, start: Column, n_lines: Column, absolute_first: bool = True) -> Column:
    """A line counted from a function's first one, whether it came absolute or already so; null if it lies in neither range. absolute_first: which of the two is tried first."""
    absolute, own = F.when((line >= start) & (line < start + n_lines), line - start + 1), F.when((line >= 1) & (line <= n_lines), line)
    return F.coalesce(absolute, own) if absolute_first else F.coalesce(own, absolute)


def profile(mode: Column, level: Column, cost_aware: bool = True) -> Column:
    """HARD for hard edits or low retrieval confidence, EASY for high, MED between; of a scheduler that isn't cost-aware, HARD for hard edits, MED for others."""
    hard = F.coalesce(F.lower(F.trim(mode)) == "hard", F.lit(False))
    if not cost_aware:
        return F.when(hard, "HARD").otherwise("MED")
    return F.when(hard | F.coalesce(level == "low", F.lit(False)), "HARD").when(level == "high", "EASY").otherwise("MED")


def profile_target(profile: Column, target: int, easy: int = 12, med: int = 30, hard: int | None = None) -> Column:
    """How many candidates a profile asks for: its own goal, at most the common one, at least 1."""
    goal = lambda n: max(1, min(target, max(1, n)))
    return F.when(profile == "EASY", goal(easy)).when(profile == "MED", goal(med)).otherwise(goal(target if hard is None else hard))


def node_summary(nodes: Column, language: Column, most: int = 5) -> Column:
    """The first nodes (line, type, distance, contains, names, hints, code, context) as a numbered list."""
    some = lambda items: F.coalesce(F.size(items), F.lit(0)) > 0
    text = lambda x: F.coalesce(x.cast("string"), F.lit("N/A"))

    def one(n: Column, i: Column) -> Column:
        shown = F.when(strip(n["context"]) != "", F.concat(F.lit("```text\n"), strip(n["context"]), F.lit("\n```"))).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), strip(n["code"]), F.lit("\n```")))
        head = F.concat((i + 1).cast("string"), F.lit(". Line "), text(n["line"]), F.lit(" ("), text(n["type"]), F.lit(", dist: "), text(n["distance"]), F.lit(")"))
        rows = F.array(
            head,
            F.when(n["contains"], "   - Contains buggy line"),
            F.when(some(n["names"]), F.concat(F.lit("   - Ids: "), F.array_join(F.slice(n["names"], 1, 6), ", "))),
            F.when(some(n["hints"]), F.concat(F.lit("   - Hints: "), F.array_join(n["hints"], ", "))),
            F.concat(F.lit("   - Code:\n"), shown),
        )
        return F.array_join(F.array_compact(rows), "\n")

    return F.array_join(F.transform(F.slice(nodes, 1, most), one), "\n")


def neighbour_summary(top: Column, most: int = 2) -> Column:
    """The first neighbours (id, project, score, file, line) as a numbered list."""
    text = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("N/A"))

    def one(n: Column, i: Column) -> Column:
        score = F.when(n["score"].isNotNull(), F.format_string("%.3f", n["score"])).otherwise("N/A")
        head = F.concat((i + 1).cast("string"), F.lit(". "), text(n["id"]), F.lit(" | "), text(n["project"]), F.lit(" | score "), score)
        more = [F.when(F.coalesce(n[c], F.lit("")) != "", F.concat(F.lit(f"   - {title}: "), n[c])) for c, title in (("file", "file"), ("line", "buggy_line"))]
        return F.array_join(F.array_compact(F.array(head, *more)), "\n")

    return F.array_join(F.transform(F.slice(top, 1, most), one), "\n")


def bound_lines(line: Column, nodes: Column, start: Column, n_lines: Column, most: int = 10) -> Column:
    """The lines of a bug and its first five nodes, local ones, sorted, each once."""
    every = F.concat(F.array(line), F.transform(F.slice(nodes, 1, 5), lambda n: n["line"]))
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.transform(every, lambda x: local_line(x, start, n_lines, absolute_first=False))))), 1, most)


def default_plan(line: Column, n_lines: Column, mode: Column) -> Column:
    """(start, end, budget): two lines around and 6 changes for single edits, six and 25 otherwise."""
    by = F.when(mode == "single", 2).otherwise(6)
    return F.struct(F.greatest(F.lit(1), line - by).alias("start"), F.least(n_lines, line + by).alias("end"), F.when(mode == "single", 6).otherwise(25).alias("budget"))


def unknown_symbols(new: Column, *allowed: Column) -> Column:
    """Symbols of a candidate that no allowed set has."""
    known = allowed[0]
    for a in allowed[1:]:
        known = F.array_union(known, a)
    return F.array_except(new, known)


def drop_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first failed check, cheap ones first; null for a survivor."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])
