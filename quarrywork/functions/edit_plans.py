"""Edit plans and edit ranges: validation, clamping, widening, overlap and volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What an edit may be, in the order in which plans list them.
EDIT_TYPES = ("REPLACE", "INSERT", "DELETE")
RANGES = "array<struct<start:int,end:int>>"


def plan_problem(targets: Column, budget: Column, allowed: Column) -> Column:
    """Why a plan isn't valid, by its first problem; null if it is. targets: (start, end) ranges."""
    bad = lambda t: F.coalesce(t["start"].isNull() | t["end"].isNull() | (t["start"] < 1) | (t["end"] < t["start"]), F.lit(True))
    known = lambda x: F.upper(F.trim(x)).isin(*EDIT_TYPES)
    return (
        F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, "no_targets")
        .when(F.exists(targets, bad), "bad_range")
        .when(F.coalesce(budget, F.lit(0)) < 1, "bad_budget")
        .when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, "no_types")
        .when(F.exists(allowed, lambda x: ~F.coalesce(known(x), F.lit(False))), "bad_type")
    )


def clamp_range(start: Column, end: Column, n_lines: Column) -> Column:
    """(start, end) inside 1 to n_lines, in order."""
    inside = lambda x: F.greatest(F.lit(1), F.least(x, F.greatest(n_lines, F.lit(1))))
    a, b = inside(start), inside(end)
    return F.struct(F.least(a, b).cast("int").alias("start"), F.greatest(a, b).cast("int").alias("end"))


def _span(t: Column) -> Column:
    return F.greatest(F.lit(1), t["end"] - t["start"] + 1)


def postprocess_plan(targets: Column, budget: Column, allowed: Column, single: Column, conservative: Column, n_lines: Column) -> Column:
    """(targets, budget, allowed, notes): a plan made wide enough to be useful, and notes on what was changed.

    Ranges are clamped. A single edit may insert, a hard one insert and delete;
    budgets rise to 6 and 12 lines (4 and 6 if conservative). Single edits that
    span under 7 lines on average (4) grow by 2 lines a side (1); the ranges of
    hard ones, unless conservative, grow to 15 lines.
    """
    none = F.array().cast("array<string>")
    note = lambda when, text: F.when(when, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(none)
    number = lambda x: F.coalesce(F.nullif(x, F.lit(0)), F.lit(1))
    clamped = F.transform(targets, lambda t: clamp_range(number(t["start"]), number(t["end"]), n_lines))
    clamped = F.when(F.coalesce(F.size(targets), F.lit(0)) > 0, clamped).otherwise(F.array(clamp_range(F.lit(1), F.lit(1), n_lines)).cast(RANGES))
    upper = F.transform(F.coalesce(allowed, none), lambda x: F.upper(F.trim(x)))
    inserts, deletes = F.array_contains(upper, "INSERT"), F.array_contains(upper, "DELETE")
    extra = lambda keep, name: F.when(keep, F.array(F.lit(name))).otherwise(none)
    types = F.concat(F.array(F.lit("REPLACE"), F.lit("INSERT")), extra(deletes | ~single, "DELETE"))
    at_least = F.when(single, F.when(conservative, 4).otherwise(6)).otherwise(F.when(conservative, 6).otherwise(12))
    asked = F.greatest(F.lit(1), number(budget))
    average = F.aggregate(clamped, F.lit(0.0), lambda s, t: s + _span(t)) / F.size(clamped)
    narrow = single & (average < F.when(conservative, 4.0).otherwise(7.0))
    by = F.when(conservative, 1).otherwise(2)
    need = lambda t: F.greatest(F.lit(0), 15 - _span(t))
    grown = F.transform(clamped, lambda t: clamp_range(t["start"] - F.floor(need(t) / 2), t["end"] + F.ceil(need(t) / 2), n_lines))
    wide = F.transform(clamped, lambda t: clamp_range(t["start"] - by, t["end"] + by, n_lines))
    hard = ~single & ~conservative
    notes = F.concat(
        note(F.coalesce(budget < 1, F.lit(False)) & (budget != 0), "raised_changed_lines_max_to_1"),
        note(~inserts, "added_INSERT"),
        note(~single & ~deletes, "added_DELETE"),
        note(asked < at_least, F.concat(F.lit("raised_changed_lines_max_to_"), at_least.cast("string"))),
        note(narrow, F.concat(F.lit("widened_target_by_"), by.cast("string"))),
        note(hard & (grown != clamped), "widened_target_to_min_span_15"),
    )
    return F.struct(F.when(narrow, wide).when(hard, grown).otherwise(clamped).alias("targets"), F.greatest(asked, at_least).alias("budget"), types.alias("allowed"), notes.alias("notes"))


# Lines by which targets, and the budget, of a lenient check grow.
TARGET_SLACK, BUDGET_SLACK = 2, 3


def plan_violations(targets: Column, budget: Column, allowed: Column, edits: Column, n_lines: Column, lenient: bool = False, contain: bool = False) -> Column:
    """Distinct violations of a valid plan by edits (op, start, end, new_lines), in order: types that aren't allowed, edits outside of every target, too many changed lines. An insertion is inside if its line or the one before is."""
    slack, room = (TARGET_SLACK, BUDGET_SLACK) if lenient else (0, 0)
    inside_text = lambda x: F.greatest(F.lit(1), F.least(x, F.greatest(n_lines, F.lit(1))))
    first = lambda t: F.greatest(F.lit(1), t["start"] - slack)
    last = lambda t: F.when(n_lines > 0, F.greatest(F.lit(1), F.least(n_lines, t["end"] + slack))).otherwise(t["end"] + slack)
    holds = lambda x: F.exists(targets, lambda t: (first(t) <= x) & (x <= last(t)))

    def of(e: Column) -> Column:
        op, a = F.upper(e["op"]), inside_text(e["start"])
        b = F.greatest(a, inside_text(e["end"]))
        met = F.exists(targets, lambda t: ((a >= first(t)) & (b <= last(t))) if contain else ((b >= first(t)) & (a <= last(t))))
        outside = F.when(op == "INSERT", F.when(~(holds(a) | holds(inside_text(a - 1))), F.concat(F.lit("out_of_target:INSERT@"), e["start"].cast("string"))))
        outside = F.coalesce(outside, F.when((op != "INSERT") & ~met, F.concat(F.lit("out_of_target:"), op, F.lit("@"), a.cast("string"), F.lit("-"), b.cast("string"))))
        return F.array_compact(F.array(F.when(~F.array_contains(allowed, op), F.concat(F.lit("edit_type_not_allowed:"), op)), outside))

    n = changed_lines(edits)
    over = F.when(n > budget + room, F.array(F.concat(F.lit("changed_lines_max_exceeded:"), n.cast("string"), F.lit(">"), (budget + room).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.flatten(F.transform(edits, of)), over))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, slack: int = 0) -> Column:
    return (a_start <= b_end + slack) & (a_end >= b_start - slack)


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column, slack: int = 0) -> Column:
    return (start >= outer_start - slack) & (end <= outer_end + slack)


def changed_lines(edits: Column) -> Column:
    """Of an array of (op, start, end, new_lines): new lines of an insertion, base lines of the others, one each at least."""
    one = lambda e: F.greatest(F.lit(1), F.when(e["op"] == "INSERT", e["new_lines"]).otherwise(e["end"] - e["start"] + 1))
    return F.aggregate(edits, F.lit(0), lambda n, e: n + one(e).cast("int"))


def mean_distance(edits: Column, line: Column) -> Column:
    """The mean distance of the edits' midpoints to a line; null without edits."""
    total = F.aggregate(edits, F.lit(0.0), lambda s, e: s + F.abs((e["start"] + e["end"]) / 2.0 - line))
    return F.when(F.size(edits) > 0, total / F.size(edits))
