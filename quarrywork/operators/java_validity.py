"""Whether a Java candidate may compile: what it refers to anew, reasons hard and soft, the rerank by features, and rescues.

All stages are columns beside each other: analysed() adds the edits, the
declarations' contracts, what the context allows and the drift; judged() and
reranked() read them. The matcher of lines is the one Python function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywork.functions import java
from quarrywork.functions.edit_plans import mean_distance
from quarrywork.functions.text import let, lines
from quarrywork.operators import candidates, diffs

# Labels of a context's lists; shares of changed lines that make a rewrite broad, without and with a plan that is kept.
FIELD_LABELS = ("referenced instance fields",)
CALL_LABELS = ("referenced helper methods in this method",)
TYPE_LABELS = ("types referenced in this method", "referenced types in this method")
SEVERE, MODERATE = 0.60, 0.45
REFERENCES = {"new_helper_call": "new_calls", "new_type_reference": "new_types", "new_constant_reference": "new_constants", "new_identifier_reference": "new_identifiers"}
#: What may be known of a candidate's context, and its type; missing columns count as null.
CONTEXT = {"name": "string", "summary": "string", "signature": "string", "prompt": "string", "helper_calls": "array<string>", "type_names": "array<string>", "fields": "array<string>", "bug_line": "int", "plan_ok": "boolean", "violations": "int", "filled": "boolean"}


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _pairs(names: Column, source: str) -> Column:
    return F.transform(java.symbols(names), lambda x: F.struct(x.alias("symbol"), F.lit(source).alias("source")))


def _less(names: Column, *taken: Column) -> Column:
    for t in taken:
        names = F.array_except(names, t)
    return F.array_sort(names)


def _each(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: p["symbol"])


def allowed(rescue: bool = False) -> Column:
    """What a patch of base may refer to: calls, types, fields, constants, identifiers, and support, the pairs of a symbol and what supports it. In a rescue, what the prompt lists counts too."""
    listed = lambda text, labels: java.labelled(F.col(text), *labels)
    more = lambda pairs: pairs if rescue else []
    calls = F.concat(_pairs(java.calls("base"), "helper_calls"), _pairs(F.col("helper_calls"), "helper_calls"), _pairs(listed("summary", CALL_LABELS), "context_summary"), *more([_pairs(listed("prompt", CALL_LABELS), "helper_calls")]))
    types = F.concat(_pairs(java.types("base"), "types"), _pairs(F.col("type_names"), "types"), _pairs(java.types("signature"), "method_signature"), _pairs(listed("summary", TYPE_LABELS), "context_summary"), *more([_pairs(listed("prompt", TYPE_LABELS), "types")]))
    own = F.regexp_extract_all(F.coalesce("base", F.lit("")), F.lit(r"(?U)\bthis\.([A-Za-z_$][A-Za-z0-9_$]*)\b"), F.lit(1))
    fields = F.concat(_pairs(own, "instance_fields"), _pairs(F.col("fields"), "instance_fields"), _pairs(listed("summary", FIELD_LABELS), "context_summary"), *more([_pairs(listed("prompt", FIELD_LABELS), "instance_fields")]))
    constants = F.concat(_pairs(java.constants("summary"), "context_summary"), *more([_pairs(java.constants("prompt"), "context_summary")]))
    others = F.concat(_pairs(java.parameter_names(F.coalesce("signature", F.lit(""))), "method_signature"), _pairs(java.lower_names("summary"), "context_summary"))

    def of(x: Column) -> Column:
        known = {"calls": F.array_distinct(_each(x["calls"])), "types": F.array_union(_each(x["types"]), _strings(*java.COMMON_TYPES)), "fields": F.array_distinct(_each(x["fields"])), "constants": F.array_union(_each(x["constants"]), java.constants("base"))}
        names = F.array_distinct(F.concat(_each(x["others"]), java.lower_names("base"), java.declared_names("base"), java.parameter_names(F.coalesce("base", F.lit(""))), java.lower_names("signature"), *known.values()))
        support = F.array_distinct(F.concat(*[x[k] for k in ("calls", "types", "fields", "constants", "others")]))
        return F.struct(*[v.alias(k) for k, v in known.items()], names.alias("identifiers"), support.alias("support"))

    return let(F.struct(calls.alias("calls"), types.alias("types"), fields.alias("fields"), constants.alias("constants"), others.alias("others")), of)


def supports(names: Column, support: Column) -> Column:
    """A map from each of these symbols that anything supports to the sorted sources."""
    entry = lambda n: F.struct(n.alias("symbol"), F.array_sort(F.array_distinct(F.transform(F.filter(support, lambda p: p["symbol"] == n), lambda p: p["source"]))).alias("sources"))
    return F.map_from_entries(F.filter(F.transform(names, entry), lambda e: F.size(e["sources"]) > 0))


def _changed(edits: Column) -> tuple[Column, Column]:
    """The changed lines of the base and those of the code, stripped by edit."""
    old = F.transform(edits, lambda e: F.when(e["op"] != "INSERT", java.stripped(F.array_join(F.slice(lines(F.col("base")), e["start"], e["end"] - e["start"] + 1), "\n"))).otherwise(""))
    new = F.transform(edits, lambda e: e["text"])
    kept = lambda parts: F.array_join(F.filter(parts, lambda x: x != ""), "\n")
    return kept(old), kept(new)


def _drift(old: Column, new: Column) -> Column:
    """What the changed lines refer to anew, allowed or not."""
    known = F.col("allowed")
    name = F.array(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("base_decl.name")))
    added = {k: F.array_except(f(new), f(old)) for k, f in (("calls", java.calls), ("types", java.types), ("constants", java.constants), ("identifiers", java.lower_names))}
    declared = java.symbols(java.declared_names(new))

    def of(x: Column) -> Column:
        calls = _less(x["calls"], known["calls"], x["declared"], _strings(*java.COMMON_CALLS), name)
        both = F.array_union(known["constants"], known["types"])
        heads = [java.squeezed(F.col(f"{c}.header")) for c in ("base_decl", "decl")]
        return F.struct(
            calls.alias("new_calls"),
            _less(x["types"], known["types"]).alias("new_types"),
            _less(x["constants"], both).alias("new_constants"),
            _less(x["identifiers"], known["identifiers"], x["declared"], calls, name).alias("new_identifiers"),
            ((heads[0] != "") & (heads[1] != "") & (heads[0] != heads[1])).alias("signature_drift"),
            F.array_sort(F.array_intersect(x["types"], known["types"])).alias("supported_types"),
            F.array_sort(F.array_intersect(x["constants"], both)).alias("supported_constants"),
            F.array_sort(F.array_intersect(x["identifiers"], F.array_union(known["identifiers"], name))).alias("supported_identifiers"),
            F.array_sort(x["declared"]).alias("declared"),
        )

    return let(F.struct(*[v.alias(k) for k, v in added.items()], declared.alias("declared")), of)


def analysed(rows: DataFrame, rescue: bool = False) -> DataFrame:
    """rows (base, code, and what there is of CONTEXT) with edits, fraction, base_decl, decl, allowed and drift."""
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, kind in CONTEXT.items() if c not in rows.columns})
    seen = rows.withColumn("edits", diffs.edits_once("base", "code"))
    moved = F.aggregate("edits", F.lit(0), lambda n, e: n + F.greatest(F.when(e["op"] == "INSERT", 0).otherwise(e["end"] - e["start"] + 1), e["new_lines"]))
    old, new = _changed(F.col("edits"))
    n = F.size(lines(F.col("base")))
    seen = seen.withColumns({"fraction": F.when(n == 0, 1.0).otherwise(moved / n), "base_decl": java.contract(F.col("base")), "decl": java.contract(F.col("code")), "allowed": allowed(rescue), "_old": old, "_new": new})
    return seen.withColumn("drift", _drift(F.col("_old"), F.col("_new"))).drop("_old", "_new")


def compile_problem() -> Column:
    """What a look at the structure finds: the first of five problems; null if none."""
    code = java.stripped(F.coalesce("code", F.lit("")))
    n, base = F.size(lines(code)), F.size(lines(java.stripped(F.coalesce("base", F.lit("")))))
    packed = F.replace(java.bare(code), F.lit(" "), F.lit(""))
    doubled = F.exists(F.split(packed, "\n"), lambda x: F.contains(x, F.lit(";;")) & ~F.contains(x, F.lit("for")))
    return (
        F.when(code == "", "empty_code")
        .when(~java.balanced(code), "unbalanced_delimiters")
        .when(java.declarations(code) == 0, "no_java_declaration")
        .when((base > 5) & (n < F.greatest(F.lit(3), F.floor(base / 4))), "suspiciously_short")
        .when(java.declarations(code) > java.declarations(F.col("base")) + 2, "too_many_declarations")
        .when(doubled, "double_semicolon")
    )


def _broad(plan_ok: Column) -> tuple[Column, Column]:
    return F.col("fraction") > SEVERE, (F.col("fraction") > MODERATE) & ~plan_ok


def risk_combinations(plan_ok: Column) -> Column:
    """(detail, reasons) of each combination of soft reasons that makes them hard."""
    found = {r: F.size(f"drift.{c}") for r, c in REFERENCES.items()}
    present = F.array_compact(F.array(*[F.when(n > 0, r) for r, n in found.items()]))
    severe, moderate = _broad(plan_ok)
    broad = F.concat(_strings("broad_rewrite"), present)
    pair = lambda a, b: (found[a] > 0) & (found[b] > 0) & ~plan_ok
    cases = (
        ("broad_rewrite_severe+new_refs", severe & (F.size(present) >= 2), broad),
        ("broad_rewrite_moderate+new_ref_categories_ge_3", moderate & (F.size(present) >= 3), broad),
        ("new_ref_total_ge_4", sum(found.values(), F.lit(0)) >= 4, present),
        ("type_plus_identifier", pair("new_type_reference", "new_identifier_reference"), _strings("new_type_reference", "new_identifier_reference")),
        ("constant_plus_identifier_without_plan_ok", pair("new_constant_reference", "new_identifier_reference"), _strings("new_constant_reference", "new_identifier_reference")),
    )
    return F.array_compact(F.array(*[F.when(when, F.struct(F.lit(detail).alias("detail"), reasons.alias("reasons"))) for detail, when, reasons in cases]))


def judged(rows: DataFrame, filtering: bool = False, promote: bool = False) -> DataFrame:
    """analysed rows with reasons (of rollups.VALIDITY_REASONS), hard_reasons, combinations, valid and compile_problem.

    filtering: a changed header is a hard reason. promote: soft reasons in a risky combination become hard ones.
    """
    plan_ok = F.coalesce("plan_ok", F.lit(True))
    base, new = F.col("base_decl"), F.col("decl")
    callable_ = lambda d: d["kind"].isin("method", "constructor")
    named = F.coalesce("name", F.lit(""))
    introduced = F.array_join(F.filter(F.transform("edits", lambda e: e["text"]), lambda x: x != ""), "\n")
    plain = F.regexp_replace(introduced, r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'', '""')
    tells = plain.rlike(candidates.ARTIFACT_TEXT) | plain.rlike(candidates.ARTIFACT_HINT) | plain.rlike(candidates.TRUNCATED) | plain.rlike(r"[^\x00-\x7F]") | F.contains(plain, F.lit("<>"))
    before = F.regexp_extract(F.col("code"), rf"\A([\s\S]*?){java.DECLARATION}", 1)
    prefix = F.when(F.col("decl.header") == "", F.col("code")).otherwise(before)
    severe, moderate = _broad(plan_ok)
    checks = (
        ("model_artifact", candidates.model_artifact(java.stripped(F.col("code"))) | tells, True),
        ("unbalanced_delimiters", ~java.balanced(F.col("code")), True),
        ("decl_kind_mismatch", (base["kind"] != "unknown") & (new["kind"] != "unknown") & (base["kind"] != new["kind"]), True),
        ("signature_mismatch", (callable_(base) & callable_(new) & (base["arity"] != new["arity"])) | ((named != "") & (new["name"] != "") & (new["name"] != named)), True),
        ("wrapper_mismatch", F.contains(java.stripped(prefix), F.lit("package ")) | F.contains(java.stripped(prefix), F.lit("import ")), True),
        ("broad_rewrite", severe | moderate, False),
        *[(r, F.size(f"drift.{c}") > 0, False) for r, c in REFERENCES.items()],
        ("api_signature_drift", F.col("drift.signature_drift"), filtering),
        ("compile_fail", F.col("compile_problem").isNotNull(), True),
    )
    rows = rows.withColumn("compile_problem", compile_problem())
    of = lambda hard: F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when, is_hard in checks if is_hard or not hard]))
    rows = rows.withColumns({"reasons": of(False), "combinations": risk_combinations(plan_ok) if promote else F.array().cast("array<struct<detail:string,reasons:array<string>>>")})
    hard = F.array_distinct(F.concat(F.array_intersect("reasons", _strings(*[n for n, _, is_hard in checks if is_hard])), F.flatten(F.transform("combinations", lambda c: c["reasons"]))))
    return rows.withColumn("hard_reasons", hard).withColumn("valid", F.size("hard_reasons") == 0)


# The points of a rerank. Flags by truth; counts by item, up to a limit; steps by the first limit that holds.
RERANK_BONUS = 60.0
FLAG_POINTS = {
    "exact_signature_preservation": 20.0,
    "throws_clause_kept": 8.0,
    "api_signature_drift": -20.0,
    "broad_rewrite_combo": -8.0,
    "plan_ok": 15.0,
    "no_violation": 8.0,
    "model_artifact": -40.0,
    "markdown_or_explanation_tail": -25.0,
    "invented_helper_declaration": -12.0,
    "plan_fill_selected": -8.0,
}
COUNT_POINTS = {
    "new_helper_call_count": (-8.0, -24.0),
    "new_type_reference_count": (-6.0, -18.0),
    "new_constant_reference_count": (-4.0, -12.0),
    "new_identifier_reference_count": (-3.0, -12.0),
    "high_violation_count": (-3.0, -16.0),
    "rewarded_reuse": (2.0, 6.0),
}
STEP_POINTS = {
    "original_identifier_reuse": ((">=", 0.9, 12.0), (">=", 0.75, 8.0), ("<", 0.45, -8.0)),
    "near_bug_region": (("<=", 2.0, 12.0), ("<=", 5.0, 6.0), (">=", 12.0, -4.0)),
    "rewrite": ((">", 0.50, -20.0), (">", 0.35, -10.0), (">", 0.25, -4.0)),
    "penalty_only_reason_count": ((">=", 3, -14.0), (">=", 2, -6.0)),
    "risky_rewrite": ((">", 0.28, -5.0), (">", 0.18, -2.0)),
}
_COMPARE = {">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, "<": lambda x, y: x < y}


def features() -> dict[str, Column]:
    """The features of an analysed row, by name, and the few that only points read."""
    plan_ok, violations = F.coalesce("plan_ok", F.lit(True)), F.coalesce("violations", F.lit(0))
    heads = [java.squeezed(F.col(f"{c}.header")) for c in ("base_decl", "decl")]
    counts = {r: F.size(f"drift.{c}") for r, c in REFERENCES.items()}
    ids, old = java.identifiers(F.col("code")), java.identifiers(F.col("base"))
    reuse = let(ids, lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, old)) / F.size(x)).otherwise(0.0))
    broad = (F.col("fraction") > 0.50) | ((F.col("fraction") > 0.35) & ~plan_ok)
    soft = [broad, *[counts[r] > 0 for r in REFERENCES if r != "new_helper_call"]]
    penalties = sum((c.cast("int") for c in soft), F.lit(0))
    combo = broad & (penalties >= 2)
    reused = F.size("drift.supported_identifiers") + F.size("drift.supported_types") + F.size("drift.supported_constants")
    rewarded = F.when((reused > 0) & ~broad & (penalties < 3), reused).otherwise(0)
    more = F.greatest(F.lit(0), java.declarations(F.col("code")) - java.declarations(F.col("base")))
    code = F.coalesce("code", F.lit(""))
    return {
        "exact_signature_preservation": (heads[0] != "") & (heads[0] == heads[1]),
        "throws_clause_preservation": F.col("base_decl.throws") == F.col("decl.throws"),
        "throws_clause_kept": (F.col("base_decl.throws") == F.col("decl.throws")) & (F.col("base_decl.throws") != ""),
        "original_identifier_reuse": reuse,
        **{f"{r}_count": n for r, n in counts.items()},
        "api_signature_drift": F.col("drift.signature_drift"),
        "penalty_only_reason_count": penalties,
        "broad_rewrite_combo": combo,
        "risk_combo_penalty": F.when(combo, 8.0).otherwise(0.0) + F.when(penalties >= 3, 14.0).when(penalties >= 2, 6.0).otherwise(0.0),
        "risky_rewrite": F.when(penalties > 0, F.col("fraction")).otherwise(0.0),
        "change_fraction_risk_penalty": F.when((penalties > 0) & (F.col("fraction") > 0.28), 5.0).when((penalties > 0) & (F.col("fraction") > 0.18), 2.0).otherwise(0.0),
        "context_supported_reuse": reused,
        "rewarded_reuse": rewarded,
        "context_supported_reuse_bonus": F.least(F.lit(6.0), rewarded * 2.0),
        "plan_ok": plan_ok,
        "no_violation": violations == 0,
        "low_violation_count": violations,
        "high_violation_count": violations,
        "near_bug_region": F.when(F.col("bug_line").isNotNull(), mean_distance(F.col("edits"), F.col("bug_line"))),
        "model_artifact": candidates.model_artifact(java.stripped(code)) | code.rlike(candidates.ARTIFACT_TEXT),
        "markdown_or_explanation_tail": F.contains(code, F.lit("```")) | code.rlike(r"(?iU)\b(explanation|analysis|reasoning)\b"),
        "invented_helper_declaration": more > 0,
        "extra_nested_declaration": more,
        "plan_fill_selected": F.coalesce("filled", F.lit(False)),
        "rewrite": F.col("fraction"),
        "broad_rewrite": F.round("fraction", 4),
        "broad_rewrite_severe": F.col("fraction") > 0.50,
        "risk_tier": F.when(F.col("drift.signature_drift"), 3).otherwise(F.least(F.lit(2), penalties)),
    }


#: Features that stand for others' points and are not shown.
_INNER = ("throws_clause_kept", "risky_rewrite", "rewarded_reuse", "no_violation", "rewrite")


def _points(name: str, value: Column) -> Column:
    if name in FLAG_POINTS:
        return F.when(value, FLAG_POINTS[name]).otherwise(0.0)
    if name in COUNT_POINTS:
        each, limit = COUNT_POINTS[name]
        return (F.greatest if each < 0 else F.least)(F.lit(limit), value * each)
    return F.coalesce(*[F.when(_COMPARE[how](value, edge), points) for how, edge, points in STEP_POINTS[name]], F.lit(0.0))


def reranked(rows: DataFrame, score: str = "score") -> DataFrame:
    """analysed rows with features (a struct), points (a map from features that earn or cost any), adjustment, and the score with the adjustment."""
    rows = rows.withColumn("_f", F.struct(*[v.alias(k) for k, v in features().items()]))
    told = [n for n in features() if n in FLAG_POINTS or n in COUNT_POINTS or n in STEP_POINTS]
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), _points(n, F.col(f"_f.{n}")).alias("points")) for n in told])
    rows = rows.withColumn("points", F.map_from_entries(F.filter(entries, lambda e: e["points"] != 0)))
    total = F.aggregate(F.map_values("points"), F.lit(0.0), lambda a, b: a + b)
    shown = [n for n in features() if n not in _INNER]
    out = rows.withColumns({"features": F.struct(*[F.col(f"_f.{n}").alias(n) for n in shown]), "adjustment": total}).drop("_f")
    return out.withColumn(score, F.col(score) + F.col("adjustment"))


def validity_rerank(score: Column, checked: Column, valid: Column, reasons: Column) -> Column:
    """A valid candidate without reasons gains the bonus, an invalid one loses it; what isn't checked stays."""
    return F.when(~F.coalesce(checked, F.lit(False)), score).when(valid & (F.size(reasons) == 0), score + RERANK_BONUS).when(valid, score).otherwise(score - RERANK_BONUS)


def rescuable(artifact: Column) -> Column:
    """Of judged rows: soft reasons alone, one or two of those that name symbols, few symbols, an unchanged header, a narrow change, no artifact. With the support of all symbols (rescue_support), a single reason makes a candidate eligible."""
    symbols = F.coalesce(*[F.when(F.array_contains("reasons", r), F.size(f"drift.{c}")) for r, c in REFERENCES.items()], F.lit(0))
    only = F.size(F.array_except("reasons", _strings(*candidates.RESCUE_REASONS))) == 0
    return F.col("valid") & only & F.size("reasons").between(1, 2) & ~F.col("drift.signature_drift") & (F.col("fraction") <= candidates.RESCUE_FRACTION) & ~artifact & symbols.between(1, candidates.RESCUE_ITEMS)
