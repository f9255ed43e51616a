"""Structure of code texts: nodes, imports, balanced blocks, indentation, spans.

Parsers are Python; whole batches go through them by Arrow.
"""

from __future__ import annotations

import ast
import keyword
import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrywork.functions.prompts import local_line, reason
from quarrywork.functions.text import identifiers, let, lines, numbered_context, strip, trim_lines
from quarrywork.operators import selection

NODE = T.ArrayType(T.StructType().add("type", "string").add("line", "integer").add("end_line", "integer").add("code", "string").add("contains_line", "boolean").add("matches_text", "boolean").add("hints", T.ArrayType(T.StringType())))
# Syntax that is listed, its names, and hints by name.
KINDS = {
    ast.FunctionDef: "Function", ast.AsyncFunctionDef: "Function", ast.ClassDef: "Class", ast.If: "If", ast.For: "For", ast.While: "While", ast.Try: "Try", ast.ExceptHandler: "ExceptHandler",
    ast.With: "With", ast.Return: "Return", ast.Raise: "Raise", ast.Assert: "Assert", ast.Assign: "Assign", ast.AugAssign: "AugAssign", ast.AnnAssign: "AnnAssign", ast.Call: "Call",
    ast.Compare: "Compare", ast.BoolOp: "BoolOp", ast.BinOp: "BinOp", ast.UnaryOp: "UnaryOp", ast.Subscript: "Subscript", ast.Attribute: "Attribute",
    ast.ListComp: "ListComp", ast.DictComp: "DictComp", ast.SetComp: "SetComp", ast.GeneratorExp: "GeneratorExp",
}
HINTS = {
    "If": "check condition", "Compare": "check boundary", "BoolOp": "check predicate", "Call": "check arguments/return", "Assign": "check mutation/copy", "AugAssign": "check mutation/copy",
    "Subscript": "check index/key", "Attribute": "check attribute access", "Return": "check return value", "Raise": "check exception type/message", "Assert": "check assertion",
    "Function": "check signature/body", "Class": "check class body",
}


def python_nodes(code: str | None, line: int | None = None, content: str | None = None) -> list[dict]:
    """Typed nodes in the order of a walk, with their lines, whether they hold the suspicious line or its text, and hints; one error node if the code doesn't parse."""
    source, goal = textwrap.dedent(code or ""), (content or "").strip()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as problem:
        return [{"type": "ParseError", "line": getattr(problem, "lineno", None), "end_line": None, "code": str(problem), "contains_line": False, "matches_text": False, "hints": []}]
    out = []
    for n in ast.walk(tree):
        if name := KINDS.get(type(n)):
            text, end = (ast.get_source_segment(source, n) or "").strip(), n.end_lineno or n.lineno
            holds = line is not None and n.lineno <= line <= end
            out.append({"type": name, "line": n.lineno, "end_line": end, "code": text, "contains_line": holds, "matches_text": bool(goal and text and goal in text), "hints": [HINTS[name]] if name in HINTS else []})
    return out


def _class_fields(tree: ast.AST, owner: str) -> list[str]:
    """Class attributes, and what __init__ sets on self, of a class or of all."""
    out: list[str] = []
    for c in (n for n in ast.walk(tree) if isinstance(n, ast.ClassDef) and n.name == (owner or n.name)):
        for item in c.body:
            if isinstance(item, ast.Assign):
                out += [f"{t.id} (class attr)" for t in item.targets if isinstance(t, ast.Name)]
            elif isinstance(item, ast.AnnAssign) and isinstance(item.target, ast.Name):
                kind = item.annotation
                said = f": {kind.id}" if isinstance(kind, ast.Name) else f": {kind.value}" if isinstance(kind, ast.Constant) else ""
                out.append(f"{item.target.id}{said} (class attr)")
        for init in (i for i in c.body if isinstance(i, ast.FunctionDef | ast.AsyncFunctionDef) and i.name == "__init__"):
            for a in (n for n in ast.walk(init) if isinstance(n, ast.Assign)):
                out += [f"self.{t.attr}" for t in a.targets if isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self"]
    return list(dict.fromkeys(out))


def _signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    names = [x.arg for x in a.args] + ([f"*{a.vararg.arg}"] if a.vararg else []) + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])
    return f"{'async def' if isinstance(f, ast.AsyncFunctionDef) else 'def'} {f.name}({', '.join(names)})"


def _siblings(tree: ast.Module, owner: str, own: str) -> list[str]:
    """Signatures of the other functions of a class, or of the module."""
    bodies = [n.body for n in ast.walk(tree) if isinstance(n, ast.ClassDef) and n.name == owner] if owner else [tree.body]
    return [_signature(f) for body in bodies for f in body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef) and f.name != own]


def python_context(code: str | None, owner: str = "", own: str = "") -> dict:
    """(imports, fields, siblings) of a file: 30, 15 and 20 at most; imports by lines where it doesn't parse."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return {"imports": python_imports(code), "fields": [], "siblings": []}
    return {"imports": python_imports(code), "fields": _class_fields(tree, owner)[:15], "siblings": _siblings(tree, owner, own)[:20]}


CONTEXT = T.StructType([T.StructField(x, T.ArrayType(T.StringType())) for x in ("imports", "fields", "siblings")])


@F.pandas_udf(CONTEXT)
def file_context(code: pd.Series, owner: pd.Series, own: pd.Series) -> pd.DataFrame:
    """The context of one function: its class, or blank, and its name; null code has an empty context."""
    return pd.DataFrame([python_context(*x) for x in zip(code, owner.fillna(""), own.fillna(""), strict=True)], columns=["imports", "fields", "siblings"])


def python_imports(code: str | None, most: int = 30) -> list[str]:
    """Imports, one line each for the names of an import, by the parser or, where it fails, by lines."""
    named = lambda x: x.name + (f" as {x.asname}" if x.asname else "")
    try:
        found: list[str] = []
        for n in ast.walk(ast.parse(code or "")):
            if isinstance(n, ast.Import):
                found += [f"import {named(x)}" for x in n.names]
            elif isinstance(n, ast.ImportFrom):
                found.append(f"from {n.module or ''} import {', '.join(map(named, n.names))}")
    except (SyntaxError, ValueError, RecursionError):
        found = [x.strip() for x in re.findall(r"(?m)^((?:from\s+[\w.]+\s+)?import\s+.+)", code or "")]
    return found[:most]


@F.pandas_udf(NODE)
def nodes(code: pd.Series) -> pd.Series:
    return code.map(python_nodes)


@F.pandas_udf(NODE)
def nodes_at(code: pd.Series, line: pd.Series, content: pd.Series) -> pd.Series:
    """With the flags of a suspicious line and its text."""
    return pd.Series([python_nodes(c, None if pd.isna(n) else int(n), t) for c, n, t in zip(code, line, content, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def imports(code: pd.Series) -> pd.Series:
    return code.map(python_imports)


def java_imports(code: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r"(?m)^\s*import\s+((?:static\s+)?[\w.]+(?:\.\*)?)\s*;"), F.lit(1)))


def import_names(one: Column) -> Column:
    """What an import may be called by: the last parts of its words, but for the words of the statement and wild cards."""
    words = F.array_except(F.split(F.regexp_replace(one, ",", " "), r"\s+"), F.array(*map(F.lit, ("from", "import", "as"))))
    return F.filter(F.transform(words, lambda w: F.substring_index(w, ".", -1)), lambda n: (n != "") & (n != "*"))


def relevant_imports(found: Column, code: Column) -> Column:
    """Those of which the code contains a name."""
    return F.filter(found, lambda x: F.exists(import_names(x), lambda n: F.contains(code, n)))


# Words that begin no signature.
STATEMENTS = ("if", "for", "while", "switch", "catch", "return", "throw", "do", "else", "try")


def sibling_parts(signatures: Column, code: Column, java: bool = True) -> Column:
    """(called, others): signatures whose name the code contains, and the rest; for Java, statements taken for signatures are left out."""
    real = F.filter(signatures, lambda x: ~F.trim(x).rlike(rf"^(?:{'|'.join(STATEMENTS)})[ (]")) if java else signatures
    named = lambda x: F.regexp_extract(x, r"(?:def|async\s+def)?\s*(\w+)\s*\(", 1)
    calls = lambda x: (named(x) != "") & F.contains(code, named(x))
    return let(real, lambda r: F.struct(F.filter(r, calls).alias("called"), F.filter(r, lambda x: ~calls(x)).alias("others")))


def balanced_end(text: str, at: int = 0) -> int | None:
    """Behind the brace that closes the first one from at on; strings, characters and comments don't count. None if it stays open."""
    depth, i, n = 0, at, len(text)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//":
            i = text.find("\n", i)
            if i < 0:
                return None
        elif two == "/*":
            i = text.find("*/", i + 2)
            if i < 0:
                return None
            i += 1
        elif c in "\"'":
            j = i + 1
            while j < n and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            i = j
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
            if depth < 0:
                return None
        i += 1
    return None


@F.pandas_udf(T.StringType())
def balanced_block(text: pd.Series) -> pd.Series:
    """Up to the end of the first balanced block; null if there is none."""
    ends = text.map(lambda x: balanced_end(x) if x is not None else None)
    return pd.Series([None if e is None or pd.isna(e) else t[: int(e)] for t, e in zip(text, ends, strict=True)])


def fenced_code(text: Column) -> Column:
    """The body of the first fence, or the whole text."""
    body = F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1)
    return F.when(body != "", body).otherwise(text)


def _indent(row: str) -> int:
    return len(row) - len(row.lstrip(" "))


def shift_indent(code: str | None, indent: int) -> str | None:
    """The block moved so that its first line has that indent. Moved right, a body that is nowhere above the indent and somewhere deeper stays where it is; moved left, no line goes below 0."""
    rows = code.split("\n") if code else []
    full = [k for k, r in enumerate(rows) if r.strip()]
    by = indent - _indent(rows[full[0]]) if full else 0
    if not by:
        return code
    body = [_indent(rows[k]) for k in full[1:]]
    moved = full[:1] if by > 0 and body and min(body) >= indent < max(body) else full
    for k in moved:
        rows[k] = " " * by + rows[k] if by > 0 else rows[k][min(-by, _indent(rows[k])) :]
    return "\n".join(rows)


@F.pandas_udf(T.StringType())
def adjust_indent(code: pd.Series, indent: pd.Series) -> pd.Series:
    return pd.Series([shift_indent(c, int(n)) for c, n in zip(code, indent, strict=True)])


def block_span(lines: Column, block: Column, preferred: Column) -> Column:
    """(start, end), 1-based, of the place where the lines equal the block's, trimmed; the nearest to preferred, the first of equals; null if there is none."""
    trimmed = F.transform(lines, lambda x: F.trim(x))
    goal = F.transform(block, lambda x: F.trim(x))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(lines) - F.size(block) + 1))
    hits = F.filter(starts, lambda i: F.slice(trimmed, i, F.size(goal)) == goal)
    best = F.array_min(F.transform(hits, lambda i: F.struct(F.abs(i - preferred).alias("gap"), i.alias("start"))))
    return F.when(F.size(block) > 0, F.when(best.isNotNull(), F.struct(best["start"].alias("start"), (best["start"] + F.size(block) - 1).alias("end"))))


def _braces(row: str) -> tuple[int, int]:
    """Opening and closing braces outside of literals and line comments."""
    bare = re.sub(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|//.*$|/\*.*?\*/', "", row)
    return bare.count("{"), bare.count("}")


def _anchors(rows: list[str], block: list[str]) -> list[int]:
    """1-based lines where the block's head (its first lines up to a brace, three at most) stands, or else its first line does."""
    full = [r.rstrip() for r in block if r.strip()]
    if not full:
        return []
    n = next((k for k, r in enumerate(full[:3]) if "{" in r), min(2, len(full) - 1)) + 1
    ends = [r.rstrip() for r in rows]
    exact = [k + 1 for k in range(len(ends) - n + 1) if ends[k : k + n] == full[:n]]
    return exact or [k + 1 for k, r in enumerate(ends) if r.strip().startswith(full[0].strip())]


def function_span(text: str, block: str, preferred: int | None = None, ranges: list[tuple[int, int]] = ()) -> tuple[int, int] | None:
    """(first, last) line of a function in a file: where its text stands, else from its signature to the brace that closes it, else of the given ranges the one nearest in length. The place nearest to preferred wins."""
    rows, own = text.splitlines(), block.splitlines()
    near = (lambda k: abs(k - preferred)) if preferred else (lambda k: 0)
    goal = [r.rstrip() for r in own]
    spots = [k + 1 for k in range(len(rows) - len(goal) + 1) if goal and [r.rstrip() for r in rows[k : k + len(goal)]] == goal]
    if spots:
        at = min(spots, key=near)
        return at, at + len(goal) - 1
    for at in sorted(_anchors(rows, own), key=near):
        depth, opened = 0, False
        for k in range(at, len(rows) + 1):
            up, down = _braces(rows[k - 1])
            depth, opened = depth + up - down, opened or up > 0
            if opened and depth <= 0:
                return at, k
    return min(ranges, key=lambda r: abs(r[1] - r[0] + 1 - len(own)) if own else 0, default=None)


SPAN = T.StructType().add("start", "integer").add("end", "integer")


@F.pandas_udf(SPAN)
def span(text: pd.Series, block: pd.Series, preferred: pd.Series) -> pd.DataFrame:
    """function_span of each row; nulls where there is none."""
    found = [function_span(t or "", b or "", None if pd.isna(p) else int(p)) or (None, None) for t, b, p in zip(text, block, preferred, strict=True)]
    return pd.DataFrame({"start": pd.array([f[0] for f in found], "Int32"), "end": pd.array([f[1] for f in found], "Int32")})


def analyse(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(key, place, line, type, contains_line, distance, overlap, names, hints, reason, code, context): the k most suspicious nodes of Python functions (key, code, start, line, content).

    The line is counted from the function's start if it lies in it so, or else
    as it came. Nodes are ranked by distance, type and shared names, strong ones first.
    """
    source = F.coalesce("code", F.lit(""))
    at = local_line(F.col("line"), F.col("start"), F.size(lines(source)))
    own = rows.select(key, source.alias("code"), at.alias("_at"), strip(F.col("content")).alias("content"))
    each = own.withColumn("_code", dedented("code")).select(key, "_at", "_code", "content", F.posexplode(nodes_at("code", "_at", "content")).alias("_n", "n")).filter("n.type != 'ParseError'")
    names = F.array_sort(F.array_intersect(F.array_distinct(identifiers(F.col("n.code"), keyword.kwlist)), F.array_distinct(identifiers(F.col("content"), keyword.kwlist))))
    near = each.withColumns({"distance": F.abs(F.col("n.line") - F.col("_at")), "names": names})
    scored = near.withColumns(
        {
            "score": selection.node_score(F.col("n.type"), F.col("distance"), F.size("names"), F.col("n.contains_line"), F.col("n.matches_text")),
            "strong": selection.strong_hint(F.col("distance"), F.size("names"), F.col("n.contains_line"), F.col("n.matches_text"), F.col("n.hints")),
        }
    )
    best = selection.effective_nodes(scored, key, k, "_n")
    told = reason(F.col("n.type"), F.col("distance"), F.col("names"), F.col("n.hints"))
    return best.select(
        key, "place", F.col("n.line").alias("line"), F.col("n.type").alias("type"), F.col("n.contains_line").alias("contains_line"), "distance", F.size("names").alias("overlap"), "names",
        F.col("n.hints").alias("hints"), told.alias("reason"), trim_lines(F.col("n.code"), 4).alias("code"), trim_lines(numbered_context(F.col("_code"), F.col("n.line")), 6).alias("context"),
    )


@F.pandas_udf(T.StringType())
def dedented(code: pd.Series) -> pd.Series:
    return code.map(lambda x: textwrap.dedent(x or ""))


def enrich(rows: DataFrame, key: str, most: int = 30) -> DataFrame:
    """(key, imports, fields, siblings, class_name, source_available) of functions (key, language, parent, name, function, source).

    Without a file's source the lists are empty, but for Java fields, which the
    function itself may declare.
    """
    owner = F.when(F.contains("parent", F.lit("::")), F.trim(F.split_part("parent", F.lit("::"), F.lit(1)))).otherwise("")
    full = F.coalesce(F.col("source"), F.lit("")) != ""
    java, none = F.col("language") == "java", F.array().cast("array<string>")
    fields = F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(F.nullif("source", F.lit("")), F.col("function"), F.lit("")), F.lit(r"(?m)^\s*((?:private|protected|public|static|final)\s[^(){};=]*\w)\s*(?:=[^;]*)?;"), F.lit(1))), 1, 15)
    methods = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(r"(?m)^\s*((?:(?:public|protected|private|static|final|abstract|synchronized)\s+)+[\w<>\[\], .?]*\s\w+\s*\([^)]*\))"), F.lit(1))
    others = F.slice(F.filter(methods, lambda m: F.regexp_extract(m, r"(\w+)\s*\([^)]*\)$", 1) != F.coalesce("name", F.lit(""))), 1, 20)
    python = file_context(F.when(~java & full, F.col("source")).otherwise(""), owner, F.coalesce("name", F.lit("")))
    both = rows.withColumn("_p", python)
    imports = F.when(java, F.when(full, F.slice(java_imports(F.col("source")), 1, most)).otherwise(none)).otherwise(F.col("_p.imports"))
    return both.select(
        key,
        imports.alias("imports"),
        F.when(java, fields).otherwise(F.col("_p.fields")).alias("fields"),
        F.when(java, F.when(full, others).otherwise(none)).otherwise(F.col("_p.siblings")).alias("siblings"),
        owner.alias("class_name"),
        full.alias("source_available"),
    )
