"""Line diffs and sequence similarity. Python's matcher defines the results, so these are vectorised Python functions."""

from __future__ import annotations

import hashlib
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT = T.ArrayType(T.StructType().add("op", "string").add("start", "integer").add("end", "integer").add("new_lines", "integer").add("text", "string"))


def line_edits(base: str | None, new: str | None) -> list[dict]:
    """What turns base into new: base lines are counted from 1; an insertion ends where it starts; new text is stripped. The matcher's default holds, which takes lines of over 1 % of a text of 200 lines as junk."""
    a, b = (base or "").splitlines(), (new or "").splitlines()
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b).get_opcodes():
        if op != "equal":
            start = i + 1
            out.append({"op": op.upper(), "start": start, "end": start if op == "insert" else j, "new_lines": m - k, "text": "\n".join(b[k:m]).strip()})
    return out


def _changed(base: str | None, new: str | None) -> float:
    n = len((base or "").splitlines())
    moved = sum(max(0 if e["op"] == "INSERT" else e["end"] - e["start"] + 1, e["new_lines"]) for e in line_edits(base, new))
    return 1.0 if n == 0 else moved / n


def _signature(base: str | None, new: str | None) -> str:
    parts = [f"{e['op']}:{e['start']}:{e['end']}:{hashlib.sha1(e['text'].encode()).hexdigest()}" for e in line_edits(base, new)]
    plain = " ".join(re.sub("#.*", "", new or "").split())
    return hashlib.sha1(("|".join(parts) if parts else plain).encode()).hexdigest()


@F.pandas_udf(EDIT)
def edits(base: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([line_edits(x, y) for x, y in zip(base, new, strict=True)])


#: As edits, and marked as added_text is below.
edits_once = F.pandas_udf(edits.func, EDIT).asNondeterministic()


@F.pandas_udf(T.StringType())
def _added(base: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(e["text"] for e in line_edits(x, y) if e["text"]) for x, y in zip(base, new, strict=True)], dtype=object)


#: The lines that turn base into new, stripped by edit. Marked so that filters on what follows from it stay behind it: the
#: optimizer would put the matcher, with all that its inputs are made of, into each of them.
added_text = _added.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def change_fraction(base: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([_changed(x, y) for x, y in zip(base, new, strict=True)])


@F.pandas_udf(T.StringType())
def patch_signature(base: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([_signature(x, y) for x, y in zip(base, new, strict=True)])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matcher's ratio; -1 where a side is null."""
    return pd.Series([-1.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def expected_actual(message):
    """Columns expected and actual of a comparison failure's message, brackets dropped; null without one."""
    pattern = r"(?s)expected:\s*<(.*?)>\s*but was:\s*<(.*?)>"
    bare = lambda k: F.when(message.rlike(pattern), F.regexp_replace(F.regexp_extract(message, pattern, k), r"[\[\]]", ""))
    return bare(1), bare(2)
