r"""Chat formatting from a declarative template.

A template names, for each role, the control strings before and after a turn,
whether its text bears loss, and which states of a finite-state machine the
role may follow. Formatting emits segments (text, loss flag); a conversation's
output is the segments joined. Control strings inside texts are escaped: every
backslash is doubled, then a backslash goes after the first character of every
control string, so no escaped text contains one, and the way back is exact.
The loss mask is kept as spans of the output, in code points.

All of it is SQL functions; one conversation is one row, as its output is.

Defined results
  null text            formatted as the empty text
  null or other role   a turn with the template's ``other`` marks, which carry
                       the escaped role; the machine rejects it (valid false)
  ties of turn         in the order of role, then text
  null turn            before all others
  null conv_id         one conversation of its own
  invalid order        formatted all the same; valid is false
  empty table          no rows
  extra columns        ignored
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool
    follows: tuple[str, ...]


@dataclass(frozen=True)
class Template:
    """roles by name; other: marks around the role and after the text of any other role; start: the machine's first state; final: states it may end in."""

    roles: dict[str, Role]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        marks = {m for r in self.roles.values() for m in (r.before, r.after)} | set(self.other)
        strings = sorted({c for m in marks for c in re.findall(r"<[^<>\s]+>|\[[^\[\]\s]+\]", m)})
        if any(len(m.strip()) and m.strip() != "".join(re.findall(r"<[^<>\s]+>|\[[^\[\]\s]+\]|\s", m)).strip() for m in marks):
            raise ValueError("a mark consists of bracketed control strings and white space")
        if len({r.before for r in self.roles.values()}) < len(self.roles):
            raise ValueError("each role needs marks of its own")
        object.__setattr__(self, "controls", tuple(strings))


INSTRUCT = Template(
    {
        "system": Role("[SYS] ", " [/SYS]", False, ("start",)),
        "user": Role("<s>[INST] ", " [/INST]", False, ("start", "system", "assistant")),
        "assistant": Role("[OUT] ", " </s>", True, ("user",)),
    }
)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column, template: Template) -> Column:
    out = text
    for c in template.controls:
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def _marks(role: Column, template: Template, which: str) -> Column:
    a, b, c = template.other
    other = F.concat(F.lit(a), escape(F.coalesce(role, F.lit("")), template), F.lit(b)) if which == "before" else F.lit(c)
    out = None
    for name, r in template.roles.items():
        out = (F if out is None else out).when(role == name, F.lit(getattr(r, which)))
    return out.otherwise(other)


def _valid(roles: Column, template: Template) -> Column:
    """Runs the machine over the roles; its state is null after a wrong turn."""

    def step(state: Column, role: Column) -> Column:
        ok = F.lit(False)
        for name, r in template.roles.items():
            ok = ok | ((role == name) & state.isin(*r.follows))
        return F.when(ok, role)

    end = F.aggregate(roles, F.lit(template.start), step)
    return F.coalesce(end.isin(*template.final), F.lit(False))


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, formatted, loss_spans, valid): a row for each conversation."""
    loss = [name for name, r in template.roles.items() if r.loss]
    # A turn's place in its conversation is a running sum over rows, in the order in which they are joined.
    order = W.partitionBy("conv_id").orderBy("turn", "role", "_text").rowsBetween(W.unboundedPreceding, -1)
    named = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("_text"))
    marked = named.withColumns({"_before": _marks(F.col("role"), template, "before"), "_body": escape(F.col("_text"), template), "_after": _marks(F.col("role"), template, "after")})
    size = F.length("_before") + F.length("_body") + F.length("_after")
    placed = marked.withColumn("_at", F.coalesce(F.sum(size).over(order), F.lit(0)) + F.length("_before"))
    turn = F.struct("turn", "role", "_text", F.concat("_before", "_body", "_after").alias("s"), F.col("_at").cast("int").alias("start"), F.length("_body").alias("length"))
    talks = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    learned = F.filter("t", lambda x: F.coalesce(x["role"].isin(*loss), F.lit(False)))
    return talks.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["s"]), "").alias("formatted"),
        F.transform(learned, lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        _valid(F.transform("t", lambda x: x["role"]), template).alias("valid"),
    )


def _pattern(template: Template) -> str:
    """A turn: the marks before it, its escaped text, the marks after it."""
    quote = lambda s: re.sub(r"([\\\[\](){}.*+?^$|/])", r"\\\1", s)
    forms = [f"{quote(r.before)}(?:.*?){quote(r.after)}" for r in template.roles.values()]
    a, b, c = map(quote, template.other)
    return "(?s)" + "|".join([*forms, f"{a}(?:.*?){b}(?:.*?){c}"])


def read_conversations(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Adds turns, an array of (role, text) parsed from formatted; no escaped text contains a control string, so marks are the only ones."""
    turns = F.regexp_extract_all("formatted", F.lit(_pattern(template)), F.lit(0))
    a, b, c = template.other

    def parse(x: Column) -> Column:
        role, text = None, None
        for name, r in template.roles.items():
            here = F.startswith(x, F.lit(r.before))
            cut = F.substring(x, F.lit(len(r.before) + 1), F.length(x) - (len(r.before) + len(r.after)))
            role = (F if role is None else role).when(here, F.lit(name))
            text = (F if text is None else text).when(here, cut)
        mid = F.instr(x, F.lit(b))
        role = role.otherwise(F.substring(x, F.lit(len(a) + 1), mid - (len(a) + 1)))
        text = text.otherwise(F.substring(x, mid + len(b), F.length(x) - mid - (len(b) + len(c)) + 1))
        return F.struct(unescape(role, template).alias("role"), unescape(text, template).alias("text"))

    return formatted.withColumn("turns", F.transform(turns, parse))


def digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What the output holds, read back from it."""
    read = read_conversations(formatted, template)
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]), template)), "")
    return read.withColumn("_loss", masked).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


#: The conversation that the contract adds: its texts are control strings.
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_ID).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return digest(format_conversations(turns.unionByName(planted)))


def _oracle() -> str:
    def esc(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in INSTRUCT.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    other = sum(map(len, INSTRUCT.other))
    marks = " ".join(f"WHEN role = '{n}' THEN {len(r.before) + len(r.after)}" for n, r in INSTRUCT.roles.items())
    wrong = " AND ".join(f"NOT (role = '{n}' AND prev IN ({', '.join(repr(f) for f in r.follows)}))" for n, r in INSTRUCT.roles.items())
    return f"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}' UNION ALL SELECT {PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'),
p AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS prev, lead(role) OVER w IS NULL AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length({esc("text")}) + CASE {marks} ELSE {other} + length(role) END) AS BIGINT) AS formatted_chars,
  NOT bool_or({wrong}) AND bool_or(last AND role = 'assistant') AS valid
FROM p GROUP BY conv_id
"""


ORACLE = _oracle()
