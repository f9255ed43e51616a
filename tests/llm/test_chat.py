import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrywork.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "?") for r in rows], SCHEMA)


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 2, "assistant", "b"), (2, 1, "user", None),
    (3, 0, "tool", r"x [ROLE] \[ROLE] [/ROLE]\\ "), (3, 1, None, ""), (4, 0, "user", "\n\\<s>\\\\</s>"), (4, 0, "user", "same turn"),
    (None, 0, "assistant", "lone"), (5, 0, "user", "long " * 20_000), (5, 1, "assistant", "é" * 1000), (6, None, "system", "s"), (6, 1, "user", "u"), (6, 2, "assistant", "a"), (6, 2, "assistant", "a"),
]


def test_round_trip_and_masks(spark):
    rows = chat.digest(chat.format_conversations(frame(spark, ROWS))).collect()
    talks = {}
    for c, t, r, x in ROWS:
        talks.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x or ""))
    assert {r.conv_id for r in rows} == talks.keys()
    for r in rows:
        turns = [(role, text) for _, _, _, role, text in sorted(talks[r.conv_id])]
        loss = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id for r in rows if r.valid} == {1, 2, 5}


def test_machine(spark):
    orders = ["ua", "sua", "uaua", "a", "u", "uu", "su", "sa", "aua", "uas", "uaa"]
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(k, t, names[r], "x") for k, o in enumerate(orders) for t, r in enumerate(o)]
    got = {r.conv_id: r.valid for r in chat.format_conversations(frame(spark, rows)).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [0, 1, 2]


def test_no_control_string_survives_escaping(spark):
    pieces = st.lists(st.sampled_from([*chat.INSTRUCT.controls, "\\", "[", "<", "s>", "INST]", "a", "/"]), max_size=12).map("".join)

    @settings(max_examples=1, deadline=None)
    @given(st.lists(pieces, min_size=200, max_size=200))
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        for r in df.select("t", chat.escape(df.t, chat.INSTRUCT).alias("e"), chat.unescape(chat.escape(df.t, chat.INSTRUCT), chat.INSTRUCT).alias("b")).collect():
            assert r.b == r.t and not any(c in r.e for c in chat.INSTRUCT.controls)

    run()


def test_native_and_empty(spark):
    out = chat.digest(chat.format_conversations(frame(spark, [])))
    assert out.count() == 0 and not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
