import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrywork.llm import suffix_dedup as S


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + S.LENGTH] for b in raw for i in range(len(b) - S.LENGTH + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - S.LENGTH + 1):
            if n[b[i : i + S.LENGTH]] > 1:
                cover[i : i + S.LENGTH] = b"\x01" * S.LENGTH
        runs = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "?") for d, t in rows], "doc_id bigint, text string, spans string").repartition(4)
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in S.remove_repeats(df, digest=True).collect())
    assert got == sorted(str((d, *w)) for (d, _), w in zip(rows, brute([t for _, t in rows]), strict=True))


def test_against_brute_force(spark, corpus):
    check(spark, [(r[0], r[1]) for r in corpus if len(r[1] or "") < 8000])


def test_passages_with_many_contexts(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    passage, ab = noise(260), noise(150)
    rows = [(k, noise(rng.randint(0, 300)) + passage[: rng.randint(199, 260)] + noise(rng.randint(0, 200))) for k in range(60)]
    rows += [(100, ab + ab), (101, "é" * 150 + ab), (102, "q" * 199), (103, "q" * 200), (104, "r" * 201), (105, passage * 3), (106, None), (107, "")]
    rows += [(200 + k, "same start " * 5 + passage + noise(3)) for k in range(5)]
    check(spark, rows)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5), st.integers(1, 60), st.integers(2, 40))
def test_tasks_batches_and_chunks_of_any_size(seed, tasks, batch, chunk):
    """The steps behind Spark's, with suffixes dealt to tasks by range and compared in small chunks."""
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choices("abcdef ", k=n))
    shared = [noise(230) for _ in range(3)]
    texts = [noise(rng.randint(0, 150)) + rng.choice(shared)[rng.randint(0, 20) :] + noise(rng.randint(0, 250)) + rng.choice(shared) for _ in range(25)]
    sampled = pd.concat(S._sample(iter([pd.DataFrame({"t": range(len(texts)), "text": texts})]))).drop_duplicates()
    found = [g[["h", "p"]].to_dict("records") for _, g in sampled.groupby("t")]
    cut = pd.concat(S._cut(iter([pd.DataFrame({"t": sorted(sampled["t"].unique()), "text": [texts[t] for t in sorted(sampled["t"].unique())], "found": found})])))
    rows = cut.sort_values(["suffix", "before", "t"]).reset_index(drop=True)
    before, S.CHUNK = S.CHUNK, chunk
    try:
        out = []
        for part in np.array_split(np.arange(len(rows)), tasks):
            own = rows.iloc[part].sort_values("suffix", key=lambda c: c.map(lambda x: x[: S.GRAM]), kind="stable")
            out += list(S._compare(iter([own.iloc[k : k + batch] for k in range(0, len(own), batch)])))
    finally:
        S.CHUNK = before
    got = pd.concat(out) if out else pd.DataFrame(columns=["w", "n", "t", "s", "e"])
    opened = got[got["w"].notna()]
    many = opened.groupby("w")["n"].sum()
    across = opened[(opened["n"] == 1) & opened["w"].isin(many[many > 1].index)]
    spans = pd.concat([got[got["w"].isna()], across])
    for t, (_, removed, runs, _) in enumerate(brute(texts)):
        merged = S.merge(spans[spans["t"] == t][["s", "e"]].to_dict("records"))
        assert (sum(e - s for s, e in merged), len(merged)) == (removed, runs)


def test_text_from_kept_bytes(spark):
    unit = "".join(random.Random(1).choices("abcdef", k=200))
    df = spark.createDataFrame([(1, "head " + unit), (2, unit + " tail")], "doc_id bigint, text string")
    assert {r.doc_id: r.kept_text for r in S.remove_repeats(df).collect()} == {1: "head ", 2: " tail"}


def test_empty(empty):
    assert S.remove_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.integers(0, 3), min_size=40, max_size=40))
def test_multikey_order(symbols, groups):
    m, g = np.array(symbols, np.uint64), np.array(groups[: len(symbols)])
    order = S.multikey_order(g, m)
    rows = [(int(g[i]), *m[i].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(m))) and rows == sorted(rows)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3))
def test_every_window_has_one_anchor(seed, letters):
    rng = random.Random(seed)
    texts = [bytes(rng.choices(b"abc"[:letters], k=rng.randint(0, 700))) for _ in range(5)]
    ends = np.cumsum([len(t) for t in texts])
    pos, _, first, last = S.anchors(b"".join(texts), ends)
    covered = sorted(q for a, b in zip(first.tolist(), last.tolist(), strict=True) for q in range(a, b + 1))
    assert covered == [q for e, t in zip(ends.tolist(), texts, strict=True) for q in range(e - len(t), e - S.LENGTH + 1)]
    assert all(a <= p <= a + S.WINDOW - 1 and p >= b for p, a, b in zip(pos.tolist(), first.tolist(), last.tolist(), strict=True)) or all(b <= p for p, b in zip(pos.tolist(), last.tolist(), strict=True))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 7))
def test_repeated_rows_survive_batch_borders(values, size):
    """In any cut into batches: rows of values that occur twice, and those of the first and the last value."""
    import pandas as pd

    h = sorted(values)
    df = pd.DataFrame({"h": np.array(h, np.int64), "t": np.arange(len(h)), "p": np.arange(len(h))})
    out = list(S._repeated(iter([df.iloc[k : k + size] for k in range(0, len(h), size)])))
    got = sorted(t for o in out for t in o["t"])
    n = Counter(h)
    assert got == [k for k, x in enumerate(h) if n[x] > 1 or x in (h[0], h[-1])]
