import random
import re
from itertools import combinations

import pytest

from quarrywork.llm import near_dedup as N
from quarrywork.llm.components import components
from quarrywork.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k):
    s = [sets(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and s[i] and s[j] and min(len(s[i]), len(s[j])) * 5 >= 4 * max(len(s[i]), len(s[j])):
            both = len(s[i] & s[j])
            if 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s[i]), least.get(find(i)) if d is not None else None, d is None or least[find(i)] == d) for i, (d, _) in enumerate(rows)]


def check(spark, rows, k):
    df = spark.createDataFrame([(d, t, "?") for d, t in rows], "doc_id bigint, text string, node string").repartition(3)
    got = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in N.find_duplicates(df, shingle=k).collect())
    assert got == sorted(map(str, brute(rows, k)))


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, corpus, k):
    check(spark, [(r[0], r[1]) for r in corpus if len(r[1] or "") < 20_000], k)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((d, " ".join(w).upper() if d % 3 else " ".join(w)))
    check(spark, rows, 2)


def test_last_step_alone_joins_a_region_across_blocks_and_tasks(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        rows.append((d, " ".join(w)))
    whole = N._regions_to_pairs
    monkeypatch.setattr(N, "_regions_to_pairs", lambda *x: whole(*x).filter("b IS NULL"))  # no candidates
    monkeypatch.setattr(N, "BLOCK_ROWS", 7, raising=False)
    monkeypatch.setattr(N, "BLOCK_BYTES", 3000, raising=False)
    check(spark, rows, 2)


def test_ends_of_a_region_of_12000_rows_meet(spark):
    import numpy as np

    rng, m = np.random.default_rng(3), 12000
    sig, near = rng.integers(0, 256, (m, N.HASHES)).astype(np.uint8), np.arange(50, dtype=np.uint64)
    sig[-1] = sig[0]  # the one likely pair: the first row and the last, of two components
    rows = [(1, k, 0, 0 if k else 1, 50, sig[k].tobytes()) for k in range(m)]
    df = spark.createDataFrame(rows, "region bigint, node bigint, tree int, component bigint, n int, sig binary").repartition(3)
    sets = spark.createDataFrame([(k, (near if k in (0, m - 1) else near + np.uint64(100 * k)).tobytes()) for k in range(m)], "node bigint, s binary")
    got = N._bridges(df.select("region", "node", "tree", "component"), df.select("node", "n", "sig"), sets, 80, Scratch(spark, "ends")).collect()
    assert {frozenset((r.u, r.v)) for r in got} == {frozenset((0, m - 1))}


def test_components_meet_in_a_cell_whatever_the_blocks(spark):
    rows = [(region, node, node % 5 if node % 3 else 0) for region in (1, 2) for node in range(40)] + [(3, 50, 1), (3, 51, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "region bigint, node bigint, component bigint, one int")
    cells = {}
    for r in N._cells(df, "one", 4).collect():
        cells.setdefault(r.cell, []).append(r)
    met = {(x.region, *sorted((x.node, y.node))) for c in cells.values() for x in c for y in c if x.side & 1 and y.side & 2}
    want = {(p, *sorted((x, y))) for p, x, a in rows for q, y, b in rows if p == q and a != b}
    assert want <= met and max(map(len, cells.values())) < 30


def test_stage_keeps_columns_and_one_of_each_group(docs):
    kept = N.deduplicate(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns
    assert set(range(60)) <= set(ids) and not set(ids) & set(range(101, 112)) and 100 in ids and 200 not in ids and 201 not in ids


def test_stage_with_repeated_doc_ids(spark):
    a, other = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    near = a + " more"
    one_of = [(3, a, 1), (3, a, 1), (3, near, 2)]
    gone = [(7, a, 3), (9, other, 5)]
    stay = [(7, other, 4), (9, "", 6), (9, "", 6), (None, a, 7), (3, None, 8)]
    kept = N.deduplicate(spark.createDataFrame(one_of + gone + stay, "doc_id bigint, text string, component int").repartition(3))
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == ["doc_id", "text", "component"]
    left = [x for x in got if x not in stay]
    assert sorted(map(str, (x for x in got if x in stay))) == sorted(map(str, stay)) and len(left) == 1 and left[0] in one_of


def test_empty(empty):
    assert N.find_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(7, 7), (500, 501)], "u bigint, v bigint")
    got = {(r.u, r.v) for r in components(edges, Scratch(spark, "path"), "p").collect()}
    assert got == {(k, 0) for k in range(1, 200)} | {(501, 500)}


def test_regions_that_descend(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    sig = rng.integers(0, 3, (300, N.HASHES)).astype(np.uint8)
    sig[:, : N.DEPTH] = 1
    sig[::2] = sig[0]
    region = N._Region(80)
    region.run(np.arange(300), sig, np.full(300, 100))
    linked = {int(x) for a, b, _ in region.pairs for x in (*a, *b)}
    assert linked >= set(range(0, 300, 2))


def test_crowded_regions_survive_batch_borders():
    from collections import Counter

    import numpy as np
    import pandas as pd

    rng = random.Random(1)
    for _ in range(200):
        r = sorted(rng.randint(0, 6) for _ in range(rng.randint(0, 30)))
        size = rng.randint(1, 6)
        df = pd.DataFrame({"region": np.array(r, np.int64), "node": np.arange(len(r)), "tree": 0})
        out = list(N._crowded(iter([df.iloc[k : k + size] for k in range(0, len(r), size)])))
        n = Counter(r)
        assert sorted(x for o in out for x in o["node"]) == [k for k, x in enumerate(r) if n[x] > 1 or x in (r[0], r[-1])]
