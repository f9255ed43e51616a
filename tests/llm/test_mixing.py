import re

import pytest
from pyspark.sql import functions as F

from quarrywork.llm import mixing as M


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_share_and_stop_at_three_times():
    assert M.targets([100, 100], [1, 1]) == [100, 100]
    out = M.targets([10, 1000, 0], [10, 1, 5])
    assert out[0] == 30 and out[1] == pytest.approx(980) and out[2] == 0
    assert M.targets([], []) == [] and M.targets([0, 0], [1, 2]) == [0, 0]


def highest_quotients(wanted, seats, most):
    got = [0] * len(wanted)
    for _ in range(seats):
        open_ = [k for k in range(len(wanted)) if wanted[k] > 0 and got[k] < most[k]]
        if not open_:
            break
        got[max(open_, key=lambda k: (wanted[k] / (2 * got[k] + 1), -k))] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 40, 101, 500])
@pytest.mark.parametrize("wanted", [[3.0, 1.0, 1.0], [50.0, 49.0, 1.0, 0.0], [7.5] * 5, [1.0, 200.0]])
def test_apportionment_is_that_of_highest_quotients(wanted, seats):
    most = [60] * len(wanted)
    assert M.apportion(wanted, seats, most) == highest_quotients(wanted, seats, most)


def test_shards_add_up():
    per = M.shard_quotas([5.0, 3.0, 1.5], 40, [99] * 3, 7)
    assert [sum(x) for x in zip(*per)] == M.apportion([5.0, 3.0, 1.5], 40, [99] * 3)
    assert all(q >= 0 for shard in per for q in shard)


def test_mix(docs, corpus):
    rows = M.mix(docs.withColumn("taken", F.lit("clash"))).collect()
    assert len(rows) == len(corpus)
    sizes = {}
    for *_, s, _ in corpus:
        sizes.setdefault(s, 0)
    for _, t, _, s, _ in corpus:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    aims = dict(zip(names, M.targets([sizes[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    took = dict.fromkeys(names, 0)
    for r in rows:
        assert r.size == size(r.text) and r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source])
        took[r.source] += r.taken
    assert all(abs(took[s] - aims[s]) <= max(2, 0.01 * aims[s]) for s in names)
    again = M.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_draw_has_the_words_that_mix_takes(docs):
    took = M.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    drawn = M.draw(docs)
    assert drawn.columns == docs.columns
    got = {r.source: r.n for r in drawn.groupBy("source").agg(F.sum(M.n_words("text")).alias("n")).collect()}
    assert {r.source: r.n for r in took if r.n} == got


@pytest.mark.parametrize(("block", "shards"), [(7, 5), (40, 3), (1, 16)])
def test_taken_words_by_shard_against_brute_force(docs, block, shards):
    rows = M.mix(docs, block_words=block, shards=shards).withColumn("_o", F.xxhash64("doc_id", F.lit(17))).collect()
    names = sorted({r.source for r in rows} - {None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    plans = {p["source"]: p for p in M.plan(list(zip(names, sizes, strict=True)), block, 17, shards)}
    most, seats = [3 * -(-n // block) for n in sizes], round(sum(p["target"] for p in plans.values()) / block)
    wanted = [plans[s]["target"] for s in names]
    marks = [highest_quotients(wanted, seats * k // shards, most) for k in range(shards + 1)]
    for at, s in enumerate(names):
        quotas = [b[at] - a[at] for a, b in zip(marks, marks[1:])]
        p = plans[s]
        assert p["quotas"] == quotas
        turns = sorted(range(p["blocks"]), key=lambda b: (b * p["step"] + p["shift"]) % p["blocks"])
        taken = (turns * 4)[: sum(quotas)]  # (block, shard) in order
        shard = [k for k, q in enumerate(quotas) for _ in range(q)]
        # -2 ** 63 and up as unsigned, as salts order them
        stream = sorted((r for r in rows if r.source == s), key=lambda r: (r._o % (1 << 64), r.doc_id is not None, r.doc_id or 0, r.size))
        start = 0
        for r in stream:
            want = {}
            for b, k in zip(taken, shard, strict=True):
                n = min(start + r.size, (b + 1) * block) - max(start, b * block)
                if n > 0:
                    want[k] = want.get(k, 0) + n
            assert {x.shard: x.words for x in r.shards} == want and r.taken == sum(want.values())
            start += r.size


def test_draw_by_shard_has_the_words_that_mix_gives_each(docs):
    took = M.mix(docs, block_words=11, shards=4).select("source", F.explode("shards").alias("x")).groupBy("source", "x.shard").agg(F.sum("x.words").alias("n")).collect()
    drawn = M.draw(docs, block_words=11, shards=4, shard="part")
    got = drawn.groupBy("source", "part").agg(F.sum(M.n_words("text")).alias("n")).collect()
    assert {(r.source, r.shard): r.n for r in took} == {(r.source, r.part): r.n for r in got}


def test_salts_grow_with_the_largest_source():
    assert [M.n_salts(n) for n in (0, 1 << 33, 1 << 40, 1 << 60)] == [512, 512, 1 << 16, 1 << 22]


def test_empty(empty):
    assert M.mix(empty).count() == 0 and M.draw(empty).count() == 0


@pytest.mark.parametrize("sizes", [[20_000_000_000_000, 500_000, 3_000_000], [1_000_000_000, 10], [7, 10**12, 1, 0, 10**9, 50], [5] * 9, [1]])
def test_small_sources_beside_very_large_ones_meet_their_targets(sizes):
    for p in M.plan([(f"s{k}", n) for k, n in enumerate(sizes)], None, 17, 16):
        taken = sum(p["quotas"]) * p["block"]
        assert abs(taken - p["target"]) <= max(1, 0.01 * p["target"])
        assert p["blocks"] < 1 << 31 and sum(p["quotas"]) <= 3 * p["blocks"]


def test_taken_words_meet_targets(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_WORDS", 4)
    monkeypatch.setattr(M.block_size, "__defaults__", (64,))
    rows = [(k, "w " * 1000, "big") for k in range(200)] + [(1000 + k, "w " * 7, "small") for k in range(3)] + [(2000, "x", None), (2001, "x y z", "tiny")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = M.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= max(1, 0.01 * r.target) and r.over <= 0 for r in got)
    drawn = {r.source: r.n for r in M.draw(df).groupBy("source").agg(F.sum(M.n_words("text")).alias("n")).collect()}
    assert drawn == {r.source: r.taken for r in got}
