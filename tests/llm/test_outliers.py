import re
from collections import Counter
from itertools import combinations

import numpy as np

from pyspark.sql import functions as F

from quarrywork.llm import outliers as O
from quarrywork.llm.scratch import Scratch


def stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(cover)


def test_statistics_against_brute_force(spark, docs, corpus):
    rows = [(900, "a\n b\na\na \n\n|x| y <z>", "aa", "s0", 0), (901, "to be or not to be or not to be", None, None, 0)]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in O.judge(more).collect())
    want = []
    for d, t, *_ in [*corpus, *rows]:
        s = stats(t)
        want.append(str((d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])))
    assert got == sorted(want)


def test_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(1)
    clean = [(k, " ".join("w" * int(x) + str(k % 7) + str(j) for j, x in enumerate(rng.integers(2, 7, 120 + k % 60))), "aa" if k % 2 else "bb", "s", 0) for k in range(400)]
    noisy = [(1000 + k, " ".join("|##$$%%" + str(j) for j in range(150)), "aa", "s", 0) for k in range(12)]
    df = spark.createDataFrame(clean + noisy, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in O.judge(df).filter("kept").collect()}
    assert kept == set(range(400))


def test_copies_of_junk_that_are_over_a_third_of_a_group_go(spark):
    rng = np.random.default_rng(4)
    clean = [(k, " ".join("w" * int(x) + str(k % 7) + str(j) for j, x in enumerate(rng.integers(2, 7, 120 + k % 60))), "aa", "s", 0) for k in range(260)]
    junk = " ".join("|##$$%%" + str(j) for j in range(150))
    df = spark.createDataFrame(clean + [(1000 + k, junk, "aa", "s", 0) for k in range(140)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in O.judge(df).filter("kept").collect()} == set(range(260))


def test_distance_is_the_mahalanobis_distance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2)) @ np.array([[1.0, 0.4], [0.0, 0.7]])
    names = ("log_words", "word_length")
    rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "_g string, log_words double, word_length double")
    groups = O._estimate(rows.groupBy("_g").agg(*O._moments(names)), names, ["_g"])
    got = np.array(sorted(r.dist2 for r in O._distance(rows.join(groups, "_g"), names).collect()))
    cov = np.cov(x.T, bias=True) + np.diag([O.FLOORS[n] ** 2 for n in names])
    c = x - x.mean(axis=0)
    assert np.allclose(got, np.sort(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)))


def test_repeats_in_a_text_of_millions_of_words(spark):
    for n in (70_000, 4_250_000):
        text = f"concat_ws(' ', concat_ws(' ', transform(sequence(1, {n}), x -> concat('w', x))), 'to be or not to be or')"
        row = spark.range(1).select(F.split(F.expr(text), " ").alias("w")).select(O._repeat_words(F.col("w")).alias("n")).first()
        assert row.n == 6


def test_estimate_is_that_of_least_determinant_over_all_subsets(spark):
    rng = np.random.default_rng(7)
    names, n = ("log_words", "word_length"), 16
    half = (n + len(names) + 1) // 2
    floors = np.diag([O.FLOORS[x] ** 2 for x in names])
    for shift in ((9.0, -7.0), (4.0, 6.0)):
        x = np.concatenate([rng.normal(scale=1.5, size=(half, 2)), rng.normal(scale=3, size=(n - half, 2)) + shift])
        rows = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "_g string, log_words double, word_length double")
        got = O.mcd_estimates(rows, names, ["_g"], Scratch(spark, "brute"), True).first().g
        size = lambda rest: np.linalg.det(np.cov(x[list(rest)].T, bias=True) + floors)
        best = min(combinations(range(n), half), key=size)
        lower = np.linalg.cholesky(np.cov(x[list(best)].T, bias=True) + floors)
        assert np.allclose([got.c_0, got.c_1], x[list(best)].mean(axis=0)) and np.allclose([got.l_0_0, got.l_1_0, got.l_1_1], lower[[0, 1, 1], [0, 0, 1]])


def test_a_few_rows_are_judged_by_all_others(spark):
    rng = np.random.default_rng(5)
    text = lambda k, n: " ".join("w" * int(x) + str(k % 7) + str(j) for j, x in enumerate(rng.integers(2, 7, n)))
    clean = [(k, text(k, 120 + k % 60), "aa", "s") for k in range(200)] + [(300 + k, text(k, 130), "bb", "t") for k in range(5)]
    junk = " ".join("|##$$%%" + str(j) for j in range(150))
    df = spark.createDataFrame([*clean, (1000, junk, "cc", "u"), (1001, junk, None, None), (1002, junk, "bb", "t")], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in O.judge(df).filter("kept").collect()} == {r[0] for r in clean}


def test_empty(empty):
    assert O.judge(empty).count() == 0
