import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrywork.llm import periodic_runs
from quarrywork.llm.periodic_runs import MIN_EXPONENT, MIN_LENGTH, collapse_runs, find_runs

DIR = "/root/testdata/sf0.001"


def brute(words):
    """Every stretch of equal words p apart, its smallest period by trying all."""
    n, found = len(words), set()
    for p in range(1, n // MIN_EXPONENT + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                s, length = i, j - i + p
                q = next(q for q in range(1, p + 1) if all(words[k] == words[k + q] for k in range(s, s + length - q)))
                if q == p and length >= max(MIN_LENGTH, MIN_EXPONENT * p):
                    found.add((s, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(1, 12))
def test_runs_equal_brute_force(texts, places):
    texts = sorted(texts, key=len, reverse=True)
    words = np.array([10 * k + w for k, t in enumerate(texts) for w in t], np.int64)
    before, periodic_runs.GRID_PLACES = periodic_runs.GRID_PLACES, places
    try:
        got = [tuple(map(int, r)) for r in find_runs(words, np.array([len(t) for t in texts]))]
    finally:
        periodic_runs.GRID_PLACES = before
    want, shift = [], 0
    for t in texts:
        want += [(s + shift, n, p) for s, n, p in brute(t)]
        shift += len(t)
    assert got == want


def test_long_runs_with_other_runs_inside():
    rng = random.Random(8)
    unit = [rng.randint(0, 50) for _ in range(37)] + [7] * 9
    words = [rng.randint(0, 999) for _ in range(301)] + unit * 11 + [rng.randint(0, 999) for _ in range(55)]
    got = [tuple(map(int, r)) for r in find_runs(np.array(words), np.array([len(words)]))]
    assert got == brute(words) and sum(p == 46 for _, _, p in got) == 1 and sum(p == 1 for _, _, p in got) == 11


def edited(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.query(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    many = 0
    for r in docs:
        words = edited(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        if len(words) > 700:
            continue  # brute force takes the square of the words
        many += 1
        runs = brute(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        want = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest, hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert got[r.doc_id] == want
    assert len(got) == len(docs) and many > 100 and any(g[0] for g in got.values())


def test_edges(docs, corpus):
    rows = docs.withColumn("runs", F.lit("mine")).withColumn("n_words", F.lit(-1))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in collapse_runs(rows).collect())
    want = []
    for d, text, *_ in corpus:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute(words) if len(words) < 2000 else []
        want.append((d is None, d or 0, len(words), collapsed(words, runs), runs))
    assert got == sorted(want) and any(len(w[4]) for w in want)


def test_empty(empty):
    assert collapse_runs(empty, keep=("doc_id", "lang")).collect() == []
