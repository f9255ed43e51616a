"""Operators without SQL against brute force, on every row of a small table."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

from quarrywork.llm import language_id, near_dedup, suffix_dedup

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def test_op8_removes_what_brute_force_removes(spark, documents):
    n = suffix_dedup.LENGTH
    raw = {d: t.encode() for d, t, _ in documents}
    seen = Counter(hash(b[i : i + n]) for b in raw.values() for i in range(len(b) - n + 1))
    want = {}
    for d, b in raw.items():
        cover, last = bytearray(len(b)), 0
        for i in range(len(b) - n + 1):
            if seen[hash(b[i : i + n])] > 1:
                cover[max(i, last) : i + n] = b"\x01" * (i + n - max(i, last))
                last = i + n
        runs = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        want[d] = (len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(spark, DIR).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_op10_links_what_brute_force_links(spark, documents):
    sets = {}
    for d, t, _ in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[d] = frozenset(zip(w, w[1:], strict=False)) or frozenset([tuple(w)] if w else [])
    # Every pair that shares a shingle, by an inverted index: of each set, the shingles that a similarity of 0.8 can't all miss.
    rare = Counter(s for x in sets.values() for s in x)
    index, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in sorted(sets, key=lambda d: len(sets[d])):
        x = sets[d]
        prefix = sorted(x, key=lambda s: (rare[s], s))[: len(x) - -(-4 * len(x) // 5) + 1]
        for e in {e for s in prefix for e in index[s]}:
            both = len(x & sets[e])
            if 100 * both >= 80 * (len(x) + len(sets[e]) - both):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
        for s in prefix:
            index[s].append(d)
    want = {d: (len(sets[d]), find(d), find(d) == d) for d in sets}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.query(spark, DIR).collect()}
    assert got == want and sum(not k for _, _, k in want.values()) > 0


def test_op2_held_out_accuracy(spark, documents):
    lang = {d: x for d, _, x in documents}
    rows = [r for r in language_id.query(spark, DIR).collect() if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.95 * len(rows) and len(rows) > 100
