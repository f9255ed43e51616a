import hashlib
import os
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrywork.llm import merkle
from quarrywork.llm.merkle import collapse, digest, document_leaf, folded, manifest, siblings

DIR = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def item(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout):
    """The root, and each node's siblings on the way, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, x in enumerate(at):
            first = x - x % fanout
            proofs[k] += [n for i, n in enumerate(nodes[first : first + fanout], first) if i != x]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [x // fanout for x in at]
    return nodes[0], proofs


def brute(rows, fanout=2):
    """(doc_id, leaf): subroot, root and siblings, for rows of documents."""
    groups = defaultdict(list)
    for d, text, lang, source, n in rows:
        groups[lang].append((d is not None, d or 0, h(*map(item, (d, source, lang, n, text)))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = climb([tops[g][0] for g in names], fanout)
    out = defaultdict(list)
    for g, up in zip(names, above, strict=True):
        for (known, d, leaf), low in zip(sorted(groups[g]), tops[g][1], strict=True):
            out[d if known else None, leaf].append((tops[g][0], root, "".join(low + up)))
    return {k: sorted(v) for k, v in out.items()}


def found(rows, **how):
    df = manifest(rows, document_leaf(), "lang", ["doc_id"], ["doc_id"], **how).withColumns({"up": folded(F.col("leaf"), F.col("proof")), "s": siblings(F.col("proof"))})
    out = defaultdict(list)
    for r in df.collect():
        assert r.up == r.root
        out[r.doc_id, r.leaf].append((r.subroot, r.root, r.s))
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.integers(2, 5), st.integers(1, 4))
def test_superblocks_equal_the_whole_tree(n, fanout, levels):
    nodes = [h(str(k)) for k in range(n)]
    want, proofs = climb(nodes, fanout)
    now, ways = nodes, [[] for _ in nodes]
    at, left = list(range(n)), n
    while len(now) > 1:
        depth = 0
        while left > 1 and depth < levels:
            left, depth = -(-left // fanout), depth + 1
        size = fanout**levels
        blocks = [collapse(now[i : i + size], depth, fanout) for i in range(0, len(now), size)]
        for k, x in enumerate(at):
            ways[k] += blocks[x // size][1][x % size]
        now, at = [b[0] for b in blocks], [x // size for x in at]
    assert now == [want]
    assert ["".join(s["left"] + s["right"] for s in w) for w in ways] == ["".join(p) for p in proofs]


@pytest.mark.parametrize(("levels", "fanout"), [(10, 2), (1, 2), (2, 3)])
def test_nulls_copies_and_long_texts(docs, corpus, levels, fanout):
    rows = docs.withColumns({"proof": F.lit("mine"), "place": F.lit(-1), "group": F.lit("x")})
    assert found(rows, levels=levels, fanout=fanout) == brute(corpus, fanout)


def test_one_row_and_many_groups(spark, docs):
    one = docs.filter("doc_id = 3")
    leaf = one.select(document_leaf().alias("x")).first().x
    r = manifest(one, document_leaf(), "lang", ["doc_id"], ["doc_id"]).first()
    assert (r.leaf, r.subroot, r.root, r.proof) == (leaf, leaf, leaf, [])
    rng = random.Random(3)
    rows = [(k, "t" * (k % 5), f"g{rng.randint(0, 400)}é" if k % 9 else None, None, k) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    assert found(df, levels=3) == brute(rows)


def test_empty(empty):
    assert manifest(empty, document_leaf(), "lang", ["doc_id"], ["doc_id"]).collect() == []


def test_digest_is_of_the_text(spark):
    assert spark.range(1).select(digest(F.lit("é"), F.lit("a"))).first()[0] == h("éa")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = merkle.query(spark, DIR)
    want = con.execute(merkle.ORACLE)
    assert [c[0] for c in want.description] == got.columns
    rows = got.collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert {r.verified for r in rows} == {True, False}
    plain = brute([tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert {(r.doc_id, r.leaf): [(r.subroot, r.root, r.proof_sha256)] for r in rows} == {k: [(a, b, h(s)) for a, b, s in v] for k, v in plain.items()}
