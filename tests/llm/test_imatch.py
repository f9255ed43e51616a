import os
import random

import pytest

from quarrywork.llm import imatch
from quarrywork.llm.imatch import band_lexicon, fingerprints, likeness, with_next

DIR = "/root/testdata/sf0.001"


def near(spark, rows, lexicon):
    """Fingerprints of (id, text) rows."""
    df = spark.createDataFrame(rows, "id bigint, text string, fingerprint string")
    return {r.id: r.fingerprint for r in fingerprints(df, ["id"], [], {"fingerprint": "text"}, lexicon).collect()}


def like(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(likeness("a", "b")).first()[0]


def follows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string").repartition(3)
    return [(r.doc_id, r.text, r.next_text) for r in with_next(df).filter("ghost = 0").collect()]


@pytest.mark.parametrize("pieces", [1, 2, 7, 500])
def test_next_text_by_key(spark, monkeypatch, pieces):
    monkeypatch.setattr(imatch, "MOST_PIECES", pieces)
    monkeypatch.setattr(imatch, "PIECES_A_PARTITION", 500)
    rng = random.Random(pieces)
    ids = rng.sample(range(-(10**12), 10**12), 60) + [5] * 40 + [None] * 30
    rows = [(d, None if k == 3 else f"t{k}", "x") for k, d in enumerate(ids)]
    got = follows(spark, rows)
    assert len(got) == len(rows)
    after = {(d, t): n for d, t, n in got}
    # One circle through all rows, in which keys ascend but for its one seam.
    where = {t or "": d for d, t, _ in rows}
    at, seen = got[0][1], []
    for _ in rows:
        seen.append(where[at])
        at = after[(where[at], at)]
    assert at == got[0][1] and len(set(after.values())) == len(rows)
    falls = sum((a is not None and b is None) or (None not in (a, b) and a > b) for a, b in zip(seen, seen[1:] + seen[:1], strict=True))
    assert falls == 1


def test_one_row_and_none(spark):
    assert follows(spark, [(7, "only", "x")]) == [(7, "only", "only")]
    assert follows(spark, []) == []


def test_equal_rows_stay(spark):
    got = follows(spark, [(1, "a", "x")] * 3 + [(2, "b", "x")])
    assert sorted(got) == [(1, "a", "a"), (1, "a", "a"), (1, "a", "b"), (2, "b", "a")]


def test_fingerprints_find_small_edits(spark, docs):
    lexicon = band_lexicon(docs, most=1000, least=1).cache()
    rows = {r.doc_id: r.text for r in docs.filter("doc_id < 60").collect()}
    whole = max(rows.values(), key=len)
    words = whole.split()
    found = near(spark, [(1, whole, "mine"), (2, whole.upper().replace(" ", ", "), ""), (3, " ".join(words[:-2]), ""), (4, " ".join(reversed(words)), ""), (5, rows[1], "")], lexicon)
    assert found[1] == found[2] == found[4] != found[3]
    assert like(spark, found[1], found[2]) == 1 and like(spark, found[1], found[3]) >= 0.5 and like(spark, found[1], found[5]) <= 0.3


def test_texts_without_a_term_of_the_lexicon(spark, docs):
    lexicon = band_lexicon(docs)
    found = near(spark, [(1, None, ""), (2, "", ""), (3, ".,!", ""), (4, "qqqqqqqqq zzzzzzzz", ""), (5, "Qqqqqqqqq, zzzzzzzz!", ""), (6, "zzzzzzzz qqqqqqqqq", "")], lexicon)
    assert all(f.startswith("=") for f in found.values())
    assert found[1] == found[2] and found[4] == found[5] and len({found[k] for k in (1, 3, 4, 6)}) == 4
    assert like(spark, found[1], found[2]) == 1 and like(spark, found[1], found[3]) == 0 and like(spark, None, found[1]) is None


def test_equal_texts_have_equal_fingerprints_by_both_joins(spark, docs, corpus, monkeypatch):
    rows = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(corpus)], "id bigint, doc_id bigint, text string, lang string, source string, n_chars bigint, term string")
    ask = lambda: {(r.id, r.doc_id, r.term): r.mark for r in fingerprints(rows, ["id"], ["doc_id", "term"], {"mark": "text"}, band_lexicon(docs, most=1000, least=2)).collect()}
    one = ask()
    monkeypatch.setattr(imatch, "BROADCAST_BYTES", -1)
    assert ask() == one and len(one) == docs.count()
    texts = {k: r[1] or "" for k, r in enumerate(corpus)}
    by_text = {}
    for (i, *_), f in one.items():
        assert by_text.setdefault(texts[i], f) == f


def test_empty(empty, spark):
    assert band_lexicon(empty).collect() == []
    assert fingerprints(empty, ["doc_id"], [], {"f": "text"}, band_lexicon(empty)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got = imatch.query(spark, DIR)
    want = con.execute(imatch.ORACLE)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
