import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarrywork.llm import language_id as L


def test_held_out_accuracy_and_edge_rows(docs, corpus):
    filters = L.train(docs.filter(~L.held_out(F.col("doc_id"))))
    assert sorted(filters.languages) == ["aa", "bb"]
    rows = L.predict(docs.drop("lang"), filters).collect()
    assert len(rows) == len(corpus) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[k].lang_pred == "und" and by_id[k].score == 0 for k in (400, 401, 402, 404))
    assert by_id[405].lang_pred in ("aa", "bb")
    own = {r[0]: r[2] for r in corpus if r[0] is not None and r[0] < 60}
    held = {r.doc_id for r in docs.filter(L.held_out(F.col("doc_id"))).select("doc_id").collect()} & own.keys()
    assert sum(by_id[k].lang_pred == own[k] for k in held) >= 0.9 * len(held)


def test_masks_hold_all_languages_of_an_ngram(docs):
    filters = L.train(docs)
    keys, _, _ = L._grams(["abcd klmn"])
    assert (filters.masks(keys) > 0).mean() > 0.5


def test_no_labels_and_no_rows(docs, empty):
    none = L.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(empty, none).count() == 0


def test_stage_keeps_clean_documents_and_columns(docs):
    kept = L.keep_known(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and set(range(60)) <= ids and not ids & {400, 401, 402, 404}


def _plain_grams(text):
    """Letter trigrams with a blank for a word's edge, centred on each letter."""
    y = [" "]
    for c in text.lower():
        if c.isalpha() or y[-1] != " ":
            y.append(c if c.isalpha() else " ")
    y.append(" ")
    return [tuple(y[k - 1 : k + 2]) for k in range(1, len(y) - 1) if y[k] != " "]


def _plain_sets(rows):
    """The n-grams of each language, by counting in dictionaries."""
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(_plain_grams(text))
    rate = {g: {} for c in counts.values() for g in c}
    for lang, c in counts.items():
        for g, n in c.items():
            if n >= L.MIN_COUNT:
                rate[g][lang] = n / c.total()
    return {lang: {g for g in c if rate[g].get(lang, 0) >= L.SHARE * max(rate[g].values(), default=1)} for lang, c in counts.items()}


def test_against_sets_of_ngrams(docs, corpus):
    filters = L.train(docs)
    sets = _plain_sets([(r[1], r[2]) for r in corpus])
    code = lambda g: sum((ord(c) if c != " " else 0) << s for c, s in zip(g, (42, 21, 0)))
    for k, lang in enumerate(filters.languages):
        keys = np.array([code(g) for g in sets[lang]], np.uint64)
        assert ((filters.masks(keys)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
        others = np.array([code(g) for g in {g for s in sets.values() for g in s} - sets[lang]], np.uint64)
        found = ((filters.masks(others)[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()
        assert found <= filters.false_rate[k] + 0.03
    got = {(r.doc_id, r.t): r for r in L.predict(docs.withColumn("t", F.col("text")), filters).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").collect()}
    texts = {r[0]: r[1] for r in corpus if r[0] is not None and [x[0] for x in corpus].count(r[0]) == 1}
    for key, text in texts.items():
        grams, row = _plain_grams(text or ""), got[key, text]
        shares = {lang: sum(g in sets[lang] for g in grams) / max(1, len(grams)) for lang in filters.languages}
        if not grams:
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        best = sorted(shares.values())
        if best[-1] - best[-2] > 0.05:
            assert row.lang_pred == max(shares, key=shares.get)
        assert abs(row.score - best[-1]) < 0.05


def test_more_languages_than_bits_in_a_word(spark):
    rng = random.Random(5)
    letters = [chr(0x4E00 + 20 * k + j) for k in range(70) for j in range(20)]
    text = lambda k: " ".join("".join(rng.choices(letters[20 * k : 20 * k + 20], k=4)) for _ in range(300))
    rows = [(100 * k + j, text(k), f"l{k:02d}") for k in range(70) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = L.train(df)
    assert len(filters.languages) == 70 and filters.table.shape[1] == 2
    assert {(r.doc_id, r.lang_pred) for r in L.predict(df, filters).collect()} == {(d, lang) for d, _, lang in rows}


def test_thresholds_leave_ties_out_together():
    assert L._thresholds([(0, 9, 2), (0, 7, 2), (0, 5, 3), (1, 4, 1)], 3, 4) == [7, 4, 1 << 62]


def test_keys_and_extra_columns_stay_exact(spark):
    big = (1 << 62) + 1
    rows = [(big, "abc def ghi " * 9, "aa", 1, {"x": 1}), (None, "abc def", "aa", None, None), (2, None, None, big, {})]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score bigint, lang_pred map<string,int>").coalesce(1)
    assert {r.doc_id for r in L.predict(df, L.train(df)).collect()} == {big, None, 2}
    kept = L.keep_known(df, least_score=0.0).collect()
    assert {(r.doc_id, r.score, str(r.lang_pred)) for r in kept} <= {(big, 1, "{'x': 1}"), (None, None, "None")}
