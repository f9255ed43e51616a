import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, letters="abcdefghijklmnop"):
    return ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with nulls, empty and long texts, copies, near copies, repeats and odd characters."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        letters = "abcdefghij" if k % 2 else "klmnopqrst"
        rows.append((k, " ".join(words(rng, rng.randint(3, 120), letters)) + ".", "aa" if k % 2 else "bb", f"s{k % 4}"))
    base = words(rng, 120)
    rows += [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "aa", "s0") for k in range(12)]
    rows += [(200, rows[5][1], "aa", "s1"), (201, rows[5][1], None, None), (5, rows[5][1], "aa", "s1")]
    passage = " ".join(words(rng, 60))
    rows += [(300 + k, " ".join(words(rng, 20)) + "\n" + passage + "\n" + " ".join(words(rng, 9)), "bb", "s2") for k in range(4)]
    rows += [(400, None, "aa", "s0"), (401, "", None, "s1"), (402, " \n\t ", "bb", None), (403, "x", "aa", "s1"), (404, "...,!", "aa", "s2")]
    rows += [(405, "É à la <|endoftext|> it's 3.14, naïve. \x1c odd　space ß", "bb", "s2"), (None, "no key at all here", "aa", "s3"), (None, None, None, None)]
    rows += [(500, " ".join(words(rng, 6000)), "aa", "s3"), (501, "z" * 5000, "aa", "s3"), (502, "a b " * 300, "bb", "s3")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
