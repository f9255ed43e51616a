import hashlib
import re

from quarrywork.llm import decontamination as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = " ".join(f"term{k}" for k in range(20))
ITEMS = [(1, ITEM), (2, "short Éa item"), (3, None), (10, "..."), (4, ITEM), (5, ITEM + " more")]
TEXTS = [
    (1, "Intro. " + ITEM.upper().replace(" ", " - ") + " outro words here", "?"),
    (2, " ".join(ITEM.split()[:12]), "?"),
    (3, "nothing here", "?"),
    (4, "SHORT Éa-item! short éa item", "?"),
    (5, None, "?"),
    (6, "", "?"),
    (7, "a " * 3000 + "short Éa item", "?"),
    (3, "nothing here", "?"),
    (None, ITEM, "?"),
    (8, " ".join(ITEM.split()[2:16]) + " x " + ITEM, "?"),
]


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    w = split(text)
    hit, found = set(), set()
    for item, words in ((i, split(t)) for i, t in ITEMS):
        n = min(13, len(words))
        grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def tables(spark, texts=TEXTS, items=ITEMS):
    return spark.createDataFrame(texts, "doc_id bigint, text string, items string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_report_against_brute_force(spark):
    docs, items = tables(spark)
    rows = D.report(docs, items).collect()
    want = sorted((str(d), *brute(t)) for d, t, _ in TEXTS)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == want


def test_removal_of_documents_and_spans(spark):
    docs, items = tables(spark)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "3", "5", "6", "7"]
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, items, "spans").collect()}
    assert "term" not in cut[1].lower() and cut[1].startswith("Intro. ") and cut[1].endswith("outro words here")
    assert cut[7].startswith("a a ") and not split(cut[4]) or cut[4].count("éa") == 1
    assert cut[5] is None and cut[3] == "nothing here"


def test_empty_tables(spark):
    docs, items = tables(spark, [], ITEMS)
    assert D.report(docs, items).count() == 0
    docs, items = tables(spark, TEXTS, [])
    assert not any(r.contaminated or r.n_hit for r in D.report(docs, items).collect())


def test_no_python_on_the_main_path(spark):
    docs, items = tables(spark)
    plan = D.report(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_text_and_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [*TEXTS, (20, long + " " + ITEM + " " + long + " short Éa item " * 500, "?")]
    docs, items = tables(spark, texts)
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in D.report(docs, items).collect())
    assert got == sorted(str((d, *brute(t))) for d, t, _ in texts)
