import importlib
import re
import zlib
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    item = " ".join(f"term{k}" for k in range(30))
    dirty = spark.createDataFrame([(900, f"{item} {item}", "aa", "s1", 400)], docs.schema)
    docs.filter("doc_id IS NOT NULL").unionByName(dirty).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The documents, and what each stage made of its predecessor's rows, as the rows read back."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/stage{k}")
        out.append(spark.read.parquet(f"{folder}/stage{k}"))
    return out


def test_stages_keep_columns_and_clean_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    language, dedup, clean, mixed, tokens = ({r.doc_id for r in s.select("doc_id").collect()} for s in stages[1:])
    assert not language & {400, 401, 402, 404} and 900 in language
    assert not dedup & {101, 105, 200, 201} and 100 in dedup
    assert dedup - clean == {900}
    assert mixed == tokens and tokens


def _pairs(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_dedup_stage_against_brute_force(stages):
    rows = _pairs(stages[1])
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER)) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)]) for w in words]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if group[i] != group[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    kept = _pairs(stages[2])
    assert len(kept) == len(set(group))
    for g in set(group):
        own = [rows[k] for k in range(len(rows)) if group[k] == g]
        assert sum(r in own for r in kept) == 1 and any(d == min(x for x, _ in own) for d, t in kept if (d, t) in own)


def test_decontamination_stage_against_brute_force(spark, folder, stages):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    grams = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = split(r.text)
        grams |= {tuple(w[i : i + 13]) for i in range(len(w) - 12)} if len(w) >= 13 else {tuple(w)}

    def dirty(text):
        w = split(text)
        hit = {k for g in grams for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g for k in range(i, i + len(g))}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert _pairs(stages[3]) == [x for x in _pairs(stages[2]) if not dirty(x[1])]


def test_mixing_stage_meets_targets_with_words_of_its_documents(stages):
    from quarrywork.llm import mixing

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    sizes, took, own = {}, {}, {}
    for r in stages[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
        own.setdefault(r.doc_id, Counter()).update(words(r.text))
    drawn = {}
    for r in stages[4].collect():
        took[r.source] = took.get(r.source, 0) + len(words(r.text))
        drawn.setdefault(r.doc_id, Counter()).update(words(r.text))
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    for name, aim in zip(names, mixing.targets([sizes[n] for n in names], mixing.weights(len(names))), strict=True):
        assert abs(took.get(name, 0) - aim) <= max(2, 0.01 * aim)
    for d, c in drawn.items():
        assert all(n <= 3 * own[d][w] for w, n in c.items())


def test_token_stage_against_the_library(stages):
    from tokenizers import Tokenizer

    from quarrywork.llm import token_output

    tok = Tokenizer.from_file(token_output.default_tokenizer())
    start, want = 0, []
    for d, t in _pairs(stages[4]):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect()), key=lambda r: r[1]) == want


def test_run_is_the_stages_in_a_row(spark, folder, stages):
    rows, last = pipeline.run(spark, folder).collect(), stages[-1].collect()
    key = lambda r: (r.start, r.doc_id, r.n_tokens, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, last))


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
