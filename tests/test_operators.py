import re
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from quarrywork.operators import candidates, code, diffs, repair_loop, selection
from quarrywork.operators import retrieval as R
from quarrywork.sources import keyed_json
from quarrywork.streaming.resume import run_available


def test_memory(spark):
    rows = spark.createDataFrame([(1, 1, "A", 5), (1, 2, "B", 2), (1, 3, "C", 8), (1, 4, "A", 1), *[(2, k, c, 5 - k) for k, c in enumerate("ABCDE")]], "bug int, ord int, code string, failing int")
    rank = selection.ranking(F.lit(3), F.col("failing"), F.lit(None).cast("double"))
    best = lambda k, bug: [r.code for r in selection.memory(rows, "bug", "code", rank, "ord", k).filter(F.col("bug") == bug).orderBy("memory_rank").collect()]
    assert best(3, 1) == ["A", "B", "C"] and best(2, 2) == ["E", "D"]


def test_coverage_pins_the_best_greedy_and_takes_each_source(spark):
    kind = "bug int, score double, tier double, change double, signature string, greedy boolean, source string"
    rows = [(1, 9.0, None, 0.0, "a", False, "g"), (1, 8.0, None, 0.0, "b", False, "g"), (1, 1.0, None, 0.0, "c", False, "h"), (1, 2.0, None, 0.0, "d", False, None), (1, 0.5, None, 0.0, "e", True, "g"), (1, 0.1, None, 0.0, "f", True, "h")]
    df = spark.createDataFrame(rows, kind)
    picks = lambda **how: [r.signature for r in selection.coverage(df, "bug", 5, **how).orderBy("pick").collect()]
    assert picks() == ["e", "a", "d", "c", "b"] and picks(pin=False) == ["a", "d", "c", "b", "e"]
    # Within a margin of 10 the lower tier wins, so that the leader of a source is not its best by score.
    tiers = spark.createDataFrame([(1, 20.0, 2.0, 0.0, "a", False, "g"), (1, 12.0, 0.0, 0.0, "b", False, "g"), (1, 30.0, 2.0, 0.0, "c", False, "h")], kind)
    assert [r.signature for r in selection.coverage(tiers, "bug", 3).orderBy("pick").collect()] == ["c", "b", "a"]


def test_refill_keeps_all_and_takes_new_signatures(spark):
    rows = [(1, 5, False, 0.0, "a", 1), (1, 50, True, 0.0, "a", 2), (1, 40, True, 0.0, "b", 3), (1, 45, True, 0.0, "b", 4), (1, 3, True, 0.0, None, 5), (1, 2, True, 0.0, "", 6), (2, 9, False, 0.0, None, 1), (2, 8, False, 0.0, None, 2), (2, 7, False, 0.0, None, 3)]
    out = candidates.refill(spark.createDataFrame(rows, "bug int, score int, violates boolean, change double, signature string, k int"), "bug", 2, "k")
    got = {b: [(r.k, r.fill_score) for r in out.filter(F.col("bug") == b).orderBy("pick").collect()] for b in (1, 2)}
    assert got == {1: [(1, 5), (4, 20)], 2: [(1, 9), (2, 8), (3, 7)]}
    more = candidates.refill(spark.createDataFrame(rows, "bug int, score int, violates boolean, change double, signature string, k int"), "bug", 9, "k")
    assert [r.k for r in more.filter("bug = 1").orderBy("pick").collect()] == [1, 4, 5, 6]


def test_priority_margins(spark):
    rows = [(1, 20.0, 2.0, 0.5, "a"), (1, 12.0, 1.0, 0.5, "b"), (1, 12.5, 1.0, 0.1, "c"), (2, 5.0, None, 0.0, "d"), (2, 9.0, 3.0, 0.0, "e")]
    df = spark.createDataFrame(rows, "bug int, score double, tier double, change double, signature string")
    got = {(r.bug, r.pick): r.signature for r in selection.priority_order(df, "bug").collect()}
    assert [got[1, k] for k in (1, 2, 3)] == ["c", "b", "a"] and [got[2, k] for k in (1, 2)] == ["e", "d"]
    cycle = [{"score": s, "tier": t, "change": 0.0, "signature": str(s)} for s, t in ((20.0, 2.0), (12.0, 1.0), (4.0, 0.0))]
    before = selection._before
    assert before(cycle[1], cycle[0]) < 0 and before(cycle[2], cycle[1]) < 0 and before(cycle[0], cycle[2]) < 0
    assert sorted(cycle, key=cmp_to_key(before))


def test_bm25_by_hand(spark):
    import math

    corpus = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "d"), (4, None)], "doc int, text string")
    asked = spark.createDataFrame([(9, "b B d")], "q int, text string")
    got = {r.doc: r.score for r in R.bm25_scores(corpus, asked, "doc", "q").collect()}
    df, avgdl = {"a": 1, "b": 2, "c": 1, "d": 1}, 6 / 4
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / 4
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    term = lambda t, tf, dl: idf[t] * tf * 2.6 / (tf + 1.6 * (0.3 + 0.7 * dl / avgdl))
    want = {1: 2 * term("b", 2, 3), 2: 2 * term("b", 1, 2), 3: term("d", 1, 1)}
    assert got == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_line_edits():
    assert diffs.line_edits("a\nb\nc", "a\nx\nc\nd") == [
        {"op": "REPLACE", "start": 2, "end": 2, "new_lines": 1, "text": "x"},
        {"op": "INSERT", "start": 4, "end": 4, "new_lines": 1, "text": "d"},
    ]
    assert diffs.line_edits("a", "a") == [] and diffs._changed("", "a") == 1.0 and diffs._changed("a\nb", "a") == 0.5


@pytest.mark.parametrize(("text", "indent", "want"), [("a\n  b", 4, "    a\n      b"), ("    a\n  b", 0, "a\nb"), ("  a", 2, "  a"), ("", 4, ""), (None, 4, None), ("\n\n", 4, "\n\n"), ("a\n\nb", 2, "  a\n\n  b"),
    ("f {\n    x\n    }", 4, "    f {\n        x\n        }"), ("  f {\n        x\n    }", 4, "    f {\n        x\n    }"), ("f {\n    if {\n        y\n    }\n}", 4, "    f {\n        if {\n            y\n        }\n    }"), ("    f\n        x\n  y", 0, "f\n    x\ny")])
def test_indent(text, indent, want):
    assert code.shift_indent(text, indent) == want


def test_balanced_blocks():
    source = 'f() { s = "}"; // }\n /* } */ if (c == \'}\') { x(); } } tail'
    assert source[: code.balanced_end(source)].endswith("} }") and code.balanced_end("{ open") is None and code.balanced_end("no") is None


def test_nodes_and_imports():
    kinds = [n["type"] for n in code.python_nodes("import os\nif a:\n    b = c(1)")]
    assert kinds == ["If", "Assign", "Call"] and code.python_nodes("def (")[0]["type"] == "ParseError"
    assert code.python_imports("import os\nfrom a import b\nimport os, c as d") == ["import os", "from a import b", "import os", "import c as d"]
    assert code.python_imports("import os\n(") == ["import os"]


def test_block_span(spark):
    lines = F.split(F.lit("x\n a\n b\ny\na\nb"), "\n")
    span = lambda near: code.block_span(lines, F.array(F.lit("a"), F.lit("b")), F.lit(near))
    r = spark.range(1).select(span(1).alias("p"), span(6).alias("q"), code.block_span(lines, F.array(F.lit("zz")), F.lit(1)).alias("n")).first()
    assert (tuple(r.p), tuple(r.q), r.n) == ((2, 3), (5, 6), None)


def test_keyed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": {"v": 1}, "y": {"v": 2}, "z": null}')
    (tmp_path / "b.json").write_text('[{"v": 7}, {"v": 8}]')
    rows = keyed_json.read_keyed_json(spark, f"file://{tmp_path}/*.json", "v: int").collect()
    assert sorted((r.id, r.v) for r in rows) == [("0", 7), ("1", 8), ("x", 1), ("y", 2)]


def test_union_and_resume(spark):
    a = spark.createDataFrame([("k", 1), ("m", 2)], "id string, v int")
    both = keyed_json.union_with_suffixes("id", a, a.filter("id = 'k'"))
    assert sorted((r.id, r.v, r.source_no) for r in both.collect()) == [("k", 1, 0), ("k#1", 1, 1), ("m", 2, 0)]
    assert [r.id for r in keyed_json.remaining(a, a.filter("v = 1"), "id").collect()] == ["m"]


def test_manifest_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), (" ", 2), ("x", 3)], "kind string, v int")
    row = keyed_json.manifest(df, {"stage": "s"}, "kind").first()
    assert row.n_rows == 3 and '"value":"unknown","count":1' in row.counts and row.stage == "s"
    keyed_json.write_csv(df, f"file://{tmp_path}/csv")
    keyed_json.write_json(df, f"file://{tmp_path}/json")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == spark.read.json(f"file://{tmp_path}/json").count() == 3


def test_rounds(spark, tmp_path):
    """Broken, then unchanged or seen, then fixed."""
    items = spark.createDataFrame([(1, "base"), (2, "base2")], "id int, base string")
    calls = []

    def generate(open_, k):
        calls.append(k)
        out = {1: ["bad", "bad", ""], 2: ["bad", "base"], 3: ["good", "bad"]}[k]
        return open_.select("id", F.posexplode(F.array(*[F.lit(c) for c in out])).alias("sample", "code"))

    def evaluate(fresh):
        return fresh.withColumns({"outcome": F.when(F.col("code") == "good", "pass").otherwise("compile_fail"), "failing": F.lit(1)})

    folder = f"file://{tmp_path}/run"
    attempts = repair_loop.run_rounds(items, generate, evaluate, folder)
    assert sorted((r.id, r.iteration, r.code) for r in attempts.collect()) == [(1, 1, "bad"), (1, 3, "good"), (2, 1, "bad"), (2, 2, "base"), (2, 3, "good")]
    done = {r.id: (r.solved, r.solving_iteration, r.n_candidates) for r in repair_loop.summary(items, attempts).collect()}
    assert done == {1: (True, 3, 2), 2: (True, 3, 3)} and calls == [1, 2, 3]
    repair_loop.run_rounds(items, generate, evaluate, folder).count()
    assert calls == [1, 2, 3]


@pytest.mark.parametrize("rotate", [True, False])
def test_seeds_rotate_when_every_draft_was_seen(spark, tmp_path, rotate):
    items = spark.createDataFrame([(1, "base")], "id int, base string")
    asked = []

    def generate(open_, k):
        asked.append([(r.seed, r.strategy) for r in open_.collect()])
        return open_.select("id", F.posexplode(F.array(*[F.lit(c) for c in (["A", "B"], ["A"], ["C"])[k - 1]])).alias("sample", "code"))

    def evaluate(fresh):
        return fresh.withColumns({"outcome": F.lit("test_fail"), "failing": F.when(F.col("code") == "A", 5).otherwise(8)})

    attempts = repair_loop.run_rounds(items, generate, evaluate, f"file://{tmp_path}/run", rotate=rotate)
    assert asked == [[("base", None)], [("A", "test_feedback")], [("B" if rotate else "A", "test_feedback")]]
    assert sorted(r.code for r in attempts.collect()) == ["A", "B", "C"]


def test_function_spans():
    body = "    public int answer() {\n        return 42;\n    }"
    assert code.function_span("class Demo {\n" + body + "\n}\n", body, 2) == (2, 4)
    longer = "class Demo {\n    public int answer() {\n        if (ready) {\n            return 42;\n        }\n        return 0;\n    }\n}\n"
    assert code.function_span(longer, "    public int answer() {\n        // old\n        return -1;\n    }", 10) == (2, 7)
    made = "class Demo {\n    public Demo(int value,\n            String label) {\n        this.value = value; // }\n        this.label = \"}\";\n    }\n}\n"
    assert code.function_span(made, "    public Demo(int value,\n            String label) {\n        this.value = 0;\n    }", 50) == (2, 6)
    assert code.function_span("x", "int g() {\n}", None, [(3, 9), (4, 5)]) == (4, 5) and code.function_span("x", "int g() {\n}") is None


def test_nodes_have_flags_and_hints():
    found = code.python_nodes("def f(a):\n    return a[0]", 2, " return a[0]")
    assert [(n["type"], n["line"], n["contains_line"], n["matches_text"], n["hints"]) for n in found] == [("Function", 1, True, True, ["check signature/body"]), ("Return", 2, True, True, ["check return value"]), ("Subscript", 2, True, False, ["check index/key"])]


def test_scores_against_a_plain_sum(spark):
    from difflib import SequenceMatcher

    base = "def f(x):\n    y = x + 1\n    z = y * 2\n    return z"
    cases = [base.replace("x + 1", "x - 1"), base.replace("x + 1", "print(x)"), base + "\n    # fixed line, changed line", "", base.replace("return z", "pass\n    ..."), "import os\n" + base]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, code string")
    got = {r.k: r.s for r in df.select("k", candidates.heuristic_score(F.col("code"), F.lit(base), F.lit("y = x + 1"), F.lit("f"), F.lit("f"), F.lit(True), F.lit("z = y * 2")).alias("s")).collect()}
    plain = lambda t: " ".join(re.sub("#.*", "", t).split())
    for k, c in enumerate(cases):
        if not c:
            assert got[k] == -1000
            continue
        fraction, ratio = diffs._changed(base, c), len(c.splitlines()) / 4
        want = 100 + (-15 if "y = x + 1" in c else 15) + 35 + int(SequenceMatcher(None, plain(base), plain(c)).ratio() * 45)
        want += -500 if fraction < 0.005 else next((p for e, p in ((0.03, 40), (0.12, 30), (0.25, 20), (0.5, 5)) if fraction <= e), -10)
        want += 20 if 0.8 <= ratio <= 1.2 else 8
        want -= 300 * ("pass" in c or "..." in c) + 500 * ("..." in c) + 80 * ("fixed line" in c) + 80 * ("..." in c) + 80 * ("print(" in c) + 200 * ("import" in c)
        assert got[k] == want, c
    assert spark.range(1).select(candidates.length_ratio(F.lit(""), F.lit("a\nb")).alias("r")).first().r == 1.0


def test_edits_follow_the_matcher_on_long_texts():
    from difflib import SequenceMatcher

    base = [f"row {k}" if k % 3 else "}" for k in range(300)]
    new = [*base[:100], "added ", "}", *base[104:]]
    ops = [o for o in SequenceMatcher(None, base, new).get_opcodes() if o[0] != "equal"]
    got = diffs.line_edits("\n".join(base), "\n".join(new))
    assert [(e["op"].lower(), e["start"] - 1) for e in got] == [(o[0], o[1]) for o in ops] and all(e["text"] == e["text"].strip() for e in got)


def test_sources(spark, tmp_path):
    import os

    from quarrywork.sources import discovery

    for name in ("b.json", "a.json", "x_tag.manifest.json", "y.manifest.json"):
        (tmp_path / name).write_text("{}")
    os.utime(tmp_path / "x_tag.manifest.json", (1, 1))
    assert [p.rsplit("/", 1)[1] for p in discovery.split_inputs(spark, f" file://{tmp_path}/z.json, file://{tmp_path}/?.json,, ")] == ["z.json", "a.json", "b.json"]
    files = discovery.listing(spark, f"file://{tmp_path}/*")
    assert discovery.latest(files).first().path.endswith("y.manifest.json") and discovery.latest(files, "tag").first().path.endswith("x_tag.manifest.json")
    assert discovery.latest_manifest(files).first().path.endswith("y.manifest.json") and discovery.latest_manifest(files, "tag").first().path.endswith("x_tag.manifest.json")
    with pytest.raises(FileNotFoundError):
        discovery.latest(files.filter("path = ''"))
    (tmp_path / "k.json").write_text('{"1": {"a": 1}, "2": {"nodes": [1]}}')
    assert discovery.looks_enriched(spark, f"file://{tmp_path}/k.json", "nodes") and not discovery.looks_enriched(spark, f"file://{tmp_path}/k.json", "other")


def test_caches_are_reused(spark, tmp_path):
    from quarrywork.sources import discovery

    corpus = spark.createDataFrame([(1, "a b"), (2, "c")], "doc int, text string")
    folder = f"file://{tmp_path}/tokens"
    first = R.token_table(corpus, "doc", "text", folder)
    files = {f.name for f in (tmp_path / "tokens").iterdir()}
    assert R.token_table(corpus, "doc", "text", folder).count() == first.count() == 2 and {f.name for f in (tmp_path / "tokens").iterdir()} == files
    R.token_table(corpus.withColumn("text", F.upper("text")), "doc", "text", folder)
    assert len(list((tmp_path / "tokens").iterdir())) == 2
    with pytest.raises(ValueError):
        R.token_table(corpus.limit(0), "doc", "text", folder)
    calls = []

    def encode(df):
        calls.append(df.count())
        return df.select("doc", F.array(F.lit(1.0)).alias("v"))

    for n, rows in ((2, corpus), (2, corpus), (3, corpus.unionByName(spark.createDataFrame([(3, "d")], corpus.schema)))):
        assert discovery.cached_vectors(rows, "doc", "m", f"file://{tmp_path}", encode).count() == n
    assert calls == [2, 1]


def test_incremental_runs(spark, tmp_path):
    source, sink, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    for lo, hi in ((0, 5), (5, 8)):
        spark.range(lo, hi).write.mode("append").parquet(source)
        run_available(spark, source, sink, mark, "id long", lambda df: df.withColumn("twice", F.col("id") * 2))
        assert spark.read.parquet(sink).count() == hi


def test_keep_first_and_stagnation(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "ord int, code string")
    assert sorted((r.ord, r.code) for r in selection.keep_first(rows, F.col("code"), "ord").collect()) == [(1, "a"), (2, "b")]
    log = spark.createDataFrame([(1, k, c) for k, c in enumerate(["x", "x", "", "", "x"])], "bug int, ord int, mark string")
    assert [r.stagnant for r in selection.stagnant(log, "bug", "ord", F.col("mark")).orderBy("ord").collect()] == [False, True, False, False, False]


def test_similarity_ratio_compares_whole_turns(spark, tmp_path):
    from difflib import SequenceMatcher

    from quarrywork.plans.selection_queries import similarity_ratio

    same = "the same opening of both turns, which is longer than sixty characters, "
    texts = [same + "then one", same + "and another > end", "[x] short", "", None]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.ratio for r in similarity_ratio(spark, str(tmp_path)).collect()}
    want = {k: round(SequenceMatcher(None, texts[k - 1], texts[k]).ratio(), 6) for k in (1, 2, 3)}
    assert got == {**want, 4: -1.0}


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_minmax", "bm25_rule_rerank", "retrieval_margin", "best_match_overlap"])
def test_no_scored_pair_is_shuffled_before_the_cut(spark, name):
    from quarrywork.plans import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((query#\d+L?, doc#|doc#\d+L?, (dl|tok)#)", plan) and "WindowGroupLimit" in plan
    assert not re.search(r"hashpartitioning\(doc_id#", plan) and "SortMergeJoin" not in plan  # the texts stay where they are


def test_repeated_documents_are_scored_as_one(spark):
    corpus = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a"), (3, "d e"), (4, None)], "doc long, text string")
    asked = spark.createDataFrame([(7, "d a"), (8, "zzz"), (9, None)], "q long, text string")
    got = sorted((r.q, r.doc) for r in R.bm25_scores(corpus, asked, "doc", "q").collect())
    assert got == [(7, 1), (7, 2), (7, 3)]
