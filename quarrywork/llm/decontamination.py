r"""Benchmark decontamination by a broadcast hash set of test n-grams.

A window is 13 consecutive words of a benchmark item, or all words of an item
that has fewer. Hashes of the windows are the set; documents' token windows of
the lengths that occur are hashed and probed, and every hit is verified on the
words themselves. All of it is SQL functions.

The set is broadcast while its estimated size (words, item ids and an allowance
for each row) is at most BROADCAST_BYTES; a larger benchmark joins by a shuffle
on the hash.

Defined results
  null or empty text, text without words   0 words, nothing hit
  very long texts                          whole; windows of a text are one row's array, of under 2 GB
  null or word-free item                   has no window
  repeated items                           each counts, by its item_id
  repeated document rows                   each gets its result
  null doc_id                              kept, as any value
  empty tables                             no rows, or nothing hit
  extra columns                            kept by decontaminate()
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrywork.llm.exprs import ascii_lower, indices, let, text_or_empty

WINDOW = 13
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 100
#: What no word holds, in a text whose letters are as they were.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def cased_words(text: str) -> Column:
    return F.filter(F.split(text_or_empty(text), NOT_WORD), lambda w: w != "")


def words(text: str) -> Column:
    return F.transform(cased_words(text), ascii_lower)


def count_words(text: str) -> Column:
    """As the size of a split: regexp_count takes 15 times as long."""
    return F.size(cased_words(text))


def _word_hash(w: Column) -> Column:
    """Of a word in any case. Words that agree after A-Z are lower-cased agree here too; the few others are told apart by verification."""
    return F.xxhash64(F.lower(w))


def _windows(w: Column, lengths: list[int]) -> Column:
    """(pos, len, h) of all windows of these lengths in the words w."""

    def of(hashes: Column, n: int) -> Column:
        return F.transform(indices(F.size(hashes) - (n - 1)), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice(hashes, i + 1, n), F.lit(n)).alias("h")))

    return let(F.transform(w, _word_hash), lambda hashes: F.concat(*[of(hashes, n) for n in lengths]))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(h, len, gram, items): the distinct windows, their words and the items that hold them."""
    items = benchmark.select("item_id", words("text").alias("w")).filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    starts = items.select("item_id", "w", "n", F.explode(indices(F.size("w") - F.col("n") + 1)).alias("i"))
    grams = starts.select("item_id", "n", F.slice("w", F.col("i") + 1, F.col("n")).alias("g"))
    h = F.xxhash64(F.transform("g", _word_hash), F.col("n"))
    return grams.groupBy(h.alias("h"), F.col("n").alias("len"), F.array_join("g", " ").alias("gram")).agg(F.collect_set("item_id").alias("items"))


def _merge(spots: Column) -> Column:
    """Maximal runs (start, end) of words under spots (pos, len)."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(spots, lambda x: F.sequence(x["pos"], x["pos"] + x["len"] - 1)))))

    def runs(hit: Column) -> Column:
        first = F.filter(hit, lambda x, i: (i == 0) | (F.get(hit, i - 1) != x - 1))
        last = F.filter(hit, lambda x, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != x + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    return let(covered, runs)


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, _t, spans, items) of the documents with hits; _t is a hash of the text, which tells rows of one key apart."""
    windows = benchmark_windows(benchmark).cache()
    size = F.sum(F.octet_length("gram") + 16 * F.size("items") + 2 * ROW_BYTES)
    n, lengths = windows.agg(F.coalesce(size, F.lit(0)), F.collect_set("len")).first()
    if not n:
        lengths = [WINDOW]
    small = (lambda x: F.broadcast(x)) if n <= BROADCAST_BYTES else (lambda x: x)
    tag = F.xxhash64(text).alias("_t")
    probes = docs.select(key, tag, F.explode(_windows(cased_words(text), sorted(lengths))).alias("x")).select(key, "_t", "x.*")
    found = probes.join(small(windows.select("h", "len").distinct()), ["h", "len"]).groupBy(key, "_t").agg(F.collect_set(F.struct("pos", "len")).alias("spots"))
    # Verified on the words: only documents with hits, spread by their keys.
    named = found.select(F.col(key).alias("_k"), F.col("_t").alias("_u"), "spots")
    texts = docs.select(key, tag, F.col(text).alias("_text"))
    again = texts.join(named, texts[key].eqNullSafe(named["_k"]) & (texts["_t"] == named["_u"]))
    spots = let(words("_text"), lambda w: F.transform("spots", lambda s: F.struct(s["pos"].alias("pos"), s["len"].alias("len"), F.array_join(F.slice(w, s["pos"] + 1, s["len"]), " ").alias("gram"))))
    grams = again.select(key, "_t", F.explode(spots).alias("x")).select(key, "_t", "x.*")
    true = grams.join(small(windows.select("gram", "len", "items")), ["gram", "len"])
    by_doc = true.groupBy(key, "_t").agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("spots"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return by_doc.select(key, "_t", _merge(F.col("spots")).alias("spans"), "items")


def _with_hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, keep: list) -> DataFrame:
    hits = find_hits(docs, benchmark, key, text).select(F.col(key).alias("_k"), F.col("_t").alias("_u"), F.col("spans").alias("_spans"), F.col("items").alias("_items"))
    rows = docs.select(*keep, F.xxhash64(text).alias("_t"), count_words(text).cast("bigint").alias("_n_words"))
    joined = rows.join(hits, rows[key].eqNullSafe(hits["_k"]) & (rows["_t"] == hits["_u"]), "left").drop("_k", "_u", "_t")
    n_hit = F.coalesce(F.aggregate("_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]), F.lit(0).cast("bigint"))
    return joined.withColumn("_n_hit", n_hit).withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * 20 >= F.col("_n_words")))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = _with_hits(docs, benchmark, key, text, [key])
    ids = F.sort_array(F.transform(F.coalesce("_items", F.array().cast("array<bigint>")), lambda i: i.cast("string")))
    return found.select(
        key,
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without contaminated documents; or, with remove="spans", with the hit words cut from their texts (separators stay)."""
    found = _with_hits(docs, benchmark, key, text, [docs[c] for c in docs.columns])
    if remove == "documents":
        return found.filter(~F.col("_contaminated")).select(*docs.columns)

    def cut(pieces: Column) -> Column:
        lead = F.when(F.element_at(pieces, 1).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)

        def kept(_: Column, i: Column) -> Column:
            word = (i - lead) / 2
            hit = F.exists("_spans", lambda s: (s["start"] <= word) & (word < s["end"]))
            return ((i - lead) % 2 != 0) | ~hit

        return F.array_join(F.filter(pieces, kept), "")

    pieces = F.regexp_extract_all(F.col(text), F.lit(PIECES), F.lit(0))
    return found.withColumn(text, F.when(F.col("_n_hit") > 0, let(pieces, cut)).otherwise(F.col(text))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, p.n FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""
