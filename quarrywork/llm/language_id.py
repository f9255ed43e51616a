"""Language identification by language-bitmask n-gram filters.

Training counts letter trigrams (word edges count as a letter) in a bounded,
hash-chosen sample of labelled texts and gives each n-gram the languages in
which it is common. The filters are bit-sliced Bloom filters: one table whose
slots are bitmasks over languages (64 to a machine word, as many words as the
languages need), so that ANDing an n-gram's slots returns all languages that
contain it at once. A text's popcounts per language, corrected for each slice's
false-positive rate, decide.

What is fitted is bounded: the MAX_LANGUAGES languages with most labelled texts,
about SAMPLE_TEXTS texts of each, and up to TOP_GRAMS n-grams of each and
ALL_GRAMS together (the most frequent; those that tie at the bound go together).
The table, 12 to 24 slots for each n-gram of the largest language, is all that
workers get. Prediction reads whole texts and nothing else.

Defined results
  null text, text without a letter   lang_pred "und", score 0
  no n-gram known                    the language with most training texts, score 0
  ties                               the language with more training texts, then the smaller name
  no labelled text                   "und", score 0, for all
  very long text                     whole, in steps that are bounded by batches
  repeated rows                      each gets its result
  null key                           gets its result; held out as the empty text is
  empty table                        no rows
  extra columns                      kept by keep_known; ignored by predict
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.llm.scratch import Scratch
from quarrywork.llm.wordhash import mix, steps
from quarrywork.llm.workers import lean

SAMPLE_TEXTS = 4000
TOP_GRAMS, ALL_GRAMS = 50_000, 3_000_000
MIN_COUNT = 5
#: A language contains an n-gram if it is this share as frequent there as where it is most frequent.
SHARE = 0.25
MAX_LANGUAGES = 1024
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all trigrams of the texts, where each text's begin and end in them, and which texts have a letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap behind each word
    upto = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    y = np.concatenate([[0], np.where(letter, points, 0)[keep], [0]]).astype(np.uint64)
    edges = np.concatenate([[0], upto[ends]])
    middle = y[1:-1] != 0
    keys = ((y[:-2] << np.uint64(42)) | (y[1:-1] << np.uint64(21)) | y[2:])[middle]
    cuts = np.concatenate([[0], np.cumsum(middle)])[edges]
    return keys, cuts, np.diff(cuts) > 0


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """For each n-gram, the words of the bitmask of the languages that contain it: language k has bit k % 64 of word k // 64."""
        h, low = mix(keys), np.uint64(len(self.table) - 1)
        table = self.table[:, 0] if self.table.shape[1] == 1 else self.table  # numpy looks up single words faster than rows
        return (table[h & low] & table[(h >> np.uint64(21)) & low] & table[(h >> np.uint64(42)) & low]).reshape(len(keys), -1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b in steps([len(t) for t in texts]):
            keys, cuts, lettered = _grams(texts[a:b])
            masks, n = self.masks(keys), np.maximum(np.diff(cuts), 1)
            share = np.zeros((b - a, len(self.languages)))
            for k, rate in enumerate(self.false_rate):
                hits = np.concatenate([[0], np.cumsum((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)])
                share[:, k] = ((hits[cuts[1:]] - hits[cuts[:-1]]) / n - rate) / (1 - rate)
            best = share.argmax(axis=1) if self.languages else np.zeros(b - a, int)
            good = lettered & bool(self.languages)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, good, strict=True)]
            scores.append(np.where(good, np.clip(share[np.arange(b - a), best], 0, 1) if self.languages else 0.0, 0.0))
        return names, np.concatenate(scores) if scores else np.empty(0)


def _count(languages: list[str]):
    at = {name: k for k, name in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                texts = part["text"].tolist()
                for a, b in steps([len(t) for t in texts], 1 << 20):
                    keys, n = np.unique(_grams(texts[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"lang": np.int32(at[name]), "gram": keys.view(np.int64), "n": n.astype(np.int64)})

    return run


def _at(values: list, index: str) -> Column:
    """The value of a short list at an index column."""
    return F.element_at(F.array(*map(F.lit, values)), F.col(index) + 1)


def _thresholds(counts: list[tuple[int, int, int]], languages: int, most: int) -> list[int]:
    """For each language the least count whose n-grams, with all more frequent ones, are at most most. counts: (language, count, n-grams that have it)."""
    least, held, shut = [1 << 62] * languages, [0] * languages, [False] * languages
    for k, n, grams in sorted(counts, key=lambda x: -x[1]):
        held[k] += grams
        shut[k] = shut[k] or held[k] > most
        least[k] = least[k] if shut[k] else n
    return least


def build(languages: list[str], of: np.ndarray, grams: np.ndarray) -> Filters:
    """Filters that hold grams[i] for language of[i]."""
    most = int(np.bincount(of).max()) if len(of) else 1
    slots, words = 1 << max(12, int(np.ceil(np.log2(12 * most)))), -(-len(languages) // 64)
    table = np.zeros((slots, words), np.uint64)
    h, low = mix(grams), np.uint64(slots - 1)
    bits = np.uint64(1) << (of % 64).astype(np.uint64)
    for shift in (0, 21, 42):
        np.bitwise_or.at(table, (((h >> np.uint64(shift)) & low).astype(np.int64), of // 64), bits)
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Filters(languages, table, fill**3)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> Filters:
    """Filters from the non-null texts and languages of labelled."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = rows.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(MAX_LANGUAGES).collect()
    names = [r[0] for r in sorted(counts, key=lambda r: (-r["n"], r[0]))]
    if not names:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    share = {r[0]: int(1_000_000 * min(1.0, sample_texts / r["n"])) for r in counts}
    part = F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(1_000_000))
    shares = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    sample = rows.filter(part < F.coalesce(F.try_element_at(shares, F.col(lang)), F.lit(0))).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    scratch = Scratch(labelled.sparkSession, "langs")
    grams = scratch.write(sample.mapInPandas(lean(_count(names)), "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    # Sums and counts by language, a few rows, come from partial aggregates: no language gathers in one task.
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rated = grams.withColumn("rate", F.col("n") / _at([totals.get(k, 1) for k in range(len(names))], "lang")).filter(F.col("n") >= MIN_COUNT)
    common = rated.withColumn("top", F.max("rate").over(W.partitionBy("gram"))).filter(F.col("rate") >= SHARE * F.col("top"))
    common = scratch.write(common.select("lang", "gram", "n"), "common")
    how_many = [tuple(r) for r in common.groupBy("lang", "n").agg(F.count("*").alias("grams")).collect()]
    least = _thresholds(how_many, len(names), min(TOP_GRAMS, ALL_GRAMS // len(names)))
    found = common.filter(F.col("n") >= _at(least, "lang")).select("lang", "gram").toPandas()  # at most ALL_GRAMS
    scratch.drop()
    return build(names, found["lang"].to_numpy().astype(np.int64), found["gram"].to_numpy().astype(np.int64).view(np.uint64))


def _predict(filters: Filters):
    """Arrow batches (key, text): the key goes through as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = filters.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [batch.schema.names[0], "lang_pred", "score"])

    return run


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of the key's text leaves no remainder by 5: such rows are never learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score)."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias(key), F.col(text).alias("_text")).mapInArrow(lean(_predict(filters)), f"`{key}` {kind}, lang_pred string, score double")


#: Least share of a text's n-grams that its language must contain, for keep_known.
LEAST_SCORE = 0.2


def keep_known(docs: DataFrame, least_score: float = LEAST_SCORE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose text is in a learned language; texts in none, or without a letter, go."""
    filters = train(docs.filter(~held_out(F.col(key))), text, lang, key)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = filters.predict([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.drop("lang"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
