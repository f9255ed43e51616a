"""Runs of periodic words, by Karp-Miller-Rosenberg names.

A run is a longest stretch of words with a smallest period q that repeats it
at least MIN_EXPONENT times. Level k names each window of 2 ** k words: equal
windows of one text, and only those, have equal names, and a level's names are
the ranks of pairs of the level below. Windows that occur once stop there,
so higher levels hold repeated text only. The longest common extension of two
places, to the right or the left, descends the levels. A run of period p and
four periods has w[i] = w[i + p] over at least 3p places, so one of the grid
0, 3p, 6p, ... lies in it: pairs (g, g + p) with equal words are the candidates,
and extending them both ways gives the run. Pairs of a period that a smaller
one divides give the same stretch and go.

Texts of a batch are named together, longest first, so that the grid of a
period covers the front of the batch; names of two texts never meet.

Bounds: the places of one text's grid are n log n / 3, taken in pieces; names
take 4 bytes a word and level. A batch ends at BATCH_WORDS words, a single text
isn't cut: it is one task's work, about 100 bytes a word.

Defined results
  null or empty text, no word   no runs, collapsed text ""
  null or repeated keys, equal texts   each row for itself
  very long texts               whole, see bounds
  empty table                   no rows
  extra columns                 kept by ``keep``; the added names are RUN_COLUMNS
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrywork.llm.exprs import indices, let, space_words, text_or_empty
from quarrywork.llm.workers import lean

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN_COLUMNS = ("n_words", "runs", "collapsed")
#: Words named together, and grid places held together.
BATCH_WORDS, GRID_PLACES = 1 << 18, 1 << 20
RUNS_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each key among the distinct ones, and whether it occurs again."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names.astype(np.int64), counts[names] > 1


def name_levels(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Level k: a name for the window of 2 ** k words at each place; windows that occur once, or pass the end, have negative names of their own.

    words: numbers, equal only for equal words of one text.
    """
    n = len(words)
    alone = -1 - np.arange(n, dtype=np.int32)

    def level(at: np.ndarray, names: np.ndarray, again: np.ndarray) -> np.ndarray:
        out = alone.copy()
        out[at[again]] = names[again]
        return out

    names, again = _ranks(words)
    levels = [level(np.arange(n), names, again)]
    at, width = np.flatnonzero(again), 1
    while len(at) and 2 * width <= longest:
        below = levels[-1]
        at = at[at + width < n]
        at = at[below[at + width] >= 0]
        names, again = _ranks(below[at].astype(np.int64) * n + below[at + width])
        if not again.any():
            break
        levels.append(level(at, names, again))
        at, width = at[again], 2 * width
    return levels


def common_right(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i on equal those from j on (i < j)."""
    n, far = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i + far, j + far
        open_ = b < n
        same = np.zeros(len(i), bool)
        same[open_] = levels[k][a[open_]] == levels[k][b[open_]]
        far += same * (1 << k)
    return far


def common_left(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i equal those before j (i < j)."""
    far = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = i - far - (1 << k), j - far - (1 << k)
        open_ = a >= 0
        same = np.zeros(len(i), bool)
        same[open_] = levels[k][a[open_]] == levels[k][b[open_]]
        far += same * (1 << k)
    return far


def _grid(ends: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (g, p) with g a multiple of 3p and g + p before the period's end."""
    sizes = np.maximum(0, -(-(ends - periods) // (3 * periods)))
    p = np.repeat(periods, sizes)
    k = np.arange(len(p)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return 3 * p * k, p


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs in texts that follow each other, longest first.

    words: numbers as for name_levels; sizes: the words of each text.
    """
    longest = int(sizes[0]) if len(sizes) else 0
    if longest < MIN_LENGTH:
        return np.zeros((0, 3), np.int64)
    levels = name_levels(words, longest)
    periods = np.arange(1, longest // MIN_EXPONENT + 1)
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(-sizes, -MIN_EXPONENT * periods, "right")]
    places = np.cumsum(np.maximum(0, -(-(ends - periods) // (3 * periods))))
    found, first = [], 0
    while first < len(periods):
        last = max(first + 1, int(np.searchsorted(places, (places[first - 1] if first else 0) + GRID_PLACES, "right")))
        g, p = _grid(ends[first:last], periods[first:last])
        same = levels[0][g] == levels[0][g + p]
        g, p = g[same], p[same]
        left = common_left(levels, g, g + p)
        length = left + common_right(levels, g, g + p) + p
        start = g - left
        long_ = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
        found.append(np.stack([start[long_], length[long_], p[long_]], axis=1))
        first = last
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))[: len(runs)]]  # a stretch's smallest period
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeats(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) > 0


def _batch_runs(texts) -> list:
    """For an Arrow array of texts without nulls: the columns RUN_COLUMNS."""
    import pyarrow as pa
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(texts)
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(flat), 0)
    flat, of = flat.filter(real), of[real.to_numpy(zero_copy_only=False)]
    n_texts = len(texts)
    sizes = np.bincount(of, minlength=n_texts)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")  # longest first
    codes = flat.dictionary_encode()
    codes = (codes.indices.to_numpy().astype(np.int64) + of.astype(np.int64) * max(1, len(codes.dictionary))) if len(flat) else np.zeros(0, np.int64)
    by_size = sizes[order]
    shift = np.cumsum(by_size) - by_size
    take = np.arange(len(codes)) + np.repeat(starts[order] - shift, by_size)
    runs = find_runs(codes[take], by_size)
    rank = np.searchsorted(shift, runs[:, 0], "right") - 1
    # Texts without a word share the place of the text behind them; a run belongs to the text that has words there.
    runs = np.stack([runs[:, 0] - shift[rank] + starts[order[rank]], runs[:, 1], runs[:, 2]], axis=1) if len(runs) else runs
    owner = order[rank] if len(runs) else np.zeros(0, np.int64)
    kept = ~repeats(runs, len(codes))
    sorted_ = np.lexsort((runs[:, 2], runs[:, 0], owner))
    runs, owner = runs[sorted_], owner[sorted_]

    def offsets(counts: np.ndarray):
        return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())

    words = pa.ListArray.from_arrays(offsets(np.bincount(of[kept], minlength=n_texts)), flat.filter(pa.array(kept)))
    columns = [pa.array(runs[:, 0] - starts[owner] if len(runs) else runs[:, 0]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    items = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
    return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets(np.bincount(owner, minlength=n_texts)), items), pc.binary_join(words, " ")]


def _step(batches: Iterator) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("_text"))
        held = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            # A word and its space take two bytes or more; real words about six.
            last = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + 6 * BATCH_WORDS, "right")))
            part = batch.slice(first, last - first)
            kept = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "_text"]
            names = [n for n in part.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(kept + _batch_runs(part.column(part.schema.get_field_index("_text"))), names=names + list(RUN_COLUMNS))
            first = last


def collapse_runs(docs: DataFrame, text: str | Column = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and each text's number of words, runs (start and period in words, from 0) and the text without their repeats, words joined by one space."""
    rows = docs.select(*[c for c in keep if c not in RUN_COLUMNS], text_or_empty(text).alias("_text"))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_text"] + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS_TYPE), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(lean(_step), schema)


def steepest(runs: Column) -> Column:
    """The run of greatest exact length / period; ties: the smallest start, then period. Null without runs."""
    nothing = F.lit(None).cast(RUNS_TYPE.elementType)
    steeper = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]  # noqa: E731  runs come by start and period
    return F.aggregate(runs, nothing, lambda a, b: F.when(a.isNull() | steeper(a, b), b).otherwise(a))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's edit: of each tenth document by checksum, words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(indices(F.size(x["w"])), lambda i: F.element_at(x["w"], F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int") + 1)), " "))

    return F.when(h % 10 == 0, let(space_words(text), lambda w: F.when(F.size(w) > 0, edited(w)).otherwise(text))).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = collapse_runs(docs, planted(text_or_empty("text"), F.col("doc_id")))
    best = steepest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
