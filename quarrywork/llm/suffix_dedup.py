"""Removal of long repeated byte strings, by a sampled suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere.

1. Suffixes are sampled by content: of the GRAM-byte strings inside each
   LENGTH-byte window, the one of least hash (the leftmost of equals) is its
   anchor. Equal windows have their anchors at the same place inside them, so it
   is enough to compare windows with suffixes that begin at an anchor; there is
   one to about 85 bytes. An anchor's row holds the range of windows it stands for.
2. Anchors are dealt by a hash of their GRAM leading bytes; those that occur
   once are done with.
3. Of the rest, the suffix and the bytes before it are cut from the texts.
   Sampled splitters range-partition the suffixes by their bytes, then by those
   before, so that buckets are ranges of the suffix order and a very common
   passage spreads over tasks. A bucket is sorted locally by multikey quicksort,
   8 bytes a symbol, split three ways by the symbol of each segment's middle
   row, and longest common prefixes are taken of neighbours. Windows that begin
   o bytes before an anchor are equal if the suffixes lie in one run of common
   prefixes of LENGTH - o bytes, and the o bytes before are equal.
4. Only runs that touch a task's first or last suffix can go on in another task.
   Their windows' hashes, once for each value in a task, meet in a further
   aggregation: the comparison across boundaries.

Texts that equal each other take part once; all their bytes go if they have
LENGTH or more. Equality of windows is by 64-bit hashes inside one anchor's
group, and of texts by a 64-bit hash and their length.

Defined results
  null or empty text   0 bytes, nothing removed
  under LENGTH bytes   nothing removed
  null doc_id          kept, as any value
  repeated rows        equal texts: all bytes go from LENGTH bytes on
  very long text       in pieces that overlap by LENGTH - 1 bytes
  cut characters       bytes go, so kept text may break a character; kept_text replaces it
  empty table          no rows
  extra columns        ignored
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.llm.scratch import Scratch
from quarrywork.llm.wordhash import _CODE, mix, powers, steps
from quarrywork.llm.workers import lean

LENGTH, GRAM = 200, 32
WINDOW = LENGTH - GRAM + 1
PIECE = 1 << 20
_POS = np.uint64((1 << 22) - 1)
CHUNK = 4096


def anchors(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that end at ends in data: anchors' places, hashes of their GRAM bytes, and the first and last window each stands for."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    none = tuple(np.empty(0, np.int64) for _ in range(4))
    if n < LENGTH:
        return none
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODE[raw] * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    inside = np.ones(len(least), bool)
    for e in ends[:-1].tolist():  # no window runs from one text into the next
        inside[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    at = (least[starts] & _POS).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], grams[at[first]].view(np.int64), starts[first], starts[last]


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, piece) of a text; every window lies in one piece."""
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        yield at, text[at : at + PIECE + LENGTH - 1]


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        pieces = [(t, at, p) for t, text in zip(batch["t"], batch["text"], strict=True) for at, p in _pieces(text.encode())]
        for i, j in steps([len(p) for _, _, p in pieces]):
            part = pieces[i:j]
            ends = np.cumsum([len(p) for _, _, p in part])
            pos, gram, a, b = anchors(b"".join(p for _, _, p in part), ends)
            k = np.searchsorted(ends, pos, side="right")
            base = np.array([at for _, at, _ in part], np.int64)[k] - (ends - [len(p) for _, _, p in part])[k]
            # The place, and how far before it the first and the last window begin.
            packed = ((pos + base) << 16) | ((pos - a) << 8) | (pos - b)
            yield pd.DataFrame({"h": gram, "t": np.array([t for t, _, _ in part], np.int64)[k], "p": packed})


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by h, those whose h another row has; a task's first and last h always, as it may go on elsewhere."""
    held, known = None, True
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        h = b["h"].to_numpy()
        if not len(h):
            continue
        keep = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= known  # the first of all, or held back from a group that is to stay
        tail = int(np.searchsorted(h, h[-1]))
        yield b.iloc[:tail][keep[:tail]]
        held = b.iloc[tail:]
        known = len(held) > 1 or (known and tail == 0)
        if len(held) > 1:
            yield held.iloc[:-1]
            held = held.iloc[-1:]
    if held is not None:
        yield held


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows: list[tuple] = []
        for t, text, found in zip(batch["t"], batch["text"], batch["found"], strict=True):
            raw = text.encode()
            for x in found:
                pos, back, least = x["p"] >> 16, (x["p"] >> 8) & 255, x["p"] & 255
                rows.append((x["h"], raw[pos : pos - least + LENGTH], raw[pos - back : pos], t, x["p"]))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=["h", "suffix", "before", "t", "p"])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=["h", "suffix", "before", "t", "p"])


def multikey_order(group: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The order of rows by group, then by their symbols from left to right.

    Multikey quicksort, all segments of a round at once: each one's middle row
    has the pivot; rows with a smaller, an equal and a larger symbol become
    segments of their own, and the equal ones go on with the next symbol.
    """
    order = np.argsort(group, kind="stable")
    spots, depth = np.arange(len(order)), np.zeros(len(order), np.int64)
    segment = np.cumsum(np.diff(group[order], prepend=group[order[:1]]) != 0)
    while True:
        begin = np.flatnonzero(np.diff(segment, prepend=-1))
        size = np.diff(begin, append=len(segment))
        open_ = np.repeat(size > 1, size) & (depth < symbols.shape[1])
        if not open_.any():
            return order
        spots, depth, segment = spots[open_], depth[open_], segment[open_]
        begin = np.flatnonzero(np.diff(segment, prepend=-1))
        size = np.diff(begin, append=len(segment))
        rows = order[spots]
        key = symbols[rows, depth]
        pivot = np.repeat(key[begin + size // 2], size)
        part = np.repeat(3 * np.arange(len(begin)), size) + (key > pivot) + (key >= pivot)
        by = np.argsort(part, kind="stable")
        order[spots], segment = rows[by], part[by]
        depth = depth[by] + (segment % 3 == 1)


def _solve(rows: pd.DataFrame, top: bool, bottom: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """Spans (t, s, e) of windows that repeat among whole groups of rows; and, if the first group goes on above or the last below, (w, n, t, s): windows that may repeat there."""
    n = len(rows)
    right = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in rows["suffix"]), np.uint8).reshape(n, LENGTH)
    left = np.frombuffer(b"".join(x.rjust(LENGTH, b"\0") for x in rows["before"]), np.uint8).reshape(n, LENGTH)
    h = rows["h"].to_numpy()
    order = multikey_order(np.cumsum(np.diff(h, prepend=h[:1]) != 0), right.view(">u8").astype(np.uint64))
    right, left, h = right[order], left[order], h[order]
    t, p = rows["t"].to_numpy()[order], rows["p"].to_numpy()[order]
    pos, far, near = p >> 16, (p >> 8) & 255, p & 255
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common[h[1:] != h[:-1]] = -1
    common = np.concatenate([[-1], common])
    first, last = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    hash_left, up = np.zeros(n, np.uint64), powers(2 * LENGTH)[0]
    opened: list[pd.DataFrame] = []
    edge = top or bottom
    if edge:
        sums = np.zeros((n, LENGTH + 1), np.uint64)
        np.cumsum(_CODE[right] * up[LENGTH : 2 * LENGTH], axis=1, out=sums[:, 1:])
    for o in range(WINDOW):
        if o:
            hash_left = hash_left + _CODE[left[:, LENGTH - o]] * up[o]
        ok = np.flatnonzero((near <= o) & (o <= far))
        if not len(ok):
            continue
        run = np.cumsum(common < LENGTH - o)
        key = mix(hash_left + run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[ok]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        if same.any():
            hit = np.zeros(len(ok), bool)
            hit[by[1:]] |= same
            hit[by[:-1]] |= same
            rows_hit = ok[hit]
            last[rows_hit] = np.where(last[rows_hit] < 0, o, last[rows_hit])
            first[rows_hit] = o
        if edge:
            touch = (run[ok] == run[0]) if top else np.zeros(len(ok), bool)
            touch |= (run[ok] == run[-1]) if bottom else False
            some = ok[touch]
            if len(some):
                w = mix(mix(h[some].view(np.uint64) + np.uint64(o)) ^ mix(hash_left[some]) ^ mix(sums[some, LENGTH - o] + np.uint64(0x632BE59BD9B4E019)))
                value, at, count = np.unique(w, return_index=True, return_counts=True)
                spot = some[at]
                opened.append(pd.DataFrame({"w": value.view(np.int64), "n": count, "t": t[spot], "s": pos[spot] - o}))
    # o counts back from the anchor: the largest o is the first window.
    hit = np.flatnonzero(first >= 0)
    spans = pd.DataFrame({"t": t[hit], "s": pos[hit] - first[hit], "e": pos[hit] - last[hit] + LENGTH})
    return spans, pd.concat(opened) if opened else None


def _first_run(h: np.ndarray) -> int:
    """How many values equal the first one, from there on."""
    other = h != h[0]
    return int(other.argmax()) if other.any() else len(h)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with those of one h side by side: spans (w null), and open windows."""

    def out(rows: pd.DataFrame, top: bool, bottom: bool) -> Iterator[pd.DataFrame]:
        spans, opened = _solve(rows, top, bottom)
        if len(spans):
            yield pd.DataFrame({"w": pd.array([None] * len(spans), "Int64"), "n": np.int64(0), **{c: spans[c] for c in ("t", "s", "e")}})
        if opened is not None:
            yield pd.DataFrame({"w": pd.array(opened["w"], "Int64"), "n": opened["n"].to_numpy(), "t": opened["t"].to_numpy(), "s": opened["s"].to_numpy(), "e": opened["s"].to_numpy() + LENGTH})

    held: list[pd.DataFrame] = []
    size, top = 0, True
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        size += len(b)
        if size < CHUNK:
            continue
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        h = rows["h"].to_numpy()
        if top and h[0] != h[-1]:  # the task's first group alone
            cut = _first_run(h)
            yield from out(rows.iloc[:cut], True, False)
            rows, h, top = rows.iloc[cut:], h[cut:], False
        if not top:
            # Whole groups; the last may go on.
            edges = np.flatnonzero(h[1:] != h[:-1]) + 1
            begin = 0
            for cut in edges.tolist():
                if cut - begin >= CHUNK or cut == edges[-1]:
                    part = rows.iloc[begin:cut]
                    if len(part) > 1:
                        yield from out(part, False, False)
                    begin = cut
            rows = rows.iloc[begin:]
        held, size = [rows], len(rows)
    if held and size:
        rows = pd.concat(held, ignore_index=True)
        h = rows["h"].to_numpy()
        cut = _first_run(h) if top else 0
        tail = len(h) - _first_run(h[::-1])
        if top and tail == 0:
            yield from out(rows, True, True)
            return
        if cut:
            yield from out(rows.iloc[:cut], True, False)
        if tail - cut > 1:
            yield from out(rows.iloc[cut:tail], False, False)
        yield from out(rows.iloc[tail:], False, True)


def find_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(t, n, spans): for each text with repeated windows, by its hash and length, the byte ranges to remove, in no order. docs: (doc_id, t, n, text) of LENGTH bytes or more."""
    sampled = scratch.write(docs.select("t", "text").mapInPandas(lean(_sample), "h bigint, t bigint, p bigint"), "anchors")
    ordered = sampled.distinct().repartitionByRange("h", "t", "p").sortWithinPartitions("h")
    again = scratch.write(ordered.mapInPandas(lean(_repeated), "h bigint, t bigint, p bigint"), "repeated")
    scratch.drop("anchors")
    by_text = again.groupBy("t").agg(F.collect_list(F.struct("h", "p")).alias("found"))
    one = docs.groupBy("t").agg(F.min(F.struct("n", "doc_id")).alias("one")).select("t", "one.n", "one.doc_id")
    chosen = by_text.join(one, "t").withColumnsRenamed({"t": "_t", "n": "_n", "doc_id": "_d"})
    texts = docs.join(chosen, (docs["t"] == chosen["_t"]) & docs["doc_id"].eqNullSafe(chosen["_d"])).select("t", "text", "found")
    cut = scratch.write(texts.mapInPandas(lean(_cut), "h bigint, suffix binary, before binary, t bigint, p bigint"), "suffixes")
    # In the order of suffixes; inside a task the rows of one anchor, which share their first GRAM bytes, stand together.
    bucketed = cut.repartitionByRange("suffix", "before", "t").sortWithinPartitions(F.substring("suffix", 1, GRAM))
    found = scratch.write(bucketed.mapInPandas(lean(_compare), "w bigint, n bigint, t bigint, s bigint, e bigint"), "spans")
    scratch.drop("suffixes")
    opened = found.filter("w IS NOT NULL")
    shared = opened.groupBy("w").agg(F.sum("n").alias("all")).filter("all > 1")
    across = opened.filter("n = 1").join(shared, "w").select("t", "s", "e")
    spans = found.filter("w IS NULL").select("t", "s", "e").unionByName(across)
    return spans.groupBy("t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def merge(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for s, e in sorted((int(x["s"]), int(x["e"])) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for s, e in runs:
        parts.append(text[at:s])
        at = e
    return b"".join([*parts, text[at:]])


def _finish(digest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, n, copies, spans in zip(batch["doc_id"], batch["text"], batch["n"], batch["copies"], batch["spans"], strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                runs = [(0, n)] if copies > 1 and n >= LENGTH else merge(spans) if spans is not None else []
                kept = _kept(raw, runs)
                removed = sum(e - s for s, e in runs)
                last = hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")
                rows.append((doc, n, removed, len(runs), last))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "last"])

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_text), or kept_sha256 of the remaining bytes in place of the text."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    kind = docs.schema[key].dataType.simpleString()
    value = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("doc_id"), value.alias("text"), F.octet_length(value).cast("bigint").alias("n"))
    named = named.withColumn("t", F.xxhash64("text", F.lit(9)))
    spans = find_repeats(named.filter(F.col("n") >= LENGTH), scratch)
    copies = named.filter(F.col("n") >= LENGTH).groupBy("t", "n").agg(F.count("*").alias("copies"))
    per_text = copies.join(spans, "t", "left").filter("copies > 1 OR spans IS NOT NULL")
    joined = named.join(per_text, ["t", "n"], "left").select("doc_id", "text", "n", F.coalesce("copies", F.lit(1)).alias("copies"), F.when(F.col("copies") > 1, None).otherwise(F.col("spans")).alias("spans"))
    name = "kept_sha256" if digest else "kept_text"
    out = joined.mapInPandas(lean(_finish(digest)), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, last string")
    return scratch.write(out.withColumnsRenamed({"doc_id": key, "last": name}), "result")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
