"""Token ids in entropy-coded binary blocks.

The file format is a folder: ``blocks`` (a row for each block: shard, its first
document's place in the shard, document ids and lengths, and the coded bytes,
see :mod:`quarrywork.llm.rans`) and ``table`` (the shared frequency table).
Documents stand in ascending doc_id order over the shards, which sampled
splitters make; a block holds whole documents, BLOCK_TOKENS ids or the few more
that its last document has. Spark's committed writer makes the files, so a lost
executor leaves no half-written one.

Defined results
  null or empty text   the end id alone
  null doc_id          before all others
  doc_id               of any type that has an order; whole numbers exact
  repeated doc_ids     kept, in the order of their ids' bytes
  very long text       one block of its own at most; never cut
  empty table          no blocks
  extra columns        ignored
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from quarrywork.llm import rans
from quarrywork.llm.scratch import Scratch
from quarrywork.llm.workers import lean

BLOCK_TOKENS = 1 << 17
#: Distinct words a worker remembers, bits of its hash table, and bytes of text encoded at a time.
CACHE_WORDS, TABLE_BITS, STEP_BYTES = 1_500_000, 22, 1 << 19
_encoders: dict[str, WordEncoder] = {}
#: Letters under it are as normalisation leaves them and have one-letter lower-case forms.
_PLAIN = "\u0130"


class _HashTable:
    """From 64-bit hashes to numbers, open addressing, many at a time."""

    def __init__(self, bits: int):
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers; -1 for what isn't there."""
        out, todo, slot = np.full(len(h), -1, np.int32), np.arange(len(h)), self._slot(h)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that aren't there yet."""
        slot = self._slot(h)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]  # of two for one slot, the last gets it
            own = self.keys[slot] == h
            self.values[slot[own]] = values[own]
            h, values, slot = h[~own], values[~own], (slot[~own] + 1) & self.mask


class WordEncoder:
    """Encodes texts by their words, each by the library once while it is remembered.

    The tokenizer drops white space and no token, contraction or composition
    spans it, so a text's ids are its words' ids in order. It lower-cases, and
    parts letters from punctuation, so A-Z are lower-cased first and a full
    stop or comma at a word's end behind a letter is a word of its own. New
    words of plain letters go to the library many at a time and are told apart
    by their last tokens, which alone bear the end-of-word mark.

    Words are found by 64-bit hashes, computed for all words of a step at once
    from prefix sums over its bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        one, two, three, four, five, six = self._raw(["ab cd", "ab", "cd", "Ab,", ",", "\u00c9,"])
        parted = [*two, *three] == [*one] and [*two, *five] == [*four] and six[-1] == five[0]
        if not (suffix and parted):
            raise ValueError(f"{path} doesn't part words and lower-case letters as this encoder needs")
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.gap = np.isin(np.arange(256), [9, 10, 13, 32])
        self.letter = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
        self.base = 0xD1342543DE82EF95
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.table, self.n, self.used = _HashTable(TABLE_BITS), 0, 0
        self.starts, self.lens, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.kind)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, ids: np.ndarray, lens: np.ndarray) -> None:
        def grown(a: np.ndarray, n: int) -> np.ndarray:
            return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

        n, used = self.n + len(lens), self.used + len(ids)
        self.starts, self.lens, self.flat = grown(self.starts, n), grown(self.lens, n), grown(self.flat, used)
        self.flat[self.used : used] = ids
        self.lens[self.n : n] = lens
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.n, self.used = n, used

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        plain = np.fromiter((w.isalpha() and max(w) < _PLAIN for w in words), bool, len(words))
        rows = np.flatnonzero(plain)
        for k in range(0, len(rows), 1000):
            some = rows[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, self.kind)
            lens = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            if len(lens) != len(some):  # not parted as expected: one by one
                plain[some] = False
                continue
            self.table.add(hashes[some], np.arange(self.n, self.n + len(some), dtype=np.int32))
            self._remember(ids, lens)
        rows = np.flatnonzero(~plain)
        if len(rows):
            each = self._raw([words[i] for i in rows])
            self.table.add(hashes[rows], np.arange(self.n, self.n + len(rows), dtype=np.int32))
            self._remember(np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and the texts' numbers of ids."""
        raw = [t.encode() for t in texts]
        data = b"\n".join(raw) + b"\n"
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        plain = np.frombuffer(data, np.uint8)
        text = plain if b"<|" in data else self.lower[plain]  # special tokens keep their case
        n = len(text)
        if n > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(n + 1, self.base, np.uint64)) * np.uint64(self.inverse)
                self.inverses = np.cumprod(np.full(n + 1, self.inverse, np.uint64)) * np.uint64(self.base)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[text] * self.powers[:n], out=sums[1:])
        edge = np.diff(self.gap[text].view(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
        if edge[0] == 1:
            raise AssertionError
        last, before, second = text[ends - 1], text[ends - 2], text[np.maximum(ends - 3, 0)]
        latin = (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (ends - starts >= 3)
        marked = np.flatnonzero(((last == 44) | (last == 46)) & (ends - starts >= 2) & (self.letter[before] | latin))
        starts, ends = np.insert(starts, marked + 1, ends[marked] - 1), np.insert(ends, marked, ends[marked] - 1)
        hashes = (sums[ends] - sums[starts]) * self.inverses[starts]
        hashes[hashes == 0] = 1
        if self.n > CACHE_WORDS:
            self._forget()
        at = self.table.find(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            some, first = np.unique(hashes[new], return_index=True)
            lowered, spots = text.tobytes(), new[first]
            self._learn([lowered[a:b].decode() for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)], some)
            at[new] = self.table.find(hashes[new])
        lens = self.lens[at]
        upto = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(self.starts[at] - upto[:-1], lens) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, np.cumsum(sizes))]
        return np.insert(ids, cuts, end_id), np.diff(cuts, prepend=0) + 1


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of about STEP_BYTES characters each."""
    first = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= STEP_BYTES:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard, seq = TaskContext.get().partitionId(), 0
        enc = _encoder(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["_text"]]
            for a, b in _steps(texts):
                ids, n = enc.encode(texts[a:b], end_id)
                raw, w = ids.tobytes(), ids.itemsize
                cuts = np.concatenate([[0], np.cumsum(n)]) * w
                rows = [raw[i:j] for i, j in itertools.pairwise(cuts.tolist())]
                yield pd.DataFrame({"shard": np.int32(shard), "seq": np.arange(seq, seq + b - a), "doc_id": batch["_key"].array[a:b], "known": batch["_known"].array[a:b], "width": np.int32(w), "ids": rows})
                seq += b - a

    return run


def _ids(row_ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(row_ids, f"<u{width}")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for width, group in b.groupby("width"):
            c = np.bincount(np.frombuffer(b"".join(group["ids"]), f"<u{width}"))
            total = (c + np.pad(total, (0, len(c) - len(total)))) if len(c) > len(total) else total + np.pad(c, (0, len(total) - len(c)))
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen.astype(np.int64), "n": total[seen].astype(np.int64)})


def _block(freqs: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = rans.Table(np.frombuffer(freqs, "<u4"))
        held: list[tuple] = []

        def flush():
            ids = np.concatenate([x[3] for x in held])
            return pd.DataFrame(
                {
                    "shard": [np.int32(held[0][0])],
                    "seq": [held[0][1]],
                    "n_tokens": [len(ids)],
                    "doc_ids": [[x[2] if x[4] else None for x in held]],
                    "lengths": [[len(x[3]) for x in held]],
                    "block": [rans.encode(ids, table)],
                }
            )

        n = 0
        for b in batches:
            for shard, seq, doc, known, width, ids in zip(b["shard"], b["seq"], b["doc_id"].tolist(), b["known"].tolist(), b["width"], b["ids"], strict=True):
                if held and (n >= BLOCK_TOKENS or (shard, seq) != (held[-1][0], held[-1][1] + 1)):
                    yield flush()
                    held, n = [], 0
                held.append((shard, seq, doc, _ids(ids, width), known))
                n += len(held[-1][3])
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Encodes the texts and writes them in the file format above to the folder path."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    kind, integral = docs.schema[key].dataType.simpleString(), isinstance(docs.schema[key].dataType, IntegralType)
    ordered = docs.select(key, text).repartitionByRange(F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    # Nulls travel as a flag: beside them, pandas would make whole numbers floats.
    filled = F.coalesce(F.col(key), F.lit(0).cast(kind)) if integral else F.col(key)
    named = ordered.select(filled.alias("_key"), F.col(key).isNotNull().alias("_known"), F.col(text).alias("_text"))
    tokens = scratch.write(named.mapInPandas(lean(_tokenise(tokenizer_path, end_id)), f"shard int, seq bigint, doc_id {kind}, known boolean, width int, ids binary"), "ids", group_mb=32)
    counted = tokens.select("width", "ids").mapInPandas(lean(_count), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.collect()  # at most a row for each id of the vocabulary
    counts = np.zeros(max([0, *(r.id + 1 for r in found)]), np.int64)
    for r in found:
        counts[r.id] = r.n
    freqs = rans.quantise(counts).astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(freqs),)], "freqs binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    blocks = tokens.mapInPandas(lean(_block(freqs)), f"shard int, seq bigint, n_tokens bigint, doc_ids array<{kind}>, lengths array<int>, block binary")
    blocks.write.mode("overwrite").option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(f"{path}/blocks")
    scratch.drop()


def _read(freqs: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = rans.Table(np.frombuffer(freqs, "<u4"))
        for b in batches:
            for shard, seq, docs, known, lengths, block in zip(b["shard"], b["seq"], b["doc_ids"], b["known"], b["lengths"], b["block"], strict=True):
                raw = rans.decode(block, table).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                yield pd.DataFrame({"shard": np.int32(shard), "seq": seq, "doc_id": docs if isinstance(docs, np.ndarray) else pd.array(docs, dtype="object"), "known": known, "at": ends - lengths, "ids": [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths, strict=True)]})

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a written folder; with digest, ids_crc32 in place of ids (4 bytes each, little-endian)."""
    freqs = bytes(spark.read.parquet(f"{path}/table").first().freqs)
    blocks = spark.read.parquet(f"{path}/blocks")
    key = blocks.schema["doc_ids"].dataType.elementType
    kind = key.simpleString()
    sizes = blocks.select("shard", "seq", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("shard").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("within", within).join(shards.select("shard", "before"), "shard").select("shard", "seq", (F.col("before") + F.col("within")).alias("base"))
    filled = (lambda x: F.coalesce(x, F.lit(0).cast(kind))) if isinstance(key, IntegralType) else (lambda x: x)  # see write_tokens
    coded = blocks.withColumns({"known": F.transform("doc_ids", lambda x: x.isNotNull()), "doc_ids": F.transform("doc_ids", filled)})
    if digest:
        docs = coded.mapInPandas(lean(_digest(freqs)), f"shard int, seq bigint, doc_id {kind}, known boolean, at bigint, n_tokens bigint, ids_crc32 bigint")
    else:
        docs = coded.mapInPandas(lean(_read(freqs)), f"shard int, seq bigint, doc_id {kind}, known boolean, at bigint, ids binary").withColumn("n_tokens", (F.octet_length("ids") / 4).cast("bigint"))
    return docs.join(offsets, ["shard", "seq"]).select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def _digest(freqs: bytes):
    read = _read(freqs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in read(batches):
            ids = b.pop("ids")
            b["n_tokens"] = [len(x) // 4 for x in ids]
            b["ids_crc32"] = [zlib.crc32(x) for x in ids]
            yield b

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the documents' tokens to the shared folder, reads them back and returns their digests."""
    path = f"{Scratch(docs.sparkSession, 'tokenfiles').path}/files"
    write_tokens(docs, path, tokenizer_path or default_tokenizer(), end_id)
    return read_tokens(docs.sparkSession, path, digest=True)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
