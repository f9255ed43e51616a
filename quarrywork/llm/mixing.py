"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's words, its documents in a seeded order, are one stream cut into
blocks of equally many words. The mix consists of shards of equally many
blocks, and each source's quota in a shard is an integer: the seats that the
highest quotients target / (2 * seats + 1) give it. The method is
house-monotone, so a shard's quotas are the difference of two apportionments.
Blocks have BLOCK_WORDS words or more, so that there are about FINEST of them at
most; a source whose target is under LEAST_BLOCKS of those has smaller ones of
its own, down to a word, and quotas count them by targets in its blocks. So each
source ends within a block of its target, which is a thousandth or one word.
A source's blocks come in a seeded permutation, round after round (all but the
last take every block). The first shard gets as many of them as its quota says,
the second the next ones, and so on; the shard of each taken block follows from
its place in that order and the sums of the quotas, without a shuffle.

Only one row for each source reaches the driver (MAX_SOURCES bounds it; a
larger table raises). Documents find their place in the stream by prefix sums
in two levels, salts of the order's hash and rows within a salt, so a source
that holds most rows is spread over tasks; there are so many salts that one
holds about SALT_WORDS words of the largest source.

Defined results
  null or empty text   size 0, nothing taken
  very long text       spans many blocks, which may go to several shards
  null source          a source of its own, last in order
  repeated rows        placed one by one, ties in any order of equal rows
  empty table          no rows
  extra columns        kept; the added names are size, source_size, target, taken, shards
"""

from __future__ import annotations

import heapq
import itertools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.llm.exprs import let, space_words, text_or_empty

MAX_SOURCES = 1_000_000
MAX_REPEATS = 3
BLOCK_WORDS, LEAST_BLOCKS, FINEST = 1024, 1000, 1 << 24
SHARDS = 16
SALT_WORDS, LEAST_SALTS, MOST_SALTS = 1 << 24, 512, 1 << 22
BROADCAST_SALTS = 100_000
ADDED = ("size", "source_size", "target", "taken", "shards")


def n_words(text: str) -> Column:
    """Runs of anything but ASCII white space."""
    return F.size(space_words(text_or_empty(text))).cast("bigint")


def weights(n: int) -> list[int]:
    """Of the sources in order: 1, 2, 3, repeating."""
    return [1 + k % 3 for k in range(n)]


def targets(sizes: list[int], shares: list[float], limit: float = MAX_REPEATS) -> list[float]:
    """Shares of the sizes' sum; no more than limit times a source's size, the excess shared again by weight until none is above."""
    total, caps = float(sum(sizes)), [float(limit * s) for s in sizes]
    out, open_ = [0.0] * len(sizes), [k for k in range(len(sizes)) if caps[k] > 0]
    left = min(total, float(sum(caps)))
    while open_:
        unit = left / sum(shares[k] for k in open_)
        full = [k for k in open_ if shares[k] * unit > caps[k]]
        if not full:
            for k in open_:
                out[k] = shares[k] * unit
            break
        for k in full:
            out[k] = caps[k]
            left -= caps[k]
        closed = set(full)
        open_ = [k for k in open_ if k not in closed]
    return out


def apportion(wanted: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: seats go one by one to the highest wanted / (2 * seats + 1); ties to the first; none gets more than most.

    Begins at the rounded quotas, which the method passes through for some
    house size, so that only the difference to seats is dealt one by one.
    """
    total, seats = sum(wanted), min(seats, sum(m for w, m in zip(wanted, most, strict=True) if w > 0))
    if not total or seats <= 0:
        return [0] * len(wanted)
    got = [min(m, math.floor(w * seats / total + 0.5)) for w, m in zip(wanted, most, strict=True)]
    # Rounded quotas are an apportionment of their own sum; rise or fall from there by quotients.
    n = sum(got)
    up = [(-w / (2 * g + 1), k) for k, (w, g, m) in enumerate(zip(wanted, got, most, strict=True)) if w > 0 and g < m]
    heapq.heapify(up)
    while n < seats:
        _, k = heapq.heappop(up)
        got[k] += 1
        n += 1
        if got[k] < most[k]:
            heapq.heappush(up, (-wanted[k] / (2 * got[k] + 1), k))
    down = [(wanted[k] / (2 * g - 1), -k) for k, g in enumerate(got) if g > 0]
    heapq.heapify(down)
    while n > seats:
        _, k = heapq.heappop(down)
        got[-k] -= 1
        n -= 1
        if got[-k] > 0:
            heapq.heappush(down, (wanted[-k] / (2 * got[-k] - 1), k))
    return got


def shard_quotas(wanted: list[float], seats: int, most: list[int], shards: int) -> list[list[int]]:
    """For each shard, each source's blocks: differences of house-monotone apportionments."""
    marks = [apportion(wanted, seats * (k + 1) // shards, most) for k in range(shards)]
    return [[a - b for a, b in zip(now, before, strict=True)] for now, before in zip(marks, [[0] * len(wanted), *marks[:-1]], strict=True)]


def _stride(n: int, rng: random.Random) -> tuple[int, int]:
    """A seeded permutation b -> (b * step + shift) mod n."""
    step = max(1, int(n * rng.uniform(0.3, 0.7)))
    while math.gcd(step, n) != 1:
        step += 1
    return step % n if n > 1 else 1, rng.randrange(n)


def block_size(total: int, target: float, finest: int = FINEST) -> int:
    """Words of a source's block: by the whole table, and a thousandth of the source's target at most."""
    return max(1, min(max(BLOCK_WORDS, -(-total // finest)), int(target) // LEAST_BLOCKS))


def plan(sources: list[tuple[str | None, int]], block_words: int | None, seed: int, shards: int = 1) -> list[dict]:
    """For each source in order: target, block (its words), rounds, the permutation's step and shift, how many blocks of the last round it takes, and its quotas in the shards. block_words: one size for all sources."""
    sizes = [s for _, s in sources]
    aims = targets(sizes, weights(len(sizes)))
    words = [block_words or block_size(sum(sizes), aim) for aim in aims]
    blocks = [-(-s // w) for s, w in zip(sizes, words, strict=True)]
    # A block more than a source has in all its rounds is never taken; a source whose target is under half a block takes none.
    most = [MAX_REPEATS * b for b in blocks]
    wanted = [aim / w for aim, w in zip(aims, words, strict=True)]
    quotas = [list(q) for q in zip(*shard_quotas(wanted, round(sum(wanted)), most, shards), strict=True)] if sources else []
    out = []
    for (name, size), aim, word, n, q in zip(sources, aims, words, blocks, quotas, strict=True):
        step, shift = _stride(max(1, n), random.Random(f"{seed}:{name}"))
        rounds, rest = divmod(sum(q), n) if n else (0, 0)
        out.append({"source": name, "source_size": size, "target": aim, "block": word, "blocks": n, "rounds": rounds, "rest": rest, "step": step, "shift": shift, "quotas": q, "ends": list(itertools.accumulate(q))})
    return out


def _turn(b: Column, p: Column) -> Column:
    """The place of a source's block b in its permutation."""
    # step * b stays under 2 ** 63, as a source has at most 2 ** 31 blocks.
    return F.pmod(b * p["step"] + p["shift"], p["blocks"])


def _chosen(b: Column, p: Column) -> Column:
    """Whether a source's last round takes its block b: the permutation puts it among the first."""
    return _turn(b, p) < p["rest"]


def _shard(b: Column, turn: Column, p: Column) -> Column:
    """The shard that gets block b in a round: the first whose quota, with those before it, reaches over the block's place."""
    place = turn * p["blocks"] + _turn(b, p)
    return F.aggregate(p["ends"], F.lit(0), lambda n, end: n + (end <= place).cast("int"))


def _rounds(b: Column, p: Column) -> Column:
    """How often block b is taken."""
    return (p["rounds"] + _chosen(b, p).cast("bigint")).cast("int")


def _blocks(size: Column, block: Column) -> Column:
    """The blocks in which a document's words lie; none without words."""
    first, last = F.floor(F.col("_start") / block).cast("bigint"), F.floor((F.col("_start") + size - 1) / block).cast("bigint")
    return F.when(size > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def n_salts(largest: int) -> int:
    """A power of two, for the words of the largest source."""
    return min(MOST_SALTS, max(LEAST_SALTS, 1 << (max(1, largest // SALT_WORDS) - 1).bit_length()))


def _place(docs: DataFrame, seed: int, block_words: int | None, shards: int, key: str, text: str, source: str) -> DataFrame:
    """docs with size, _start (the document's place in its source's stream) and _p (its source's plan)."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED).withColumn("size", n_words(text))
    found = docs.groupBy(source).agg(F.sum("size").alias("n")).orderBy(F.col(source).asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = [(r[0], r["n"]) for r in found]
    plans = plan(sources, block_words, seed, shards)
    fields = "source string, source_size bigint, target double, block bigint, blocks bigint, rounds bigint, rest bigint, step bigint, shift bigint, ends array<bigint>"
    rows = [tuple(p[c.split()[0]] for c in fields.split(", ")) for p in plans]
    per_source = spark.createDataFrame(rows, fields).select(F.col("source").alias("_source"), F.struct(*[c.split()[0] for c in fields.split(", ")[1:]]).alias("_p"))
    order, salted = F.xxhash64(F.col(key), F.lit(seed)), n_salts(max([n for _, n in sources], default=0))
    docs = docs.withColumns({"_o": order, "_salt": F.shiftrightunsigned(order, 64 - int(math.log2(salted)))})
    salts = docs.groupBy(source, "_salt").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(source).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    salts = salts.select(F.col(source).alias("_s"), F.col("_salt").alias("_k"), before.alias("_before"))
    # One row for each source and salt.
    salts = F.broadcast(salts) if len(sources) * salted <= BROADCAST_SALTS else salts
    per_source = F.broadcast(per_source) if len(sources) <= 100_000 else per_source
    within = W.partitionBy(source, "_salt").orderBy("_o", key, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        docs.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(salts, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_k")))
        .join(per_source, F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("_start", F.col("_before") + F.col("_within"))
    )
    return placed.drop("_o", "_salt", "_within", "_s", "_k", "_before", "_source")


def mix(docs: DataFrame, seed: int = 17, block_words: int | None = None, shards: int = SHARDS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs with size, source_size, target, taken (the words of the document that the mix takes, repeats counted) and shards (how many of them each shard gets)."""
    placed = _place(docs, seed, block_words, shards, key, text, source)
    p, start, size = F.col("_p"), F.col("_start"), F.col("size")
    block = p["block"]

    def pieces(b: Column) -> Column:
        """(shard, words) for each time that block b is taken."""
        words = F.least(start + size, (b + 1) * block) - F.greatest(start, b * block)
        turns = F.sequence(F.lit(0), _rounds(b, p) - 1)
        return F.when(_rounds(b, p) > 0, F.transform(turns, lambda k: F.struct(_shard(b, k, p).alias("shard"), words.alias("words"))))

    taken = F.flatten(F.filter(F.transform(_blocks(size, block), pieces), lambda x: x.isNotNull()))
    total = lambda some: F.aggregate(some, F.lit(0).cast("bigint"), lambda n, x: n + x["words"])
    by_shard = lambda some: F.transform(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["shard"]))), lambda k: F.struct(k.alias("shard"), total(F.filter(some, lambda x: x["shard"] == k)).alias("words")))
    out = placed.withColumn("shards", let(taken, by_shard))
    return out.withColumns({"source_size": p["source_size"], "target": p["target"], "taken": total(F.col("shards"))}).drop("_p", "_start")


def draw(docs: DataFrame, seed: int = 17, block_words: int | None = None, shards: int = SHARDS, key: str = "doc_id", text: str = "text", source: str = "source", shard: str | None = None) -> DataFrame:
    """The mix itself, in the columns of docs: a row for each full round, and one with the words of the last round's blocks, if it has any of the document. n_chars, where docs has it, is the text's length.

    With shard, a name for an added column, a row for each round and shard, with the words that the shard gets.
    """
    placed = _place(docs, seed, block_words, shards, key, text, source)
    p, size = F.col("_p"), F.col("size")
    block = p["block"]
    pieces = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    copies = F.sequence(F.lit(0), p["rounds"].cast("int") - F.when(p["rest"] > 0, 0).otherwise(1))
    rows = placed.filter((size > 0) & ((p["rounds"] > 0) | (p["rest"] > 0))).withColumn("_copy", F.explode(copies))
    if shard:
        # Each block's shard in this round; -1 for one that isn't taken.
        of = F.transform(_blocks(size, block), lambda b: F.when(_rounds(b, p) > F.col("_copy"), _shard(b, F.col("_copy"), p)).otherwise(-1))
        rows = rows.withColumn("_of", of).withColumn("_shard", F.explode(F.array_remove(F.array_distinct("_of"), -1)))
        place = lambda i: F.floor((F.col("_start") + i) / block) - F.floor(F.col("_start") / block)
        part = F.array_join(F.filter(pieces, lambda _, i: F.get(F.col("_of"), place(i).cast("int")) == F.col("_shard")), "")
        rows = rows.withColumn(text, F.when(F.array_size(F.array_distinct("_of")) == 1, F.col(text)).otherwise(part))
    else:
        part = F.array_join(F.filter(pieces, lambda _, i: _chosen(F.floor((F.col("_start") + i) / block).cast("bigint"), p)), "")
        rows = rows.withColumn(text, F.when(F.col("_copy") < p["rounds"], F.col(text)).otherwise(part))
    rows = rows.filter(F.col(text) != "")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns, *([F.col("_shard").alias(shard)] if shard else []))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")
