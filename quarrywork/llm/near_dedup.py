"""MinHash near-duplicates by an LSH forest.

1. Each text becomes its set of word shingles (64-bit hashes). Texts of one
   set are a class; classes, not documents, are compared.
2. A class has HASHES minimum hashes. Tree t orders the classes by the
   signature that begins at hash DEPTH * t, cyclically; classes that share the
   first DEPTH hashes there form a region, and longest-common-prefix neighbours
   inside it are candidates. Regions are found in the sorted order of a
   range-partitioned table, so a hot one spreads over tasks by its members.
3. A region of up to SMALL members compares all of them by signature. A larger
   one picks leaders greedily, gives each member its most similar leader, and,
   where leaders get many, descends: members part by their next hashes until
   regions are small or coherent (the adaptive depth). A region that lies across tasks
   compares its tasks' leaders in a further round.
4. Of the candidates whose sizes and signatures allow the similarity, each
   class's most similar and its first likely one are verified on the full sets;
   their links make components. Then, in each region, every two components meet
   once more, all members against all on the full sets, so that nothing hangs on
   which candidates were chosen: a region of any size is dealt into cells, in
   which every block of rows outside its largest component meets every block of
   all its rows. Neither step makes a row for each pair.
   Components are built with star contractions.

A pair at similarity 0.8 misses all TREES regions with probability
(1 - 0.8 ** DEPTH) ** TREES, 3e-6; at 0.9, 7e-12. A pair at 0.8 has fewer than
LEAST_EQUAL equal hashes of 96 with probability 2e-6. Neither grows with the data.

Defined results
  null or empty text, no words   empty set, linked with nothing, kept
  fewer words than a shingle     the whole sequence is the one shingle
  null doc_id                    linked with nothing, kept, component_id null
  repeated doc_ids               each row has its own text's component; deduplicate
                                 tells rows of one doc_id apart by their texts, and
                                 of a group's rows with the least doc_id keeps one
  very long texts                whole, in batches bounded by bytes
  ties                           the smallest doc_id is kept
  empty table                    no rows
  extra columns                  ignored by find_duplicates, kept by deduplicate
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrywork.llm.components import components
from quarrywork.llm.scratch import Scratch
from quarrywork.llm.wordhash import mix, shingles, steps, word_hashes
from quarrywork.llm.workers import lean

TREES, DEPTH = 24, 4
HASHES = TREES * DEPTH
LEAST_EQUAL = 58
SMALL, LEADERS, CHUNK = 16, 64, 2048
#: Rows, and bytes of sets, in a block of the last comparison.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Equal hashes of 96 at which a class joins a leader's flock and leads none itself.
FLOCK = 80
#: And at which a pair is likely to pass.
LIKELY = 80
_rng = np.random.default_rng(5)
_A = (_rng.integers(0, 1 << 31, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for a, b in steps([len(t) for t in texts]):
        hashes, counts = word_hashes(texts[a:b])
        ends = np.cumsum(counts)
        for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
            yield np.unique(shingles(hashes[end - count : end], n)) if count else np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    x = (mix(s) >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (x[k : k + 4096, None] * _A + _B).min(axis=0), out=out)
    return out


def class_key(s: np.ndarray) -> bytes:
    """16 bytes of the set."""
    a, b = mix(s + np.uint64(0x632BE59BD9B4E019)), mix(s ^ np.uint64(0x9FB21C651E98DF25))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64).tobytes()


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def _sign(n: int):
    """Arrow batches, so that keys stay as they are: beside nulls, pandas would make whole numbers floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                sizes, keys, sigs = [], [], []
                for s in shingle_sets([t or "" for t in part["text"].to_pylist()], n):
                    sizes.append(len(s))
                    keys.append(class_key(s) if len(s) else None)
                    sigs.append(signature(s) if len(s) else np.zeros(HASHES, np.uint32))
                full = np.array(sigs, np.uint32).reshape(-1, TREES, DEPTH).astype(np.uint64)
                regions = np.arange(TREES, dtype=np.uint64)[None, :] + np.uint64(1)
                for d in range(DEPTH):
                    regions = mix(regions * np.uint64(0x9E3779B97F4A7C15) + full[:, :, d])
                low = np.array(sigs, np.uint32).astype(np.uint8)
                places = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * TREES), pa.array(regions.view(np.int64).ravel()))
                sig = [x.tobytes() if k else None for x, k in zip(low.reshape(-1, HASHES), keys, strict=True)]
                columns = [part["doc_id"], part["t"], pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), places, pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t", "n", "c", "regions", "sig"])

    return run


def _crowded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by region, those whose region has another row; the first and last region of a task always, as it may go on elsewhere."""
    held, known = None, True
    for b in batches:
        if held is not None:
            b = pd.concat([held, b], ignore_index=True)
        r = b["region"].to_numpy()
        if not len(r):
            continue
        same = r[1:] == r[:-1]
        keep = np.zeros(len(r), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= known  # the first of all, or held back from a group that is to stay
        tail = int(np.searchsorted(r, r[-1]))
        yield b.iloc[:tail][keep[:tail]]
        held = b.iloc[tail:]
        known = len(held) > 1 or (known and tail == 0)
        if len(held) > 1:
            yield held.iloc[:-1]
            held = held.iloc[-1:]
    if held is not None:
        yield held


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal hashes of each row of a and each row of b."""
    if len(a) * len(b) <= 1 << 13:
        return (a[:, None, :] == b[None, :, :]).sum(axis=2, dtype=np.int16)
    out = np.empty((len(a), len(b)), np.int16)
    for k in range(len(b)):
        out[:, k] = (a == b[k]).sum(axis=1)
    return out


class _Region:
    """Candidates of one region's rows, which come in signature order."""

    def __init__(self, percent: int):
        self.percent, self.pairs = percent, []

    def _add(self, nodes_a, nodes_b, equal):
        if len(nodes_a):
            lo, hi = np.minimum(nodes_a, nodes_b), np.maximum(nodes_a, nodes_b)
            self.pairs.append((lo, hi, equal))

    def _match(self, sig, size, lead) -> tuple[np.ndarray, np.ndarray]:
        """Equal hashes with the rows lead, and where sizes and hashes allow the similarity."""
        eq = _equal(sig, sig[lead])
        a, b = size[:, None], size[lead][None, :]
        return eq, (eq >= LEAST_EQUAL) & (np.minimum(a, b) * 100 >= self.percent * np.maximum(a, b))

    def run(self, node, sig, size, depth: int = DEPTH) -> np.ndarray:
        """Adds the pairs; returns the leaders' rows."""
        m = len(node)
        if m <= SMALL:
            eq, ok = self._match(sig, size, np.arange(m))
            i, j = np.nonzero(np.triu(ok, 1))
            self._add(node[i], node[j], eq[i, j])
            return np.arange(m)
        leaders: list[int] = []
        free, best, mate = np.ones(m, bool), np.zeros(m, np.int16), np.full(m, -1)
        while free.any() and len(leaders) < LEADERS:
            lead = int(np.argmax(free))
            eq, ok = self._match(sig, size, np.array([lead]))
            ok[lead, 0] = False
            nearer = ok[:, 0] & (eq[:, 0] > best)
            best[nearer], mate[nearer] = eq[nearer, 0], lead
            free &= eq[:, 0] < FLOCK
            free[lead] = False
            leaders.append(lead)
        rows = np.flatnonzero(mate >= 0)
        self._add(node[rows], node[mate[rows]], best[rows])
        if free.any():  # too varied: the region parts at its next hashes
            left = np.flatnonzero(free)
            while depth < HASHES and (sig[left, depth] == sig[left[0], depth]).all():
                depth += 1
            if depth < HASHES:
                order = left[np.argsort(sig[left, depth], kind="stable")]
                for part in np.split(order, np.flatnonzero(np.diff(sig[order, depth].astype(np.int16))) + 1):
                    leaders += part[self.run(node[part], sig[part], size[part], depth + 1)].tolist()
        return np.array(leaders)


def _candidates(percent: int):
    """Pairs (a, b, equal) from rows sorted by region and signature; with b null, the leaders of regions that may go on in another task (equal 0), and the members of large regions (equal -1)."""

    def pairs(found: _Region) -> Iterator[pd.DataFrame]:
        if found.pairs:
            a, b, equal = (np.concatenate([x[k] for x in found.pairs]) for k in range(3))
            yield pd.DataFrame({"region": np.int64(0), "a": a, "b": pd.array(b, "Int64"), "equal": equal.astype(np.int32)})
            found.pairs = []

    def lead(region: int, nodes: np.ndarray, mark: int = 0) -> pd.DataFrame:
        return pd.DataFrame({"region": np.int64(region), "a": nodes, "b": pd.array([None] * len(nodes), "Int64"), "equal": np.int32(mark)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held, edge = _Region(percent), None, True
        for batch in batches:
            if not len(batch):
                continue
            new = [batch[c].to_numpy() for c in ("region", "node", "n")] + [np.frombuffer(b"".join(batch["sig"]), np.uint8).reshape(len(batch), HASHES)]
            region, node, size, sig = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(region)]])
            sizes = np.diff(cuts)
            whole = np.arange(len(sizes) - 1)  # the last may go on in the next batch
            if edge and len(whole):
                k = slice(0, cuts[1])
                yield lead(region[0], node[k][found.run(node[k], sig[k], size[k])])
                whole, edge = whole[1:], False
            two = cuts[whole[sizes[whole] == 2]]
            equal = (sig[two] == sig[two + 1]).sum(axis=1, dtype=np.int16)
            x, y = size[two], size[two + 1]
            ok = (equal >= LEAST_EQUAL) & (np.minimum(x, y) * 100 >= percent * np.maximum(x, y))
            found._add(node[two[ok]], node[two[ok] + 1], equal[ok])
            for r in whole[sizes[whole] > 2].tolist():
                k = slice(cuts[r], cuts[r + 1])
                found.run(node[k], sig[k], size[k])
            yield from pairs(found)
            large = np.repeat(sizes > SMALL, sizes)
            if large.any():
                yield lead(0, node[large], -1)
            k = slice(cuts[-2], cuts[-1])
            held = [x[k] for x in (region, node, size, sig)]
            if sizes[-1] >= CHUNK * 4:  # a very large region: its chunks' leaders meet later
                yield lead(held[0][0], held[1][found.run(held[1], held[3], held[2])])
                yield from pairs(found)
                held, edge = None, True
        if held:
            yield lead(held[0][0], held[1][found.run(held[1], held[3], held[2])])
            yield from pairs(found)

    return run


def _regions_to_pairs(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """rows: (region, node, tree)."""
    sig = F.concat(F.expr(f"substring(sig, tree * {DEPTH} + 1)"), F.expr(f"substring(sig, 1, tree * {DEPTH})"))
    full = rows.join(nodes.select("node", "n", "sig"), "node").select("region", sig.alias("sig"), "node", "n", "tree")
    ordered = full.repartitionByRange("region", "sig", "node").sortWithinPartitions("region", "sig", "node")
    return ordered.select("region", "sig", "node", "n").mapInPandas(lean(_candidates(percent)), "region bigint, a bigint, b bigint, equal int")


def _set_rows(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                sets = list(shingle_sets(_texts(part["text"]), n))
                right = [len(s) > 0 and class_key(s) == c for s, c in zip(sets, part["c"], strict=True)]
                yield pd.DataFrame({"node": part["node"].array, "s": [s.tobytes() for s in sets]})[np.array(right, bool)]

    return run


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch[["a", "b"]][np.array(good, bool)]

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInPandas(lean(_verify(percent)), "a bigint, b bigint")


def _cells(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """rows (region, node, component and more) with the columns cell and side: each copied to the cells in which its region's components meet.

    A region's rows fall into blocks of about most in the column weight, and those
    outside its most frequent component (minor ones) into blocks of their own. Each
    block of minor rows meets each block of all rows in a cell: side has bit 1 for
    the former and bit 2 for the latter. So any two rows of different components
    meet, wherever they lie, and a cell doesn't grow with its region.
    """
    sums = rows.groupBy("region", "component").agg(F.count("*").alias("k"), F.sum(weight).alias("w"))
    regions = sums.groupBy("region").agg(F.count("*").alias("parts"), F.sum("w").alias("w"), F.max(F.struct("k", "component", "w")).alias("top")).filter("parts > 1")
    blocks = lambda w: F.greatest(F.ceil(w / most), F.lit(1)).cast("int")
    sizes = regions.select("region", F.col("top.component").alias("_top"), blocks(F.col("w") - F.col("top.w")).alias("_minors"), blocks(F.col("w")).alias("_all"))
    minor, h = F.col("component") != F.col("_top"), F.xxhash64("node")
    i, j = F.pmod(h, F.col("_minors")).cast("int"), F.pmod(h, F.col("_all")).cast("int")
    cell = lambda i, j, side: F.struct(F.xxhash64("region", i, j).alias("cell"), side.alias("side"))
    right = F.transform(F.sequence(F.lit(0), F.col("_minors") - 1), lambda x: cell(x, j, F.when(minor & (x == i), 3).otherwise(2)))
    left = F.transform(F.filter(F.sequence(F.lit(0), F.col("_all") - 1), lambda x: minor & (x != j)), lambda x: cell(i, x, F.lit(1)))
    return rows.join(sizes, "region").select(*rows.columns, F.explode(F.concat(right, left)).alias("_c")).select(*rows.columns, "_c.cell", "_c.side")


def _dealt(cells: DataFrame) -> DataFrame:
    """A cell's rows side by side in one task."""
    return cells.repartition("cell").sortWithinPartitions("cell")


def _whole_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of two rows or more, the rows of their right side first, from rows sorted by cell."""

    def whole(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if sum(map(len, parts)) > 1:
            rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            yield rows.iloc[np.argsort(rows["side"].to_numpy() == 1, kind="stable")]

    held: list[pd.DataFrame] = []
    for b in batches:
        r = b["cell"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)] if len(r) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0]["cell"].iloc[0] != r[i]:
                yield from whole(held)
                held = []
            held.append(b.iloc[i:j])
    yield from whole(held)


def _live(percent: int):
    """Of rows sorted by cell: those with a partner of another component that sizes and signatures allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_cells(batches):
            component, size, side = (rows[c].to_numpy() for c in ("component", "n", "side"))
            right = int((side != 1).sum())
            sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), HASHES)
            live = np.zeros(len(rows), bool)
            for x in np.flatnonzero(side != 2).tolist():
                n = size[:right]
                ok = (component[:right] != component[x]) & (np.minimum(n, size[x]) * 100 >= percent * np.maximum(n, size[x]))
                at = np.flatnonzero(ok)
                at = at[(sig[at] == sig[x]).sum(axis=1) >= LEAST_EQUAL]
                if len(at):
                    live[x] = True
                    live[at] = True
            if live.any():
                yield rows.loc[live, ["region", "node", "component", "n"]]

    return run


def _exact(percent: int):
    """Links (u, v) between components, from rows sorted by cell: the full sets of its two sides meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_cells(batches):
            node, component, side = rows["node"].to_numpy(), rows["component"].to_numpy().copy(), rows["side"].to_numpy()
            right, left = int((side != 1).sum()), np.flatnonzero(side != 2)
            if not right or not len(left):
                continue
            sets = [np.frombuffer(x, np.uint64) for x in rows["s"]]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            _, code = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum(size)
            met, starts, n = code[: ends[right - 1]], (ends - size)[:right], size[:right]
            mark, found = np.zeros(int(code.max()) + 1, bool), []
            for x in left.tolist():
                own = code[ends[x] - size[x] : ends[x]]
                mark[own] = True
                both = np.add.reduceat(mark[met], starts)
                mark[own] = False
                good = (component[:right] != component[x]) & (100 * both >= percent * (n + size[x] - both))
                for c in np.unique(component[:right][good]).tolist():
                    y = int(np.flatnonzero(good & (component[:right] == c))[0])
                    found.append((node[x], node[y]))
                    component[component == c] = component[x]
            if found:
                yield pd.DataFrame(found, columns=["u", "v"])

    return run


def _bridges(labels: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (u, v) between the components of a region. labels: (region, node, tree, component)."""
    mixed = labels.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("region")
    sig = F.concat(F.expr(f"substring(sig, tree * {DEPTH} + 1)"), F.expr(f"substring(sig, 1, tree * {DEPTH})"))
    rows = scratch.write(labels.join(mixed, "region").withColumn("one", F.lit(1)), "mixed")
    cells = _cells(rows, "one", BLOCK_ROWS).join(nodes.select("node", "n", "sig"), "node").select("cell", "side", "region", sig.alias("sig"), "node", "n", "component")
    live = scratch.write(_dealt(cells).mapInPandas(lean(_live(percent)), "region bigint, node bigint, component bigint, n int").distinct(), "live")
    full = _cells(live.withColumn("bytes", F.col("n").cast("bigint") * 8), "bytes", BLOCK_BYTES).join(sets, "node").select("cell", "side", "node", "component", "s")
    return scratch.write(_dealt(full).mapInPandas(lean(_exact(percent)), "u bigint, v bigint").distinct(), "bridges")


def _strong(pairs: DataFrame) -> DataFrame:
    """For each class its most similar partner, and the first of the likely ones: the links that join components soonest."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "equal"))
    best = both.groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("x"))).alias("best"), F.min(F.when(F.col("equal") >= LIKELY, F.col("b"))).alias("first"))
    ends = best.select("a", F.explode(F.array((-F.col("best.x")), F.col("first"))).alias("b")).filter("b IS NOT NULL")
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(docs: DataFrame, shingle: int, percent: int, key: str, text: str) -> DataFrame:
    """(doc_id, t, n, c, component): a row for each document; t is a hash of its text, c its set's key, null where it is linked with nothing."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    signed = scratch.write(source.mapInArrow(lean(_sign(shingle)), f"doc_id {kind}, t bigint, n int, c binary, regions array<bigint>, sig binary"), "signed")
    classes = signed.filter("c IS NOT NULL AND doc_id IS NOT NULL").groupBy("c").agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("n").alias("n"), F.first("regions").alias("regions"), F.first("sig").alias("sig"))
    nodes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    grown = nodes.select("node", F.posexplode("regions").alias("tree", "region")).select("region", "node", "tree")
    ordered = grown.repartitionByRange("region", "node").sortWithinPartitions("region", "node")
    crowded = scratch.write(ordered.mapInPandas(lean(_crowded), "region bigint, node bigint, tree int"), "crowded")
    found = scratch.write(_regions_to_pairs(crowded, nodes, percent), "found")
    # Leaders of regions that lie across tasks, or are very large, meet each other.
    edge = found.filter("b IS NULL AND equal = 0").select("region", F.col("a").alias("node"))
    lone = edge.groupBy("region").agg(F.count("*").alias("k")).filter("k > 1").select("region")
    trees = crowded.select("region", "tree").distinct()
    again = _regions_to_pairs(edge.join(lone, "region").join(trees, "region").select("region", "node", "tree").distinct(), nodes, percent)
    pairs = scratch.write(found.filter("b IS NOT NULL").unionByName(again.filter("b IS NOT NULL")).groupBy("a", "b").agg(F.max("equal").alias("equal")), "pairs")
    # The sets of all that may be compared: ends of pairs, and members of large regions and of those that lie across tasks.
    open_ = found.filter("equal = -1").select(F.col("a").alias("node")).unionByName(crowded.join(lone, "region").select("node"))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(open_).distinct()
    wanted = nodes.join(ends, "node", "left_semi").select("rep.doc_id", "rep.t", "node", "c")
    # One text for each, also where its row is repeated.
    texts = source.join(wanted, ["doc_id", "t"]).groupBy("doc_id", "t").agg(*[F.first(x).alias(x) for x in ("node", "c", "text")]).select("node", "c", "text")
    sets = scratch.write(texts.mapInPandas(lean(_set_rows(shingle)), "node bigint, s binary"), "sets", group_mb=32)
    links = scratch.write(_links(_strong(pairs), sets, percent), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
    stars = components(links, scratch, "first")
    # What is left between two components of a region.
    labels = crowded.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("region", "node", "tree", F.coalesce("root", "node").alias("component"))
    bridges = _bridges(labels, nodes, sets, percent, scratch)
    scratch.drop("sets")
    final = components(stars.unionByName(bridges), scratch, "second")
    rooted = nodes.select("c", "node", "rep").join(final.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("rep.doc_id").alias("component"))
    labelled = rooted.join(least, "root").select("c", "component")
    rows = signed.select("doc_id", "t", "n", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c")).join(labelled, "c", "left")
    return rows.select("doc_id", "t", "n", "c", F.coalesce("component", "doc_id").alias("component"))


def find_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept): a row for each document. percent: the least similarity, in hundredths; under 80 the trees' recall sinks."""
    component = F.col("component")
    kept = component.isNull() | (component == F.col("doc_id"))
    return _labelled(docs, shingle, percent, key, text).select(F.col("doc_id").alias(key), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, of those with its smallest doc_id; and all rows that are linked with nothing."""
    scratch = Scratch(docs.sparkSession, "dedup")
    linked = _labelled(docs, shingle, percent, key, text).filter("c IS NOT NULL")
    # Of a component's texts under its least doc_id the one with the least hash stays; every other (doc_id, text) goes.
    texts = scratch.write(linked.groupBy("component", "doc_id", "t").agg(F.count("*").alias("k")), "texts")
    first = texts.filter("doc_id = component").groupBy("component").agg(F.min("t").alias("t"))
    stays = first.select(F.col("component").alias("_k"), F.col("t").alias("_t"))
    gone = texts.select(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).join(stays, ["_k", "_t"], "left_anti")
    same = lambda other: (docs[key] == other["_k"]) & (F.xxhash64(docs[text]) == other["_t"])
    rest = docs.join(gone, same(gone), "left_anti")
    again = scratch.write(texts.filter("k > 1").select(F.col("doc_id").alias("_k"), F.col("t").alias("_t")).join(stays, ["_k", "_t"], "left_semi"), "again")
    if again.isEmpty():
        return rest
    # Repeated rows: the one whose values have the least hash.
    once = rest.join(again, same(again), "left_semi")
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    one = once.groupBy(F.col(key).alias("_k"), F.xxhash64(text).alias("_t")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_row")).select("_row.*")
    return rest.join(again, same(again), "left_anti").unionByName(one)


def query(spark, sf_dir: str) -> DataFrame:
    return find_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)
