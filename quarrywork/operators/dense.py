"""The exact nearest vectors of a stated query set: blocks of queries meet blocks of vectors, one block pair a task's group.

Both sides are dealt to blocks by their keys' hashes and meet in a cogroup, so
memory is bounded by a block pair, whatever the tables' sizes. A pair of blocks
is one matrix product; only each query's k best of a block leave the task.
Pairs are as many as queries times vectors, but no pair becomes a row.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors and queries of a block, at 64 numbers a vector; longer vectors come in smaller blocks. Products are held for so many queries and vectors at a time.
VECTORS, QUERIES, WIDTH = 32_768, 8_192, 64
TILE = (256, 8_192)
#: Cosines this near to a boundary of rounding are summed again in the vectors' own order, as functions.vectors.cosine does.
NEAR = 1e-9


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(length of each vector, -1 for null and for those with a null inside; by length, their rows and their matrix)."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    size = pc.fill_null(pc.list_value_length(flat), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    by = {}
    for n in np.unique(size[size >= 0]):
        rows = np.flatnonzero(size == n)
        values = flat.take(pa.array(rows)).flatten()
        holes = values.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), n).any(axis=1)
        by[int(n)] = rows[~holes], values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)[~holes]
        size[rows[holes]] = -1
    return size, by


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, all sums from the first number to the last."""
    total = lambda x: np.cumsum(np.c_[np.zeros(len(x)), x], axis=1)[:, -1]
    return total(a * b) / ((np.sqrt(total(a * a)) + 1e-12) * (np.sqrt(total(b * b)) + 1e-12))


def _rounded(cos: np.ndarray, places: int, again: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Half away from zero, as F.round does; again gives the values at these indices, summed in order."""
    scale = 10.0**places
    out = np.rint(cos * scale) / scale
    unsure = np.flatnonzero(np.abs(np.abs(cos * scale - np.floor(cos * scale)) - 0.5) < NEAR * scale)
    if len(unsure):
        unit = Decimal(1).scaleb(-places)
        out[unsure] = [float(Decimal(repr(float(x))).quantize(unit, ROUND_HALF_UP)) if np.isfinite(x) else x for x in again(unsure)]
    return out + 0.0


def best_of_block(queries: pa.Table, vectors: pa.Table, key: str, vector: str, query: str, query_vector: str, k: int, places: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of queries, rows of vectors, rounded cosines) of the k best of each query: NaN first, null (here -inf) last, ties by the vectors' keys."""
    order = pc.sort_indices(vectors[key], null_placement="at_start").to_numpy()
    vectors = vectors.select([key, vector]).take(pa.array(order))
    q_sizes, q_by = _matrix(queries[query_vector])
    v_sizes, v_by = _matrix(vectors[vector])
    nq, nv = len(q_sizes), len(v_sizes)
    same = np.zeros(nq + nv, np.int64) if itself else np.unique(np.array([*queries[query].to_pylist(), *vectors[key].to_pylist()]).astype(str), return_inverse=True)[1]
    q_same, v_same = same[:nq], same[nq:]
    norms = {n: (np.sqrt((m * m).sum(axis=1)) + 1e-12) for n, (_, m) in v_by.items()}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for n, (q_rows, q_all) in q_by.items():
        v_rows, v_all = v_by.get(n, (np.empty(0, np.int64), np.empty((0, n))))
        for low in range(0, len(q_rows), TILE[0]):
            rows, q = q_rows[low : low + TILE[0]], q_all[low : low + TILE[0]]
            q_norm = np.sqrt((q * q).sum(axis=1)) + 1e-12
            floor = np.full(len(rows), -np.inf)
            held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for left in range(0, len(v_rows), TILE[1]):
                v = v_all[left : left + TILE[1]]
                with np.errstate(all="ignore"):
                    cos = (q @ v.T) / q_norm[:, None] / norms[n][None, left : left + TILE[1]]
                cos[np.isnan(cos)] = np.inf
                if not itself:
                    # A query's own row gives way; nothing else has a cosine below -2.
                    cos[q_same[rows][:, None] == v_same[v_rows[left : left + TILE[1]]][None, :]] = -np.inf
                if cos.shape[1] > k:
                    kth = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k]
                    floor = np.maximum(floor, np.where(np.isfinite(kth), kth - 10.0**-places - 2 * NEAR, np.where(kth > 0, 2.0, -np.inf)))
                i, j = np.nonzero((cos >= floor[:, None]) & (cos > -2))
                again = lambda at, i=i, j=j, q=q, v=v: _in_order(q[i[at]], v[j[at]])
                value = cos[i, j]
                finite = np.flatnonzero(np.isfinite(value))
                value[finite] = _rounded(value[finite], places, lambda at, f=finite, again=again: again(f[at]))
                i, j, value = np.r_[held[0], i], np.r_[held[1], v_rows[left + j]], np.r_[held[2], value]
                at = np.lexsort((j, -value, i))
                place = np.arange(len(at)) - np.searchsorted(i[at], i[at])
                at = at[place < k]
                held = i[at], j[at], value[at]
                full = np.flatnonzero(np.bincount(held[0], minlength=len(rows)) == k)
                lowest = np.full(len(rows), np.inf)
                np.minimum.at(lowest, held[0], held[2])
                floor[full] = np.maximum(floor[full], np.where(np.isfinite(lowest[full]), lowest[full] - 0.5 * 10.0**-places - NEAR, 2.0))
            found.append((rows[held[0]], held[1], held[2]))
    i, j, value = (np.concatenate([f[x] for f in found] or [np.empty(0, t)]) for x, t in ((0, np.int64), (1, np.int64), (2, float)))
    # Pairs without a cosine come last, by key: they are looked for only where a query has fewer than k others.
    for row in np.flatnonzero(np.bincount(i, minlength=nq) < k):
        other = np.flatnonzero((v_sizes != q_sizes[row]) | (v_sizes < 0) | (q_sizes[row] < 0))
        other = other[:k] if itself else other[v_same[other] != q_same[row]][:k]
        i, j, value = np.r_[i, np.full(len(other), row)], np.r_[j, other], np.r_[value, np.full(len(other), -np.inf)]
    return i, order[j], value


def nearest(queries: DataFrame, vectors: DataFrame, query: str, query_vector: str, key: str, vector: str, k: int, places: int = 4, itself: bool = True) -> DataFrame:
    """queries' and vectors' other columns with cos, rounded, for at least the k best vectors of each query; the caller ranks them. Names must differ. itself: whether a vector whose key is the query's counts.

    As F.round of functions.vectors.cosine: null where a vector is null, has a null inside or another length.
    """
    width = vectors.agg(F.max(F.size(vector))).first()[0] or 1
    share = min(1.0, WIDTH / max(1, width))
    blocks = lambda rows, most: max(1, -(-rows.count() // max(64, int(most * share))))
    n_v, n_q = blocks(vectors, VECTORS), blocks(queries, QUERIES)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("*", part(query, n_q).alias("_q"), every(n_v).alias("_v"))
    right = vectors.select("*", part(key, n_v).alias("_v"), every(n_q).alias("_q"))
    kept = [f for f in queries.schema if f.name != query_vector] + [f for f in vectors.schema if f.name != vector]
    schema = T.StructType([*kept]).add("cos", "double")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        i, j, value = best_of_block(a, b, key, vector, query, query_vector, k, places, itself)
        columns = {f.name: (a if f.name in a.column_names else b)[f.name].take(pa.array(i if f.name in a.column_names else j)) for f in kept}
        cos = np.where(value == np.inf, np.nan, value)
        return pa.table({**columns, "cos": pa.array(cos, mask=value == -np.inf)})

    return left.groupBy("_q", "_v").cogroup(right.groupBy("_q", "_v")).applyInArrow(best, schema)
