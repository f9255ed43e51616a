"""Deduplication, top-k memory, coverage and priority selection over scored candidates."""

from __future__ import annotations

from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key by order. A hash aggregate of (order, row), so that copies collapse before the shuffle."""
    packed = F.struct(*order, *[c for c in rows.columns if c not in order])
    return rows.groupBy(key.alias("_key")).agg(F.min_by(packed, F.struct(*order)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns])


def ranking(priority: Column, failing: Column, similarity: Column) -> Column:
    """A struct that orders outcomes, better ones larger: priority, fewer failing tests (unknown: most), similarity."""
    known = F.greatest(F.lit(0), F.coalesce(failing.cast("bigint"), F.lit(10**9)))
    return F.struct(priority.alias("priority"), (-known).alias("failing"), F.coalesce(similarity, F.lit(-1.0)).alias("similarity"))


def best_of(rows: DataFrame, by: str, rank: Column, order: str) -> DataFrame:
    """The best row of each group; of equal ones the first."""
    w = W.partitionBy(by).orderBy(rank.desc(), order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def memory(rows: DataFrame, by: str, code: str, rank: Column, order: str, k: int) -> DataFrame:
    """The k best distinct codes of each group; of one code the latest row counts, equal ranks in the order they came. Adds memory_rank."""
    latest = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, code).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    w = W.partitionBy(by).orderBy(rank.desc(), order)
    return latest.withColumn("memory_rank", F.row_number().over(w)).filter(F.col("memory_rank") <= max(1, k))


def stagnant(rows: DataFrame, by: str, order: str, mark: Column) -> DataFrame:
    """Adds stagnant: whether the mark, where it isn't empty, equals the previous row's."""
    previous = F.lag("_mark").over(W.partitionBy(by).orderBy(order))
    return rows.withColumn("_mark", mark).withColumn("stagnant", F.coalesce((F.col("_mark") != "") & (F.col("_mark") == previous), F.lit(False))).drop("_mark")


# Within these score differences lower risk, or smaller rewrites, win.
RISK_MARGIN, CHANGE_MARGIN = 10.0, 1.0


def _before(x: dict, y: dict) -> int:
    """The margin comparator of candidates. It isn't transitive, so only a pairwise sort of whole groups has its results."""
    gap = abs(x["score"] - y["score"])
    keys = []
    if x["tier"] is not None and y["tier"] is not None:
        if x["tier"] != y["tier"] and gap <= RISK_MARGIN:
            keys.append((x["tier"], y["tier"]))
        elif x["tier"] == y["tier"] and gap <= CHANGE_MARGIN:
            keys.append((x["change"], y["change"]))
    keys += [(-x["score"], -y["score"]), (x["change"], y["change"]), (x["signature"], y["signature"])]
    return next(((a > b) - (a < b) for a, b in keys if a != b), 0)


_ordered = cmp_to_key(_before)


def _sorted(group: list[dict]) -> list[dict]:
    """In the comparator's order, which begins from the order of signatures."""
    return sorted(sorted(group, key=lambda x: x["signature"] or ""), key=_ordered)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _signatures(groups: pd.Series) -> pd.Series:
    return groups.map(lambda g: [x["signature"] for x in _sorted(g)])


def priority_order(rows: DataFrame, by: str) -> DataFrame:
    """(by, signature, pick): candidates (score, tier or null, change, signature) of each group in the comparator's order. A group is the candidates of one item, which a generator bounds."""
    groups = rows.groupBy(by).agg(F.collect_list(F.struct("score", "tier", "change", "signature")).alias("g"))
    return groups.select(by, F.posexplode(_signatures("g")).alias("pick", "signature")).select(by, "signature", (F.col("pick") + 1).alias("pick"))


def _covering(group: list[dict], k: int, pin: bool) -> list[dict]:
    """Up to k: the best greedy one, if pinned (other greedy ones never come), the best of each source, best sources first, and the rest."""
    order = _sorted(group)
    greedy = [x for x in order if x["greedy"]]
    first = greedy[:1] if pin else []
    left = [x for x in order if not x["greedy"]] if pin else greedy + [x for x in order if not x["greedy"]]
    heads: dict[str, dict] = {}
    for x in _sorted(left):
        heads.setdefault(x["source"] or "NA", x)
    leaders = _sorted(list(heads.values()))
    rest = _sorted([x for x in left if not any(x is y for y in leaders)])
    return (first + leaders + rest)[: max(1, k)]


def coverage(rows: DataFrame, by: str, k: int, pin: bool = True) -> DataFrame:
    """(by, signature, pick): k candidates (score, tier or null, change, signature, greedy, source) of each group, as _covering picks them. Groups are bounded as in priority_order."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def picked(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: [x["signature"] for x in _covering(list(g), k, pin)])

    groups = rows.groupBy(by).agg(F.collect_list(F.struct("score", "tier", "change", "signature", "greedy", F.col("source").cast("string").alias("source"))).alias("g"))
    return groups.select(by, F.posexplode(picked("g")).alias("pick", "signature")).select(by, "signature", (F.col("pick") + 1).alias("pick"))


def pinned_order(rows: DataFrame, by: str, greedy: str, *order: Column) -> DataFrame:
    """The best greedy row of each group first, other greedy ones left out, then the rest. Adds place."""
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, greedy).orderBy(*order))).filter(~F.col(greedy) | (F.col("_n") == 1)).drop("_n")
    return best.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(~F.col(greedy), *order)))


# A node's weight by its type (3 for others), and the hints that go with a type.
TYPE_WEIGHTS = {
    "Call": 0, "Assign": 1, "AugAssign": 1, "AnnAssign": 1, "If": 1, "Compare": 1, "BoolOp": 1, "Return": 2, "For": 2, "While": 2, "Try": 1, "ExceptHandler": 1, "With": 2,
    "Subscript": 1, "Attribute": 1, "BinOp": 2, "UnaryOp": 2, "Raise": 2, "Assert": 2, "Function": 2, "Class": 2,
}
NO_DISTANCE, OTHER_WEIGHT = 9999, 3


def node_score(kind: Column, distance: Column, overlap: Column, contains: Column, matches: Column) -> Column:
    """Smaller is nearer to the suspicious line: ten a line of distance and the type's weight, less 20 for holding the line, 15 for its text, 3 a shared name (10 at most)."""
    weights = F.create_map(*[F.lit(x) for pair in TYPE_WEIGHTS.items() for x in pair])
    weight = F.coalesce(F.try_element_at(weights, kind), F.lit(OTHER_WEIGHT))
    shared = F.least(F.lit(10), F.coalesce(overlap, F.lit(0)) * 3)
    return F.coalesce(distance, F.lit(NO_DISTANCE)) * 10 + weight - F.when(contains, 20).otherwise(0) - F.when(matches, 15).otherwise(0) - shared


def strong_hint(distance: Column, overlap: Column, contains: Column, matches: Column, hints: Column) -> Column:
    return F.coalesce(contains, F.lit(False)) | F.coalesce(matches, F.lit(False)) | F.coalesce(distance <= 2, F.lit(False)) | F.coalesce(overlap > 0, F.lit(False)) | (F.coalesce(F.size(hints), F.lit(0)) > 0)


def effective_nodes(rows: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The k best rows (score, strong) of each group: strong ones, then others, each by score and then in order. Adds place."""
    w = W.partitionBy(by).orderBy(F.desc("strong"), "score", *order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def needs_retry(buffered: Column, target: Column, duplicates: Column, seen: Column, failed: Column) -> Column:
    """Whether another pass is due: short of the target, and many duplicates (twice the target, or 0.4 of all) or as many failed extractions as the target."""
    share = duplicates / F.greatest(F.lit(1), seen)
    return (buffered < target) & ((duplicates >= 2 * target) | (share >= 0.4) | (failed >= target))
