"""A Merkle manifest of a table: a tree for each group, and one over the groups' roots.

Rows are leaves, ordered inside their group. Superblock reduction: a leaf's
place is divided by FANOUT ** LEVELS, and one applyInPandas call collapses up to
LEVELS levels of such a bucket: it returns the bucket's root and each member's
siblings on the way there. The buckets' roots are the members of the next round,
so a group of n leaves takes log(n) / log(FANOUT ** LEVELS) rounds, and no call
sees more than FANOUT ** LEVELS rows however large the group. On the way back a
bucket's upper proof is appended to its members' lower proofs.

Places come from a range-partitioned, sorted and written table: a row's number
in its partition, less the number where its group begins there, plus what the
group has in earlier partitions. No window spans a group.

H: lower-case hexadecimal SHA-256 of the concatenated inputs, digests as
hexadecimal text. A run of FANOUT neighbours becomes their H, the last run may
be shorter, one node too, as long as the level has several nodes.

Defined results
  null in a leaf's column   "-"; other values are their UTF-8 byte count, ":" and the value
  null group                a group of its own, before the others
  null or repeated keys     null first; rows of one key go by their leaves
  one row                   its leaf is the subroot, and the root if there is one group
  very long texts           whole, as one value
  empty table               no rows, no root
  extra columns             kept where named; MANIFEST_COLUMNS are added
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrywork.llm.scratch import Scratch

FANOUT, LEVELS = 2, 10
MANIFEST_COLUMNS = ("leaf", "proof", "subroot", "root")
#: Each level's siblings to the left and to the right of the way, concatenated.
PROOF = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def siblings(proof: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def placed(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with place (0, 1, ... inside the group, by order, nulls first) and n, the rows of the group."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    numbered = scratch.write(numbered, name).withColumn("_part", F.shiftright("_at", 33))
    runs = numbered.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_held"))
    own = W.partitionBy(group)  # a row for each partition that the group reaches
    earlier = F.sum("_held").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_from", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_held").over(own).alias("n"))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return numbered.join(runs, same).withColumn("place", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_group", "_of", "_from", "_before")


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[list[dict]]]:
    """The root of neighbouring nodes after so many levels, and each node's siblings on the way."""
    proofs: list[list[dict]] = [[] for _ in nodes]
    spans = [(k, k + 1) for k in range(len(nodes))]  # the first nodes below each
    for _ in range(levels):
        above, wider = [], []
        for first in range(0, len(nodes), fanout):
            run = nodes[first : first + fanout]
            for k, (a, b) in enumerate(spans[first : first + fanout]):
                beside = {"left": "".join(run[:k]), "right": "".join(run[k + 1 :])}
                for leaf in range(a, b):
                    proofs[leaf].append(beside)
            above.append(hashlib.sha256("".join(run).encode()).hexdigest())
            wider.append((spans[first][0], spans[min(first + fanout, len(spans)) - 1][1]))
        nodes, spans = above, wider
    return nodes[0], proofs


def _depth(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _reduced(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """nodes (group, place, n, node) with bucket, the bucket's root (top) and the siblings below it."""

    def one(frame):
        frame = frame.sort_values("place")
        top, proofs = collapse(frame["node"].tolist(), min(levels, _depth(int(frame["n"].iloc[0]), fanout)), fanout)
        return frame.assign(top=top, proof=proofs)

    bucket = F.floor(F.col("place") / fanout**levels)
    return nodes.withColumn("bucket", bucket).groupBy("group", "bucket").applyInPandas(one, f"group string, place bigint, n bigint, node string, bucket bigint, top string, proof {PROOF}")


def _rounds(nodes: DataFrame, scratch: Scratch, name: str, levels: int, fanout: int) -> Iterator[DataFrame]:
    """Each round's members with their bucket, top and lower proof, until all groups have one bucket."""
    k = 0
    while True:
        done = scratch.write(_reduced(nodes, levels, fanout), f"{name}{k}")
        yield done
        if not done.filter("bucket > 0").take(1):
            return
        nodes = done.filter(F.col("place") % fanout**levels == 0).select("group", F.col("bucket").alias("place"), F.ceil(F.col("n") / fanout**levels).alias("n"), F.col("top").alias("node"))
        k += 1


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(group, place, proof, ...): the first round's members; above: (group, proof, ...), what a group's root has above it."""
    rest = [c for c in above.columns if c not in ("group", "proof")]
    upper = above.withColumn("bucket", F.lit(0).cast("bigint"))
    for done in reversed(rounds):
        upper = upper.select("group", "bucket", F.col("proof").alias("_upper"), *rest)
        upper = done.join(upper, ["group", "bucket"]).select("group", "place", F.concat("proof", "_upper").alias("proof"), *rest).withColumnRenamed("place", "bucket")
    return upper.withColumnRenamed("bucket", "place")


def manifest(rows: DataFrame, leaf: Column, group: str, order: list[str], keep: list[str], levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """The columns keep, and MANIFEST_COLUMNS. folded(leaf, proof) gives the root."""
    scratch = Scratch(rows.sparkSession, "manifest")
    named = rows.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keep)], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(group).cast("string").alias("_lang"), leaf.alias("node"))
    leaves = placed(named, "_lang", [*[f"_o{k}" for k in range(len(order))], "node"], scratch, "leaves").withColumn("group", encoded(F.col("_lang")))
    leaves = scratch.write(leaves, "placed")
    lower = list(_rounds(leaves.select("group", "place", "n", "node"), scratch, "round", levels, fanout))
    # The groups' roots are the leaves of one more tree, in the order of the groups' names.
    names = leaves.filter("place = 0").select("group", "_lang")
    tops = lower[-1].filter("place = 0").select("group", "top").join(names, "group").withColumn("_all", F.lit(""))
    tops = scratch.write(placed(tops, "_all", ["_lang"], scratch, "groups"), "tops")
    upper = list(_rounds(tops.select(F.col("_all").alias("group"), "place", "n", F.col("top").alias("node")), scratch, "top", levels, fanout))
    roots = upper[-1].filter("place = 0").select("group", F.col("top").alias("root"), F.array().cast(PROOF).alias("proof"))
    above = _proofs(upper, roots).select("place", "proof", "root").join(tops.select("place", F.col("group"), F.col("top").alias("subroot")), "place").select("group", "proof", "subroot", "root")
    proofs = _proofs(lower, scratch.write(above, "above"))
    out = leaves.join(proofs, ["group", "place"])
    return out.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keep) if c not in MANIFEST_COLUMNS], F.col("node").alias("leaf"), "proof", "subroot", "root")


#: The leaf's columns, in order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(**instead: Column) -> Column:
    return digest(*[encoded(instead.get(c, F.col(c))) for c in LEAF_COLUMNS])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*LEAF_COLUMNS)
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = docs.withColumn("tampered", F.when(picked & F.col("n_chars").isNotNull(), document_leaf(n_chars=F.col("n_chars") + 1)))
    found = manifest(rows, document_leaf(), "lang", ["doc_id"], ["doc_id", "tampered"])
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(most_levels: int = 32) -> str:
    """A level for each of most_levels, whether needed or not: a group of one node stays as it is."""
    item = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(item(n if c == "n_chars" else c) for c in LEAF_COLUMNS) + ")"
    crc = """(SELECT list(CAST(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS codes FROM range(256) r(i))"""
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    check = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, codes[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"
    return f"""
WITH RECURSIVE t AS {crc},
d AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS g, lang IS NOT NULL AS named, {leaf('n_chars')} AS leaf, CASE WHEN n_chars IS NOT NULL AND {check} % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS now FROM documents, t),
p AS (SELECT *, row_number() OVER (PARTITION BY named, g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
tree AS (
  SELECT 0 AS level, named, g, place, leaf AS node, count(*) OVER (PARTITION BY named, g) AS n FROM p
  UNION ALL
  SELECT level + 1, named, g, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM tree WHERE n > 1 GROUP BY level, named, g, place // 2),
subs AS (SELECT named, g, node AS subroot, row_number() OVER (ORDER BY named, g) - 1 AS place FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), any_value((n + 1) // 2) FROM top WHERE n > 1 GROUP BY level, place // 2),
walk AS (
  SELECT doc_id, p.named, p.g, p.place AS pos, leaf, now, 0 AS level, '' AS proof, now AS node, false AS upper FROM p
  UNION ALL
  SELECT w.doc_id, w.named, w.g,
         CASE WHEN step.kind = 1 THEN s.place ELSE w.pos // 2 END, w.leaf, w.now,
         CASE WHEN step.kind = 1 THEN 0 ELSE w.level + 1 END,
         w.proof || CASE WHEN step.kind = 1 THEN '' ELSE coalesce(x.node, y.node, '') END,
         CASE WHEN step.kind = 1 THEN w.node WHEN w.pos % 2 = 0 THEN sha256(w.node || coalesce(x.node, y.node, '')) ELSE sha256(coalesce(x.node, y.node, '') || w.node) END,
         w.upper OR step.kind = 1
  FROM walk w
  JOIN subs s ON s.named = w.named AND s.g = w.g
  JOIN (SELECT named, g, max(level) AS top_level FROM tree GROUP BY ALL) z ON z.named = w.named AND z.g = w.g
  CROSS JOIN (SELECT max(level) AS last FROM top) l
  CROSS JOIN LATERAL (SELECT CASE WHEN NOT w.upper AND w.level = z.top_level THEN 1 ELSE 0 END AS kind) step
  LEFT JOIN tree x ON NOT w.upper AND x.named = w.named AND x.g = w.g AND x.level = w.level AND x.place = xor(w.pos, 1)
  LEFT JOIN top y ON w.upper AND y.level = w.level AND y.place = xor(w.pos, 1)
  WHERE NOT (w.upper AND w.level = l.last))
SELECT w.doc_id, w.leaf, s.subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.node AS verified
FROM walk w JOIN subs s ON s.named = w.named AND s.g = w.g CROSS JOIN (SELECT node FROM top WHERE n = 1) r CROSS JOIN (SELECT max(level) AS last FROM top) l
WHERE w.upper AND w.level = l.last
"""


ORACLE = _sql()
