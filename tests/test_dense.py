import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrywork.functions.vectors import cosine
from quarrywork.operators import dense
from quarrywork.operators import retrieval as R
from quarrywork.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(queries, vectors, k, itself):
    """Every pair as a row, ranked."""
    both = vectors.crossJoin(queries).filter(F.lit(True) if itself else F.col("id") != F.col("q"))
    scored = both.select("q", "id", "label", F.round(cosine(F.col("qv"), F.col("v")), 4).alias("cos"))
    return ranked(scored, k)


def ranked(scored, k):
    shown = lambda x: "nan" if x is not None and math.isnan(x) else x
    return sorted((r.q, r["rank"], r.id, r.label, shown(r.cos)) for r in R.top_k(scored, "q", "cos", "id", k).collect())


@pytest.mark.parametrize("itself", [True, False])
def test_every_pair_counts(spark, monkeypatch, itself):
    draw = np.random.default_rng(7)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)], i % 3) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0], 1), (202, [1.0, None, 0.0, 1.0], 2), (203, [], 2), (204, [float("nan"), 0.0, 0.0, 1.0], 0), (205, [0.0] * 4, 0)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>, label int")
    queries = vectors.filter("id % 10 = 0 or id > 199").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    monkeypatch.setattr(dense, "VECTORS", 64)
    monkeypatch.setattr(dense, "QUERIES", 1)
    for k in (3, 70, 200):
        assert ranked(dense.nearest(queries, vectors, "q", "qv", "id", "v", k, itself=itself), k) == plain(queries, vectors, k, itself)


def test_tiles_keep_the_best(monkeypatch):
    monkeypatch.setattr(dense, "TILE", (2, 16))
    draw = np.random.default_rng(3)
    v, q = draw.normal(size=(100, 8)).round(1), draw.normal(size=(5, 8)).round(1)
    table = lambda k, x, m: pa.table({k: list(range(len(m))), x: m.tolist()})
    i, j, cos = dense.best_of_block(table("q", "qv", q), table("id", "v", v), "id", "v", "q", "qv", 7, 4, True)
    want = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)
    for n in range(5):
        best = sorted(range(100), key=lambda x: (-round(want[n, x], 4), x))[:7]
        assert [int(x) for x in j[i == n]] == best and np.allclose(cos[i == n], want[n, best], atol=6e-5)


def test_halves_are_rounded_as_spark_does(spark):
    # A cosine of 0.12345 but for its last bits: the sum in order decides.
    v = [(n, [0.12345 + n * 2.0**-56, math.sqrt(1 - (0.12345 + n * 2.0**-56) ** 2)], 0) for n in range(-8, 9)]
    vectors = spark.createDataFrame(v, "id long, v array<double>, label int")
    queries = spark.createDataFrame([(100, [1.0, 0.0])], "q long, qv array<double>")
    assert ranked(dense.nearest(queries, vectors, "q", "qv", "id", "v", 17), 17) == plain(queries, vectors, 17, True)


@pytest.mark.parametrize("name", ["self_excluded_neighbours", "fused_topk", "dense_cosine_topk"])
def test_no_pair_is_a_row(spark, name):
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().toString()
    assert not re.search("NestedLoopJoin|CartesianProduct", plan) and "FlatMapCoGroupsInArrow" in plan
