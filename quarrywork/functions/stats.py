"""Exact tests as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of b and c discordant pairs: twice the binomial tail, 1 at most; 1 where there are none.

    Terms are built in logarithms from n - k + 1 over k, so that large counts stay finite.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double"))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.aggregate(steps, start, step)["sum"] * 2))


def fisher_combined(p_values: Column) -> Column:
    """The chi-squared survival of -2 times the sum of logarithms; its 2k degrees of freedom give a finite sum."""
    half = -F.aggregate(p_values, F.lit(0.0), lambda a, p: a + F.log(p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * half / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(F.size(p_values) > 1, F.sequence(F.lit(1), F.size(p_values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exp(-half) * F.aggregate(steps, start, step)["sum"]


def rate(part: Column, whole: Column) -> Column:
    """part over whole, 0 where whole is 0."""
    return part / F.greatest(whole, F.lit(1))
