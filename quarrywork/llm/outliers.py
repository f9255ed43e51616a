r"""Quality rules with robust multivariate outliers.

Base rules come first. The documents that pass them are judged by language and
source: a minimum-covariance-determinant estimate of the transformed statistic
vector, by concentration steps from several starts, and rejection by
Mahalanobis distance. All of it is SQL functions.

A concentration step keeps, in each group, the (n + p + 1) / 2 rows nearest
the last centre, and takes their mean and covariance; so up to half of a group
may be anything. The starts are the coordinates' medians, their shortest
halves, and their lower and their upper halves. After FIRST_STEPS steps each
group goes on from the start with the least determinant of its covariance,
until no group's determinant changes (MOST_STEPS at most). The nearest rows come
from a histogram of distances (counts by group and bin, summed before the
shuffle), so no group gathers in one task, and the result doesn't depend on
how rows are dealt. Sums for mean and covariance are partial aggregates too.
The p x p inverse is an unrolled Cholesky factorisation in column expressions.

Distances are scaled so that each group's median is that of the chi-squared
distribution. Each coordinate's variance has a floor (FLOORS), as many
statistics are constant in clean text. A group's final estimate counts the
estimate of all rows, made in the same passes, as PRIOR rows besides its own
(and so does the logarithm of its scale): one rule for groups of every size,
under which a few rows are judged by all others and many by themselves. A
document is rejected over the chi-squared quantile CUTOFF.

Defined results
  null, empty or word-free text   all statistics 0; fails the base rules
  null language or source         a group of its own
  very long texts                 whole; counts are exact at any length
  ties of distance                one bin, kept or left together
  repeated rows                   each counts and gets its verdict
  empty table                     no rows
  extra columns                   ignored
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrywork.llm.exprs import indices, let, space_words, text_or_empty
from quarrywork.llm.scratch import Scratch

#: Documents' own statistics, transformed to near-symmetric ones: name, expression, least standard deviation.
STATISTICS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
FLOORS = {"log_words": 0.75, "word_length": 0.5, "symbols": 0.3, "dup_lines": 0.5, "repeats": 0.5}
FIRST_STEPS, MOST_STEPS = 2, 12
#: A step is the last if no group's log-determinant changes by more. Steps finer than that can't be told from rows that tie in a distance bin.
CONVERGED = 0.01
PRIOR = 50
#: The key of the group of all rows; other groups' keys aren't empty.
POOLED = ""
#: The upper 1e-9 quantile of the chi-squared distribution of 5 degrees of freedom, and its median.
CUTOFF, MEDIAN = 52.0, 4.3515
#: Distance bins: so many for each doubling.
BINS = 32
#: Where the halves of a coordinate begin, among which a start takes the shortest.
HALVES = tuple(k / 20 for k in range(11))
BROADCAST_GROUPS = 20_000


def base_statistics(text: str = "text") -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column; helper column _w is its words."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("_w").cast("bigint"),
        "word_chars": F.length(F.array_join("_w", "")).cast("bigint"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": _repeat_words(F.col("_w")).cast("bigint"),
    }


#: Windows of texts of up to so many words are sorted as longs, a hash above their position.
_POSITION_BITS = 16
_POSITION = (1 << _POSITION_BITS) - 1


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in w.

    Windows are sorted by hash and position, and equal neighbours compared by
    their words. In a long text hash and position are fields of a struct, as one
    number could not hold both.
    """
    starts = indices(F.size(w) - 2)
    of = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed = F.transform(starts, lambda i: of(i).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("bigint")))
    short = _repeated(w, packed, lambda x: F.shiftright(x, _POSITION_BITS), lambda x: x.bitwiseAND(F.lit(_POSITION)))
    paired = F.transform(starts, lambda i: F.struct(of(i).alias("h"), i.cast("bigint").alias("i")))
    return F.when(F.size(w) <= _POSITION, short).otherwise(_repeated(w, paired, lambda x: x["h"], lambda x: x["i"]))


def _repeated(w: Column, windows: Column, hash_of: Callable[[Column], Column], place_of: Callable[[Column], Column]) -> Column:
    def same(a: Column, b: Column) -> Column:
        i, j = place_of(a).cast("int"), place_of(b).cast("int")
        equal = (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
        return (hash_of(a) == hash_of(b)) & equal

    def repeated(p: Column) -> Column:
        hit = F.filter(p, lambda x, k: F.coalesce((k > 0) & same(F.get(p, k - 1), x), F.lit(False)) | F.coalesce(same(x, F.get(p, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(hit, place_of))

    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    add = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n"))
    return let(F.sort_array(windows), lambda p: F.aggregate(repeated(p), zero, add)["n"])


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "log_words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.log1p(100.0 * F.col("n_symbols") / n),
        "dup_lines": F.log1p(100.0 * F.col("n_dup_lines") / n),
        "repeats": F.log1p(100.0 * F.col("n_repeat_words") / n),
    }


def _inverse_distance(p: int) -> list[str]:
    """SQL of the squared Mahalanobis distance, from differences d0.., and a struct g of a lower Cholesky factor l_i_j: forward substitution."""
    terms = []
    for i in range(p):
        inner = " - ".join([f"d{i}", *(f"g.l_{i}_{j} * y{j}" for j in range(i))])
        terms.append(f"({inner}) / g.l_{i}_{i}")
    return terms


def _distance(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Adds d2, given the struct g of centre c_i and factor l_i_j."""
    for i, name in enumerate(names):
        rows = rows.withColumn(f"d{i}", F.col(name) - F.col(f"g.c_{i}"))
    for i, term in enumerate(_inverse_distance(len(names))):
        rows = rows.withColumn(f"y{i}", F.expr(term))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(names))), F.lit(0.0))
    return rows.withColumn("dist2", d2).drop(*[f"{a}{i}" for a in "dy" for i in range(len(names))])


def _estimate(moments: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    """Rows of keys, n, s_i and s_i_j to keys, m (those sums) and g: centre, and Cholesky factor of the covariance with the floors added."""
    p, out = len(names), moments
    for i in range(p):
        out = out.withColumn(f"c_{i}", F.col(f"s_{i}") / F.col("n"))
    for j in range(p):
        for i in range(j, p):
            v = F.col(f"s_{j}_{i}") / F.col("n") - F.col(f"c_{i}") * F.col(f"c_{j}")
            if i == j:
                v = F.greatest(v, F.lit(0.0)) + FLOORS[names[i]] ** 2
            v = v - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            v = F.sqrt(F.greatest(v, F.lit(1e-9))) if i == j else v / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", v)
    parts = [f"c_{i}" for i in range(p)] + [f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return out.select(*keys, F.struct(*_sums(names)).alias("m"), F.struct(*parts).alias("g"))


def _sums(names: tuple[str, ...]) -> list[str]:
    p = range(len(names))
    return ["n", *[f"s_{i}" for i in p], *[f"s_{j}_{i}" for j in p for i in p if i >= j]]


def _moments(names: tuple[str, ...]) -> list[Column]:
    p = range(len(names))
    return [
        F.count("*").alias("n"),
        *[F.sum(names[i]).alias(f"s_{i}") for i in p],
        *[F.sum(F.col(names[j]) * F.col(names[i])).alias(f"s_{j}_{i}") for j in p for i in p if i >= j],
    ]


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * BINS).cast("int")


def _half(n: Column, p: int) -> Column:
    """The rows of n that an estimate of p coordinates rests on."""
    return F.least(n, F.floor((n + p + 1) / 2))


def _quantile_bins(rows: DataFrame, keys: list[str], need: Callable[[Column], Column]) -> DataFrame:
    """(keys, cut): the least bin up to which need(n) of a group's n rows lie."""
    counts = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total, below = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin")
    marked = counts.withColumns({"all": F.sum("n").over(total), "upto": F.sum("n").over(below)})
    return marked.filter(F.col("upto") >= need(F.col("all"))).groupBy(*keys).agg(F.min("bin").alias("cut"))


def _start(rows: DataFrame, names: tuple[str, ...], keys: list[str]) -> DataFrame:
    """(keys, _start, g): centres and diagonal factors by a histogram of each coordinate.

    Start 0 is the median and the quartiles' distance, start 1 the shortest half, starts 2 and 3 the lower and the upper half.
    """
    step = {n: FLOORS[n] / 4 for n in names}
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(n) / step[n]).cast("int").alias("bin")) for i, n in enumerate(names)]))
    flat = rows.select(*keys, kinds.alias("x")).select(*keys, "x.i", "x.bin")
    counts = flat.groupBy(*keys, "i", "bin").agg(F.count("*").alias("n"))
    total, below = W.partitionBy(*keys, "i"), W.partitionBy(*keys, "i").orderBy("bin")
    marked = counts.withColumns({"all": F.sum("n").over(total), "upto": F.sum("n").over(below)})
    quantile = lambda share: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.round(F.col("all") * share, 6)), F.lit(1)), F.col("bin")))
    shares = sorted({*HALVES, *(h + 0.5 for h in HALVES)})
    q = marked.groupBy(*keys, "i").agg(*[quantile(x).alias(f"q{round(x * 100)}") for x in shares])
    half = lambda h: F.struct((F.col(f"q{round(h * 100) + 50}") - F.col(f"q{round(h * 100)}")).alias("width"), F.col(f"q{round(h * 100)}").alias("low"))
    # (centre, spread) in bins; half of a normal distribution, at its middle, is 1.349 deviations wide
    of = lambda x: F.struct((x["low"] + x["width"] / 2 + 0.5).alias("c"), (x["width"] / 1.349).alias("l"))
    medians = F.struct((F.col("q50") + 0.5).cast("double").alias("c"), ((F.col("q75") - F.col("q25")) / 1.349).alias("l"))
    starts = F.array(medians, of(F.least(*[half(h) for h in HALVES])), of(half(0.0)), of(half(0.5)))
    p = range(len(names))
    width = F.element_at(F.array(*[F.lit(step[n]) for n in names]), F.col("i") + 1)
    floor = F.element_at(F.array(*[F.lit(FLOORS[n]) for n in names]), F.col("i") + 1)
    both = q.select(*keys, "i", F.posexplode(starts).alias("_start", "x")).select(*keys, "_start", "i", (F.col("x.c") * width).alias("c"), F.greatest(floor, F.col("x.l") * width).alias("l"))
    one = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    wide = both.groupBy(*keys, "_start").agg(*[one(i, "c").alias(f"c_{i}") for i in p], *[one(i, "l").alias(f"l_{i}_{i}") for i in p])
    parts = [f"c_{i}" for i in p] + [(F.col(f"l_{i}_{i}") if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in p for j in range(i + 1)]
    return wide.select(*keys, "_start", F.struct(*parts).alias("g"))


def _log_determinant(p: int) -> Column:
    return 2 * sum((F.log(F.col(f"g.l_{i}_{i}")) for i in range(p)), F.lit(0.0))


def _least_determinant(groups: DataFrame, p: int, keys: list[str]) -> DataFrame:
    """(keys, m, g): of a group's starts the one with the least covariance determinant."""
    return groups.groupBy(*keys).agg(F.min(F.struct(_log_determinant(p).alias("size"), "_start", "m", "g")).alias("x")).select(*keys, "x.m", "x.g")


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, keys)


def _concentrate(vectors: DataFrame, groups: DataFrame, names: tuple[str, ...], keys: list[str], runs: list[str], small: bool) -> DataFrame:
    """(runs, m, g): the estimates of the half that is nearest to each estimate of groups."""
    # With runs by start a group has a row for each, so the join gives each vector to every start.
    near = _distance(_with_groups(vectors, groups.select(*runs, "g"), keys, small), names).withColumn("bin", _bin(F.col("dist2"))).drop("g")
    cut = _quantile_bins(near, runs, lambda n: _half(n, len(names)))
    kept = _with_groups(near, cut, runs, small).filter(F.col("bin") <= F.col("cut"))
    return _estimate(kept.groupBy(*runs).agg(*_moments(names)), names, runs)


def mcd_estimates(vectors: DataFrame, names: tuple[str, ...], keys: list[str], scratch: Scratch, small: bool) -> DataFrame:
    """(keys, m, g, scale, n): each group's estimate of least determinant, the factor that brings its median distance to the chi-squared one, and its rows. Keys aren't null."""
    p, runs = len(names), [*keys, "_start"]
    groups = scratch.write(_start(vectors, names, keys), "start")
    for step in range(FIRST_STEPS):
        groups = scratch.write(_concentrate(vectors, groups, names, keys, runs, small), f"first{step}")
    groups = scratch.write(_least_determinant(groups, p, keys), "least")
    for step in range(MOST_STEPS):
        size = lambda df, name: df.select(*keys, _log_determinant(p).alias(name))
        after = scratch.write(_concentrate(vectors, groups, names, keys, keys, small), f"step{step}")
        moved = size(after, "x").join(size(groups, "y"), keys).agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
        groups = after
        if moved is None or moved <= CONVERGED:
            break
    final = _distance(_with_groups(vectors, groups, keys, small), names).withColumn("bin", _bin(F.col("dist2")))
    median = _quantile_bins(final, keys, lambda n: F.ceil(n * 0.5)).withColumn("scale", MEDIAN / F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BINS))
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("n"))
    return scratch.write(groups.join(median.select(*keys, F.least(F.col("scale"), F.lit(1.0)).alias("scale")), keys).join(sizes, keys), "estimates")


def _shrunk(own: DataFrame, names: tuple[str, ...], keys: list[str], whole) -> DataFrame:
    """(keys, g, scale): own centres and covariances, averaged with those of all rows (whole, a row), which weigh as PRIOR rows. What lies between the two centres isn't counted, so a few far rows can't widen their own group."""
    p, total = range(len(names)), F.col("m.n") + PRIOR
    mean = lambda x, y: (F.col("m.n") * x + PRIOR * y) / total
    centre = [mean(F.col(f"m.s_{i}") / F.col("m.n"), whole.m[f"s_{i}"] / whole.m["n"]) for i in p]
    within = lambda m, i, j: m[f"s_{j}_{i}"] / m["n"] - m[f"s_{i}"] / m["n"] * (m[f"s_{j}"] / m["n"])
    spread = {(j, i): mean(within(F.col("m"), i, j), within(whole.m, i, j)) for j in p for i in p if i >= j}
    scale = F.exp((F.col("n") * F.log("scale") + PRIOR * math.log(whole.scale)) / (F.col("n") + PRIOR))
    firsts = [(total * centre[i]).alias(f"s_{i}") for i in p]
    sums = own.select(*keys, scale.alias("scale"), total.alias("n"), *firsts, *[(total * (v + centre[i] * centre[j])).alias(f"s_{j}_{i}") for (j, i), v in spread.items()])
    return _estimate(sums, names, [*keys, "scale"]).select(*keys, "g", "scale")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    scratch = Scratch(docs.sparkSession, "outliers")
    named = docs.select(F.col(key).alias("_key"), F.struct(F.col(lang).alias("l"), F.col(source).alias("s")).alias("_group"), F.col(text).alias("_text"))
    stats = base_statistics("_text")
    # A group's key is text that tells null from any value, so that joins need no null-safe form.
    mark = F.concat_ws("\x01", F.coalesce(F.concat(F.lit("v"), "_group.l"), F.lit("n")), F.coalesce(F.concat(F.lit("v"), "_group.s"), F.lit("n")))
    base = named.withColumn("_w", space_words(text_or_empty("_text"))).select("_key", mark.alias("_g"), *[c.alias(n) for n, c in stats.items()])
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = scratch.write(base.withColumn("base_failed", failed).withColumns(_vector()), "statistics")
    # Each row counts in its own group and in that of all rows.
    passing = rows.filter(~F.col("base_failed")).select(F.explode(F.array("_g", F.lit(POOLED))).alias("_g"), *STATISTICS)
    n_groups = passing.select("_g").distinct().limit(BROADCAST_GROUPS + 1).count()
    small = n_groups <= BROADCAST_GROUPS
    estimates = mcd_estimates(passing, STATISTICS, ["_g"], scratch, small)
    whole = estimates.filter(F.col("_g") == POOLED).first()
    own = estimates.filter(F.col("_g") != POOLED)
    own = _shrunk(own, STATISTICS, ["_g"], whole) if whole else own.select("_g", "g", "scale")
    joined = rows.join(F.broadcast(own) if small else own, "_g", "left")
    far = _distance(joined, STATISTICS).withColumn("distance", F.col("dist2") * F.col("scale"))
    return far.select(
        F.col("_key").alias(key),
        *stats,
        "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"),
        "distance",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
