"""I-Match fingerprints: hashes of the sorted terms that randomised lexicons keep.

Terms are runs of digits, a-z and characters beyond ASCII, A-Z lower-cased. The
lexicon holds the terms that at least one document in MOST holds, and at most
one in LEAST does (an inverse-document-frequency band). A document's distinct
terms of the lexicon are sorted and hashed together, and once more for each of
SUBSETS x RATES lexicon subsets: a term's MD5 deals it to the subsets, so a
subset is the same for all documents, and those of one number are nested. A
small edit changes no term of most sparse subsets; dense ones tell short texts.

Fingerprint: FIELDS fields of eight hexadecimal digits joined by "-", empty
where the subset keeps no term; a document without a term of the lexicon has "="
and the MD5 of its terms in order, or of its text if it has no term. Likeness is
the share of equal fields at the sparsest rate where half of the subsets hold a
term of either document, or among all fields if there is no such rate.

Bounds: a lexicon has at most MOST times the mean number of distinct terms of a
document. It is broadcast up to BROADCAST_BYTES, and joined by a shuffle beyond.
Terms are exploded beside their document's key alone; where the rows are already
dealt by that key, as in the query, their gathering needs no further exchange.

Defined results
  null text            as the empty text
  equal texts          equal fingerprints, likeness 1
  repeated keys        each row for itself
  very long texts      whole; a document's distinct terms are one array
  empty table          an empty lexicon, no rows
  extra columns        kept where named; FINGERPRINT is added for each text
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrywork.llm.exprs import ascii_lower, let, text_or_empty
from quarrywork.llm.scratch import Scratch

#: The band: a term's documents are N / MOST to N / LEAST of N.
LEAST, MOST = 8, 1024
#: A subset reads three digits of a term's MD5, and has the terms whose digits come before these: 1/4 to 1/1024 of all.
SUBSETS, RATES = 10, ("400", "100", "040", "010", "004")
FIELDS = 1 + SUBSETS * len(RATES)
BROADCAST_BYTES = 64 << 20
#: Fixed value: what is no part of a term.
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """The terms of a text in order, repeats included."""
    # Where all characters are ASCII, the plain function does the same in less time.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.filter(F.split(low, NO_TERM), lambda t: t != "")


def _levels(mark: Column) -> Column:
    digits = [F.substring(mark, 3 * k + 1, 3) for k in range(SUBSETS)]
    return sum((sum(((d < r).cast("int") for r in RATES), F.lit(0)) * (1 << 3 * k) for k, d in enumerate(digits)), F.lit(0))


def band_lexicon(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """(term, levels): the terms inside the band over all rows, and how many of the rates have them in each subset, three bits a subset."""
    n = docs.count()
    held = docs.select(F.explode(F.array_distinct(terms(text_or_empty(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return held.filter((F.col("df") * most >= n) & (F.col("df") * least <= n)).select("term", _levels(F.md5(F.col("term").cast("binary"))).alias("levels"))


#: SQL of what a subset keeps: its sorted terms x, hashed.
_HASH = "if(size({x}) = 0, '', substring(md5(cast(array_join({x}.term, ' ') as binary)), 1, 8))"


def _rates(kept: str, k: int, rate: int = 1) -> str:
    """The hashes of subset k of the terms kept at this and all sparser rates, each filtered from the one before."""
    own = f"array({_HASH.format(x=f's{rate}')})"
    rest = f"concat({own}, {_rates(f's{rate}', k, rate + 1)})" if rate < len(RATES) else own
    return f"transform(array(filter({kept}, t -> (t.levels & {7 << 3 * k}) >= {rate << 3 * k})), s{rate} -> {rest})[0]"


def fingerprint(kept: str, otherwise: str) -> Column:
    """kept: the column of a sorted array of (term, levels)."""
    fields = f"concat(array({_HASH.format(x=kept)}), {', '.join(_rates(kept, k) for k in range(SUBSETS))})"
    return F.expr(f"if(size({kept}) > 0, array_join({fields}, '-'), concat('=', {otherwise}))")


def likeness(a: str, b: str) -> Column:
    """Of the fingerprints in two columns: 0 to 1; null if either is null."""
    rates = len(RATES)
    count = "size(filter(places, i -> {0})) as {1}"
    counts = f"struct({count.format("f.a[i] <> '' and f.a[i] = f.b[i]", 'same')}, {count.format("f.a[i] <> '' or f.b[i] <> ''", 'held')})"
    sparsest = f"transform(sequence({rates - 1}, 0, -1), r -> transform(sequence(0, {SUBSETS - 1}), k -> 1 + k * {rates} + r))"
    every = f"array(sequence(0, {FIELDS - 1}))"
    pick = f"transform(transform({sparsest}, places -> {counts}), c -> if(c.held * 2 >= {SUBSETS}, c.same / c.held, null))"
    last = f"transform({every}, places -> {counts})[0]"
    share = f"transform(array(struct(split({a}, '-') as a, split({b}, '-') as b)), f -> coalesce(get(filter({pick}, x -> x is not null), 0), {last}.same / {last}.held))[0]"
    return F.expr(f"case when {a} is null or {b} is null then null when {a} = {b} then 1D when startswith({a}, '=') or startswith({b}, '=') then 0D else {share} end")


def fingerprints(rows: DataFrame, by: list[str], keep: list[str], texts: dict[str, str], lexicon: DataFrame) -> DataFrame:
    """The columns by (together a key of rows) and keep, and a fingerprint for each text: named by texts' keys, read from the columns that are its values."""
    lexicon = Scratch(rows.sparkSession, "lexicon").write(lexicon, "lexicon")
    size = lexicon.agg(F.sum(F.octet_length("term") + 48)).first()[0] or 0
    lexicon = F.broadcast(lexicon) if size <= BROADCAST_BYTES else lexicon
    names = list(texts)

    def spread(k: int) -> Column:
        return F.transform(F.array_distinct(f"_terms{k}"), lambda t: F.struct(F.lit(k).alias("text"), t.alias("term")))

    def otherwise(k: int) -> Column:
        return F.md5(F.when(F.size(f"_terms{k}") > 0, F.array_join(f"_terms{k}", " ")).otherwise(text_or_empty(texts[names[k]])).cast("binary"))

    # One more item carries what the document keeps.
    rows = rows.withColumns({f"_terms{k}": terms(text_or_empty(texts[n])) for k, n in enumerate(names)})
    items = F.concat(F.array(F.struct(F.lit(-1).alias("text"), F.lit(None).cast("string").alias("term"))), *[spread(k) for k in range(len(names))])
    base = F.struct(*keep, *[otherwise(k).alias(f"_else{k}") for k in range(len(names))])
    open_ = rows.select(*by, base.alias("_base"), F.explode(items).alias("_item")).select(*by, F.when(F.col("_item.text") < 0, F.col("_base")).alias("_base"), F.col("_item.text").alias("_text"), F.col("_item.term").alias("term"))
    found = open_.join(lexicon, "term", "left").filter((F.col("_text") < 0) | F.col("levels").isNotNull())
    kept = F.collect_list(F.when(F.col("_text") >= 0, F.struct("_text", "term", "levels")))
    out = found.groupBy(*by).agg(F.first("_base", ignorenulls=True).alias("_base"), kept.alias("_kept"))
    for k, name in enumerate(names):
        own = F.transform(F.filter("_kept", lambda t: t["_text"] == F.lit(k)), lambda t: F.struct(t["term"].alias("term"), t["levels"].alias("levels")))  # noqa: B023
        out = out.withColumn(f"_own{k}", F.array_sort(own)).withColumn(name, fingerprint(f"_own{k}", f"_base._else{k}"))
    return out.select(*by, *[F.col(f"_base.{c}").alias(c) for c in keep], *names)


#: Pieces of the order of keys: at most so many, so many for each shuffle partition, and about so many rows each.
MOST_PIECES, PIECES_A_PARTITION, PIECE_ROWS = 1 << 14, 8, 20_000


def _numbers(values: list, kind: str) -> Column:
    """A constant array."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def _pieces(docs: DataFrame, key: str, tie: str) -> Column:
    """A number that ascends with key (nulls first) and tie, from quantiles of the keys.

    A key that fills several quantiles has a piece for each, by its ties.
    """
    n, nulls = docs.agg(F.count("*"), F.count(F.when(F.col(key).isNull(), 1))).first()
    wanted = min(MOST_PIECES, max(PIECES_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / PIECE_ROWS)))
    shares = ",".join(f"{k / wanted:.9f}D" for k in range(1, wanted))
    k = F.col(key).cast("double")
    found = docs.select(k.alias("k")).agg(F.expr(f"percentile_approx(k, array({shares}), {max(10_000, 4 * wanted)})")).first()[0] or []
    null_pieces = max(1, round(nulls * wanted / max(1, n)))
    times: dict[float, int] = {}
    for q in found:
        times[q] = times.get(q, 0) + 1
    # Numbers: first those of null keys; then for each cut the keys up to it, and its own pieces if it fills several quantiles.
    firsts = [null_pieces]
    for t in times.values():
        firsts.append(firsts[-1] + 1 + (t if t > 1 else 0))
    share = (F.shiftright(tie, 32) + (1 << 31)) / (1 << 32)  # 0 to 1, ascends with the tie
    steps = [1 << b for b in reversed(range(max(1, len(times)).bit_length()))]

    def place(x: Column) -> Column:
        """The cuts below the key, by halving; then the piece."""
        below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, s: F.when(F.get(x["cuts"], i + s - 1) < x["k"], i + s).otherwise(i))
        return let(below, lambda i: F.get(x["firsts"], i) + F.when((F.get(x["cuts"], i) == x["k"]) & (F.get(x["times"], i) > 1), 1 + F.floor(x["share"] * F.get(x["times"], i))).otherwise(0))

    tables = F.struct(_numbers(list(times), "double").alias("cuts"), _numbers(list(times.values()), "bigint").alias("times"), _numbers(firsts, "bigint").alias("firsts"), k.alias("k"), share.alias("share"))
    return F.when(k.isNull(), F.floor(share * null_pieces)).otherwise(let(tables, place))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(piece, place, key, text, next_text, ghost): each row with the text of the next one by the key, a number; the first follows the last.

    Rows of one key go by a 64-bit hash of the text. Rows are dealt by pieces of the order; a piece's last row finds its next
    in a copy (ghost > 0) of the next piece's first row.
    """
    named = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    named = named.withColumn("_piece", _pieces(named, "_key", "_tie"))
    heads = named.groupBy("_piece").agg(F.min(F.struct(F.col("_key").isNotNull(), "_key", "_tie")).alias("_head"))
    heads = Scratch(docs.sparkSession, "order").write(heads, "heads")  # a row for each piece
    pieces = sorted(r[0] for r in heads.select("_piece").collect())
    # A head is also dealt to the piece before its own; the first head to the last piece, behind all.
    at = F.array_position(_numbers(pieces, "bigint"), F.col("_piece")).cast("int")
    before = F.coalesce(F.get(_numbers(pieces, "bigint"), at - 2), F.lit(pieces[-1] if pieces else 0))
    heads = heads.select(F.col("_head._key").alias("_hkey"), F.col("_head._tie").alias("_htie"), F.struct(before.cast("bigint").alias("piece"), F.when(at == 1, 2).otherwise(1).alias("ghost")).alias("_ghost"))
    own = F.struct(F.col("_piece").alias("piece"), F.lit(0).alias("ghost"))
    joined = named.join(F.broadcast(heads), F.col("_key").eqNullSafe(F.col("_hkey")) & (F.col("_tie") == F.col("_htie")), "left")
    copies = F.when(F.col("_ghost").isNotNull(), F.array(own, "_ghost")).otherwise(F.array(own))
    dealt = joined.select("_key", "_text", "_tie", F.explode(copies).alias("_at")).select("_key", "_text", "_tie", "_at.piece", "_at.ghost")
    order = W.partitionBy("piece").orderBy("ghost", F.col("_key").asc_nulls_first(), "_tie")
    return dealt.select("piece", F.row_number().over(order).alias("place"), F.col("_key").alias(key), F.col("_text").alias(text), F.lead("_text").over(order).alias("next_text"), "ghost")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.length("text")
    moved = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), moved))
    rows = with_next(docs).select("piece", "place", "ghost", "doc_id", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = fingerprints(rows, ["piece", "place"], ["ghost", "doc_id", "n_chars", "edited_sha256"], {"fingerprint": "text", "edited_fingerprint": "edited"}, band_lexicon(docs))
    after = F.lead("fingerprint").over(W.partitionBy("piece").orderBy("place"))
    found = found.withColumn("_next", after).filter("ghost = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next").alias("near_next"))


def _sql() -> str:
    words = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    digest = "CASE WHEN len({0}) = 0 THEN '' ELSE substr(md5(array_to_string({0}, ' ')), 1, 8) END"
    fields = [digest.format("kept")] + [digest.format(f"list_filter(kept, lambda w: substr(md5(w), {3 * k + 1}, 3) < '{r}')") for k in range(SUBSETS) for r in RATES]
    marks = f"CASE WHEN len(kept) = 0 THEN '=' || md5(CASE WHEN len(ws) > 0 THEN array_to_string(ws, ' ') ELSE t END) ELSE concat_ws('-', {', '.join(fields)}) END"

    def near(a: str, b: str) -> str:
        x, y = f"string_split({a}, '-')", f"string_split({b}, '-')"
        count = lambda places, test: f"len(list_filter({places}, lambda i: {test.format(f'{x}[i]', f'{y}[i]')}))"
        same, held = "{0} <> '' AND {0} = {1}", "({0} <> '' OR {1} <> '')"
        cases = []
        for r in reversed(range(len(RATES))):
            places = str([2 + k * len(RATES) + r for k in range(SUBSETS)])
            cases.append(f"WHEN 2 * {count(places, held)} >= {SUBSETS} THEN {count(places, same)} / {count(places, held)}")
        every = f"range(1, {FIELDS + 1})"
        return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a}[1] = '=' OR {b}[1] = '=' THEN 0.0 {' '.join(cases)} ELSE {count(every, same)} / {count(every, held)} END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents),
x AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS et FROM x),
lex AS (SELECT w FROM (SELECT unnest(list_distinct({words.format('t')})) AS w FROM d) GROUP BY w HAVING count(*) * {MOST} >= (SELECT count(*) FROM d) AND count(*) * {LEAST} <= (SELECT count(*) FROM d)),
v AS (SELECT doc_id, 0 AS which, t FROM d UNION ALL SELECT doc_id, 1, et FROM e),
s AS (SELECT doc_id, which, t, {words.format('t')} AS ws FROM v),
u AS (SELECT DISTINCT doc_id, which, unnest(ws) AS w FROM s),
k AS (SELECT doc_id, which, list(w ORDER BY w) AS kept FROM u JOIN lex USING (w) GROUP BY ALL),
f AS (SELECT doc_id, which, {marks} AS mark FROM (SELECT s.*, coalesce(kept, CAST([] AS VARCHAR[])) AS kept FROM s LEFT JOIN k USING (doc_id, which))),
g AS (SELECT e.doc_id, n, et, a.mark AS fa, b.mark AS fb FROM e JOIN f a ON a.doc_id = e.doc_id AND a.which = 0 JOIN f b ON b.doc_id = e.doc_id AND b.which = 1),
h AS (SELECT *, coalesce(lead(fa) OVER (ORDER BY doc_id), first_value(fa) OVER (ORDER BY doc_id)) AS fn FROM g)
SELECT doc_id, n AS n_chars, sha256(et) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, CAST({near('fa', 'fb')} AS DOUBLE) AS near_edited, CAST({near('fa', 'fn')} AS DOUBLE) AS near_next FROM h
"""


ORACLE = _sql()
