"""Filter interaction audit: what each order of filters removes, from the counts of joint failures.

Each document has a flag for each filter it fails. For every set of filters, the products of its flags are summed: how many
documents fail all of them. Moebius inversion over the sets gives the survivors of each set, and with those whatever an order
of filters does at each step: survivors before less survivors after are removed, failures less removals are redundant, and the last
filter's removals behind all others are its unique failures. The signed joint counts are also the Harsanyi dividends of
"documents removed"; a filter's equal shares of those sum to its Shapley value, whose multiple by the number of orders is a whole number.

Texts are read once, to flags and a digest. Sums of products combine in the tasks before the shuffle, so a part with a third of all
rows costs no task more than its counts. Of each text the smallest id is found, and a document is the first of its text where (digest,
id) meets it: no group of copies is gathered.

Defined results: a null text is an empty one, which fails A and no other but E; a null id is larger than any other, and rows of a text
whose smallest ids are equal are all firsts; a null part is the empty string, which it shares with that; several labels of an id count
once, null labels not at all; texts are compared by SHA-256; repeated rows count each; an empty table has no parts; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table

FILTERS = "ABCDE"


def flags(text: Column) -> dict[str, Column]:
    """Failures by the text alone."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n, different = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * different < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic): a row per document, flags and labels as 0 or 1."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    last = F.lit((1 << 63) - 1)
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.coalesce(id_, last).alias("place"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *[f.cast("int").alias(name) for name, f in flags(text).items()])
    rows = cut(rows, "flags")
    first = rows.groupBy("digest").agg(F.min("place").alias("place")).withColumn("first", F.lit(1))
    rows = rows.join(first, ["digest", "place"], "left").withColumn("E", 1 - F.coalesce("first", F.lit(0)))
    if labels is None:
        return rows.select("part", *FILTERS, F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    return rows.join(known, "id", "left").select("part", *FILTERS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def joint_failures(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, every, good, toxic): for each set of filters, by its bits, how many documents of a kind fail all of them."""
    sets = range(1 << len(filters))
    product = lambda s, kind: reduce(mul, [F.col(f) for i, f in enumerate(filters) if s >> i & 1], kind)
    kinds = {"every": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    summed = rows.groupBy("part").agg(*[F.sum(product(s, kind)).alias(f"{name}_{s}") for name, kind in kinds.items() for s in sets])
    return summed.select("part", *[F.array(*[F.col(f"{name}_{s}") for s in sets]).alias(name) for name in kinds])


def survivors(joint: Column, n_filters: int) -> Column:
    """By Moebius inversion: for each set, how many documents fail none of it."""
    sets = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))
    signed = F.transform(joint, lambda x, s: F.when(F.bit_count(s) % 2 == 0, x).otherwise(-x))
    return F.transform(sets, lambda s: F.aggregate(F.filter(sets, lambda t: t.bitwiseAND(s) == t), F.lit(0).cast("long"), lambda n, t: n + F.get(signed, t)))


def shares(joint: Column, n_filters: int) -> Column:
    """Each filter's Shapley value times the number of orders: its shares of the dividends of all sets that hold it."""
    orders = F.lit(factorial(n_filters))
    sets = F.sequence(F.lit(1), F.lit((1 << n_filters) - 1))
    dividend = lambda t: F.get(joint, t) * F.when(F.bit_count(t) % 2 == 1, 1).otherwise(-1)
    # n! is a multiple of each set's size
    part = lambda t: (dividend(t) * (orders / F.bit_count(t)).cast("long")).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(n_filters - 1)), lambda f: F.aggregate(F.filter(sets, lambda t: t.bitwiseAND(F.pow(F.lit(2), f).cast("int")) > 0), F.lit(0).cast("long"), lambda n, t: n + part(t)))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from flagged rows."""
    n, whole = len(filters), (1 << len(filters)) - 1
    joint = joint_failures(rows, filters)
    # new names: lambdas would take an alias of the same select for the column
    known = joint.select("part", F.col("every").alias("joint"), *[survivors(F.col(c), n).alias(f"left_{c}") for c in ("every", "good", "toxic")], shares(F.col("every"), n).alias("shares"))
    known = cut(known, "survivors")  # a row per part
    orders = F.explode(F.lit(["".join(p) for p in permutations(filters)]))
    steps = known.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = lambda name: F.instr(F.lit(filters), name) - 1
    steps = steps.withColumn("f", place(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), F.pow(F.lit(2), place(F.substr("filter_order", k, F.lit(1)))).cast("int")).otherwise(0))
    )
    bit = F.pow(F.lit(2), F.col("f")).cast("int")
    steps = steps.withColumn("bit", bit).withColumn("after", F.col("before") + F.col("bit"))
    lost = lambda kind: F.get(f"left_{kind}", F.col("before")) - F.get(f"left_{kind}", F.col("after"))
    every, removed = F.col("left_every"), lost("every")
    return steps.select(
        "part", "filter_order", "step", F.get(every, F.col("after")).alias("kept"), removed.alias("removed"), (F.get("joint", F.col("bit")) - removed).alias("redundant"),
        (F.get(every, whole - F.col("bit")) - F.get(every, F.lit(whole))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
          coalesce(d.doc_id, 9223372036854775807) > min(coalesce(d.doc_id, 9223372036854775807)) OVER (PARTITION BY t)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_reduce(list_transform(p, lambda x: substr('ABCDE', x, 1)), lambda x, y: x || y) AS filter_order, p, k.i AS step, p[k.i] AS own, p[1:k.i - 1] AS before FROM o, i k),
r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS here, len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM g, s
), z AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE here AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE here AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""
